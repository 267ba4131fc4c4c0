"""Conversation repair against all repairs of short conversations, and cut in other ways."""

import hashlib
import itertools
import random
import re

import pytest

from pairwright.llm import repair

from ..oracle import compare, connection

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """By trying every edit of every row, with up to two insertions before each and at the end."""
    insert = [(5 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    ways = []
    for (_, _, role, text), f in zip(rows, bad):
        own = [(2, "D", [])]
        if f not in ("blank", "duplicate"):
            more = 5 * (f == "truncated")
            own += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        ways += [insert, own]
    for choice in itertools.product(*ways, insert):
        cost, audit = sum(c[0] for c in choice), "".join(c[1] for c in choice)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        turns = [t for c in choice for t in c[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "_" for r, _ in turns)):
            best = cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
    return best


def report(conv, rows):
    rows = ordered([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    bad = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return conv, (max(turns) - min(turns) + 1 - len(turns)) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, rows, bad


def brute(conv, rows):
    *head, rows, bad = report(conv, rows)
    cost, audit, text = cheapest(rows, bad)
    return *head, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(n, longest, seed):
    g = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    said = ["Hi.", "Hi.", "Yes!", "cut of", "", " \t", None, "Why? ", "é…", "漢。", "a.b", "line\nline."]
    out = []
    for c in range(n):
        for t in range(g.randint(1, longest)):
            out.append((None if c == 0 else c, None if g.random() < 0.1 else t + (g.random() < 0.1) * 3 - (g.random() < 0.1), g.choice(roles), g.choice(said)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_is_its_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(spark, connection(sf), sf, "op11", repair.op11_repair, repair.OP11_SQL)


@pytest.mark.parametrize("piece, fan", [(256, 64), (1, 2)])
def test_all_repairs_of_short_conversations(spark, monkeypatch, piece, fan):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations(60, 3, 1)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = rows_of(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == sorted((brute(c, own) for c, own in by.items()), key=str)


def test_long_conversations_in_pieces(spark, monkeypatch):
    rows = conversations(12, 60, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = rows_of(repair.repair(df))
    for piece, fan, batch in ((5, 3, 20_000), (2, 2, 10)):
        monkeypatch.setattr(repair, "PIECE", piece)
        monkeypatch.setattr(repair, "FAN", fan)
        monkeypatch.setattr(repair, "BATCH_ROWS", batch)
        assert rows_of(repair.repair(df.repartition(piece))) == whole
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert {r[:6] for r in whole} == {report(c, own)[:6] for c, own in by.items()}


def test_one_conversation_and_one_row_hold_a_third(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "Same text.") for t in range(3000)] + [(2, 5, "user", "Twice.")] * 1500 + [(c, t, "assistant" if t % 2 else "user", f"Text {c} {t}.") for c in range(3, 600) for t in range(4)]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert (got[1].duplicate, got[1].cost, len(got[1].audit)) == (2998, 2 * 2998 + 2, 3000)
    assert (got[2].duplicate, got[2].cost, got[2].audit) == (1499, 2 * 1500, "D" * 1500)
    assert all(got[c].cost == 0 and got[c].audit == "KKKK" for c in range(3, 600))


def test_empty_and_lost_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id bigint")
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(repair.repair(none, ids)) == sorted([(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=str)


def test_extra_columns_and_very_long_texts(spark):
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long, "x", 5), (1, 1, "user", long[:-2] + "?", "y", 6)]
    df = spark.createDataFrame(rows, SCHEMA + ", digest string, rid int")
    got = repair.repair(df).collect()
    assert [tuple(r)[1:8] for r in got] == [(0, 0, 0, 0, 1, 1, "KR")]
    assert got[0].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long[:-2]}?".encode()).hexdigest()
