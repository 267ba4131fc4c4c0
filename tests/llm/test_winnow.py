"""Winnowing against its definition in Python."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import winnow

K, W = winnow.GRAM, winnow.WINDOW


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chosen(text, k=K, w=W):
    if not text:
        return []
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) >> 11 for g in grams]
    out = []
    for i in range(max(1, len(h) - w + 1)):
        least = min(h[i : i + w])
        at = max(j for j in range(i, min(len(h), i + w)) if h[j] == least)
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def digest(marks):
    return hashlib.sha256(f"{[h for h, _ in marks]}@{[p for _, p in marks]}".encode()).hexdigest()


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows (doc_id, text) in the order of the query."""
    out = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e = chosen(text), chosen(edited)
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(e), round(likeness(a, e), 9), round(likeness(a, chosen(after)), 9), len(a), len(e)))
    return sorted(out, key=str)


def texts():
    g = random.Random(5)
    long = "".join(g.choice("abcdé 漢\n") for _ in range(3000))
    lengths = [0, 1, 2, 7, 14, 15, 16, 17, 29, 30, 31, 32, 33, 45, 46, 47, 60, 61, 62, 63, 64, 90, 91, 511, 512, 513, 541, 542, 543, 1023, 1024, 1025, 1054, 1055, 1056, 2500]
    out = ["".join(g.choice("abcdé 漢\n") for _ in range(n)) for n in lengths]
    out += [long[:n] for n in lengths] + ["a" * n for n in lengths] + [long[5:600], "x" + long, None, "😀" * 700 + "z"]
    g.shuffle(out)
    return out


def result(spark, df, path):
    df.write.parquet(path + "/documents.parquet")
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9), *r[7:]) for r in winnow.op13_fingerprints(spark, path).collect()), key=str)


@pytest.mark.parametrize("range_bytes", [4_000_000, 3_000, 1])
def test_query_is_brute_force(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(winnow, "RANGE_BYTES", range_bytes)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(spark, df, str(tmp_path)) == brute(rows[::-1])


def test_whole_table_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = sorted(((*r[:5], round(r[5], 9), round(r[6], 9), *r[7:]) for r in winnow.op13_fingerprints(spark, sf).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("k, w", [(1, 4), (5, 4), (16, 16), (3, 64), (600, 256)])
def test_other_parameters(spark, k, w):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(zip(r.hashes, r.positions)) for r in winnow.fingerprints(df, k, w).collect()}
    assert got == {d: chosen(t, k, w) for d, t in rows}
    with pytest.raises(ValueError):
        winnow.fingerprints(df, 5, 5)


def test_shared_passages_are_found_where_they_are(spark):
    g = random.Random(8)
    word = lambda n: "".join(g.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(60):
        passage, a, b = word(K + W - 1 + i % 3), word(g.randint(0, 900)), word(g.randint(0, 900))
        rows.append((i, a + passage + word(g.randint(0, 700)), b + passage + word(g.randint(0, 700)), len(a), len(b), len(passage)))
    df = spark.createDataFrame(rows, "id int, x string, y string, at_x int, at_y int, n int")
    one = lambda c: winnow.marks_of(F.col(c))
    df = df.withColumn("mx", one("x")).withColumn("my", one("y"))
    df = df.withColumn("s", winnow.shared(F.col("mx"), F.col("my")))
    for r in df.collect():
        assert any(r.at_x <= s.pos_a <= r.at_x + r.n - K and s.pos_a - r.at_x == s.pos_b - r.at_y for s in r.s)


def test_null_repeated_and_empty(spark, edge, empty, tmp_path, make):
    assert winnow.with_next(empty).count() == 0
    assert result(spark, empty, str(tmp_path / "a")) == []
    got = winnow.with_next(edge).select("doc_id", "text").collect()
    assert len(got) == 12 and sum(r.doc_id is None for r in got) == 2
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))]
    assert [d for d in ids if d is not None] == [9, 8, 7, 6, 5, 4, 3, 2, 2, 1]
    one = result(spark, make([(1, "abc" * 40, "en", "a")]), str(tmp_path / "b"))
    assert one == brute([(1, "abc" * 40)])
    prints = {}
    for r in winnow.fingerprints(edge).collect():
        prints.setdefault(r.doc_id, set()).add((tuple(r.hashes), tuple(r.positions)))
    assert all(len(v) == 1 for v in prints.values()) and prints[7] == prints[8] and prints[3] == prints[4] == {((), ())}


def test_one_id_for_a_third_of_all_rows(spark, make, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_BYTES", 500)
    docs = make([(5 if i % 3 == 0 else i, f"text number {i} of a table with one hot id", "en", "a") for i in range(300)])
    rows, n = winnow.ranged(docs)
    sizes = [r["count"] for r in rows.groupBy("range").count().collect()]
    assert n > 10 and max(sizes) < 100
    assert winnow.with_next(docs).count() == 300


def test_very_long_text(spark):
    words = "".join(f"word{i % 9973} " for i in range(150_000))
    df = spark.createDataFrame([(1, words)], "doc_id bigint, text string")
    r = winnow.fingerprints(df).first()
    assert r.n_chars == len(words) and list(zip(r.hashes, r.positions)) == chosen(words)
