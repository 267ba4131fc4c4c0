"""Fill-in-middle against its definition in Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import fim

SCHEMA = "doc_id bigint, text string"


def brute(doc_id, text, plan=fim.Plan()):
    text = text or ""
    u = re.findall(plan.unit, text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h3 % 100 >= plan.rate:
        return doc_id, len(u), "plain", None, None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < plan.spm:
        return doc_id, len(u), "spm", p, m, s, plan.suffix + s + plan.prefix + p + plan.middle + m
    return doc_id, len(u), "psm", p, m, s, plan.prefix + p + plan.suffix + s + plan.middle + m


def texts():
    g = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "no end", "<P>", "x<S>y\nz", "<M", "<P\n>", "<<P\n<S\nP>\n", fim.ESCAPE, fim.DELIMITER, "1\r\n2\r3\n", "é\n漢\n😀😀\n"]
    bits = ["a", "\n", "\n", fim.ESCAPE, fim.DELIMITER, "0", "1", "<", "P", "S", ">", "M", "é", "😀", "$0", "\\", "\x00"]
    return out + ["".join(g.choice(bits) for _ in range(g.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(rate=40, spm=90, seed="x"), fim.Plan("<|p|>", "<|s|>", "<|m|>", unit=r"[^ \n]*[ \n]+|[^ \n]+", rate=100, spm=0)])
def test_is_brute_force_and_comes_back(spark, plan):
    rows = [(i - 5, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (7, "a\nb\nc"), (7, "a\nb\nc")]
    got = fim.transformed(spark.createDataFrame(rows, SCHEMA), plan)
    key = str
    assert sorted(map(tuple, got.select("doc_id", "n", "form", "prefix", "middle", "suffix", "output").collect()), key=key) == sorted((brute(d, t, plan) for d, t in rows), key=key)
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form"), plan)).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((d, t or "") for d, t in rows), key=key)


def test_marks_that_could_arise_by_themselves_are_refused():
    for marks in (("<", "a", "b"), ("<P>", "<P>", "<M>"), ("ab", "ba", "cd"), ("<P><", "<S>", "<M>"), ("aa", "bc", "de")):
        with pytest.raises(ValueError):
            fim.Plan(*marks)


def test_very_long_lines_and_many_lines(spark):
    one, many = "x" * 3_000_000, "ab\n" * 300_000
    got = {r.doc_id: r for r in fim.transformed(spark.createDataFrame([(1, one), (2, many)], SCHEMA)).collect()}
    for d, t in ((1, one), (2, many)):
        assert tuple(got[d]) == brute(d, t)


def test_edges(spark, edge, empty):
    got = fim.transformed(edge).collect()
    assert len(got) == 12 and {r.form for r in got if r.doc_id in (3, 4)} == {"plain"}
    assert all((r.prefix is None) == (r.form == "plain") for r in got)
    assert fim.transformed(empty).count() == 0
    plan = fim.transformed(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
