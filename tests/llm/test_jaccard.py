import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import jaccard_join as J

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(rows, percent):
    s = sets_of(rows)
    par = list(range(len(s)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i][1] & s[j][1])
            if both and 100 * both >= percent * (len(s[i][1]) + len(s[j][1]) - both):
                par[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(s):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(x), low.get(find(i))) for i, (d, x) in enumerate(s)), key=str)


def corpus():
    g = random.Random(7)
    rows, n = [], 0
    line = " ".join(f"c{i}" for i in range(12))
    for _ in range(25):
        w = [f"w{g.randint(0, 400)}" for _ in range(g.randint(3, 150))]
        for _ in range(g.randint(1, 5)):
            v = list(w)
            for _ in range(g.randint(0, 6)):
                v[g.randrange(len(v))] = f"e{g.randint(0, 50)}"
            rows.append((n, " ".join(v) + (" " + line if g.random() < 0.4 else "")))
            n += 1
    return rows


@pytest.mark.parametrize("stars,percent", [(4, 75), (0, 75), (0, 40)])
def test_against_brute_force(make, stars, percent):
    rows = corpus()
    got = J.near_duplicates(make([(d, t, "en", "a") for d, t in rows]), percent=percent, stars=stars).collect()
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got), key=str) == brute(rows, percent)


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = J.near_duplicates(edge).collect()
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got), key=str) == brute(rows, 75)


def test_one_of_each(edge):
    out = J.one_of_each(edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.where(F.col("doc_id").isNotNull()).collect()) == [1, 3, 4, 5, 6, 7, 9]
    assert out.where("doc_id is null").count() == 1


def test_empty(empty):
    assert J.near_duplicates(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_merged_groups_keep_every_two_members_together():
    g = random.Random(3)
    groups = [sorted(g.sample(range(90), g.randint(2, 60))) for _ in range(300)]
    table = J.lists(np.array([x for m in groups for x in m]), np.array([len(m) for m in groups]))
    out = [set(m) for m in J.merged_groups(table).column("members").to_pylist()]
    assert all(any(set(m) <= w for w in out) for m in groups) and len(out) < len(groups)


@pytest.mark.parametrize("best", [1, 8])
def test_pairs_put_off_are_found_in_the_second_pass(make, monkeypatch, best):
    monkeypatch.setattr(J, "BEST", best)
    rows = corpus()
    got = J.near_duplicates(make([(d, t, "en", "a") for d, t in rows]), percent=50, stars=0).collect()
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got), key=str) == brute(rows, 50)
