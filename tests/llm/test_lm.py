import collections
import math
import re
import zlib

import numpy as np
import pytest

from pairwright.llm import lm_score as L
from pairwright.llm.common import held_out

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), "\0end"]


@pytest.mark.parametrize("max_words", [2_000_000, 3])
def test_base_is_exact(edge, max_words):
    docs = edge.select("doc_id", held_out(7, 2).alias("held_out"), "text")
    count = collections.Counter()
    rows = edge.collect()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted((len(tokens(r.text)), sum(count[t] > 0 for t in tokens(r.text)), round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 5)) for r in rows)
    got = L.scores(docs, docs.where("not held_out"), "doc_id", "held_out", bits=1 << 20, max_words=max_words).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score <= 1e-9 for r in got)


def test_empty_and_no_training(empty, edge):
    assert L.scores(empty, empty, "doc_id", bits=1 << 20).count() == 0
    assert {round(r.base_score, 9) for r in L.scores(edge, empty, "doc_id", bits=1 << 20).collect()} == {0.0}


def test_filter_reads_back_quantised_counts():
    import pyarrow as pa

    g = np.random.default_rng(1)
    h = g.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    q = g.integers(1, 12, 3000).astype(np.int32)
    bits = 1 << 24
    field = bytearray(bits // 8)
    seg = (h >> np.uint64(56)).astype(np.int32)
    for s in np.unique(seg):
        own = seg == s
        t = L.segment_bits(bits)(pa.table({"segment": pa.array(seg[own]), "h": pa.array(h[own].view(np.int64)), "q": pa.array(q[own])}))
        size = bits // 8 // L.SEGMENTS
        field[s * size : (s + 1) * size] = t.column("bytes")[0].as_py()
    f = L.Filter(np.frombuffer(bytes(field), np.uint8), bits)
    read = f.levels(h)
    assert (read >= q).all() and (read == q).mean() > 0.99
    assert (f.levels(g.integers(0, 1 << 63, 3000, dtype=np.uint64)) == 0).mean() > 0.99


def test_model_beats_base_on_held_out(spark):
    got = L.op2_lm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert got.s > got.b


def test_all_counts_are_in_the_filter_at_any_size(edge):
    """A filter beyond the bound of the broadcast holds the same counts as one below it."""
    few, many = ({(r.doc_id, round(r.score, 9)) for r in L.scores(edge, edge, "doc_id", bits=b).collect()} for b in (1 << 14, 1 << 26))
    assert few == many


def test_pairs_that_occur_once_count(make):
    train = make([(1, "red apple green pear", "en", "a")])
    docs = make([(1, "red apple", "en", "a"), (2, "red pear", "en", "a")])
    for bits in (1 << 26, 1):
        got = {r.doc_id: r.score for r in L.scores(docs, train, "doc_id", bits=bits).collect()}
        # START red: 0.5 + 0.5 * 2/11; red apple the same, red pear only 0.5 * 2/11; apple END: 0.5 * 2/11, pear END like START red
        seen, unseen = 0.5 + 0.5 * 2 / 11, 0.5 * 2 / 11
        assert got[1] == pytest.approx(math.log10(seen * seen * unseen), abs=1e-9)
        assert got[2] == pytest.approx(math.log10(seen * unseen * seen), abs=1e-9)


def test_a_pair_is_asked_for_once_in_a_block():
    import numpy as np

    from pairwright.llm import lm_score

    asked = []

    class Look:
        def words(self, h):
            return np.ones(len(h), np.int32)

        def pairs(self, h):
            asked.append(h)
            return np.ones(len(h), np.int32)

    texts = [b"one two one two one two three", b"one two"] * 50
    model = (np.zeros(0, np.uint64), np.zeros(0, np.int64), True, 100, 4)
    got = lm_score.rated(texts, np.arange(len(texts)), model, Look()).column("score").to_pylist()
    assert len(asked) == 1 and len(asked[0]) == len(np.unique(asked[0])) == 6
    assert got == got[:2] * 50
