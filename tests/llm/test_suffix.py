import collections
import hashlib
import random

import pytest

from pairwright.llm import suffix_dedup as S


def brute(texts, width):
    seen = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for x in raw:
        for i in range(len(x) - width + 1):
            seen[x[i : i + width]] += 1
    out = []
    for x in raw:
        mark = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        kept = bytes(c for c, m in zip(x, mark) if not m)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    g = random.Random(3)
    word = lambda: "".join(g.choice("abcdeé") for _ in range(g.randint(1, 7)))
    passages = [" ".join(word() for _ in range(g.randint(30, 120))) for _ in range(6)]
    out = [None, "", "short", "ab" * 400, "ab" * 300 + "c", "x" * 199, "x" * 200, "x" * 200]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(g.randint(0, 60)))]
        for _ in range(g.randint(0, 3)):
            p = g.choice(passages)
            a = g.randint(0, max(0, len(p) - 220))
            parts += [p[a : a + g.randint(150, 400)], word()]
        out.append(" ".join(parts))
    return [*out, out[20], out[20], out[21][:-1]]


@pytest.mark.parametrize("max_broadcast", [4_000_000, 0])
def test_against_brute_force(make, max_broadcast):
    own = texts()
    got = S.remove_repeats(make([(i, t, "en", "a") for i, t in enumerate(own)]), "doc_id", max_broadcast=max_broadcast).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(own, 200)


def test_kept_text_is_what_the_digest_is_of(edge):
    for r in S.remove_repeats(edge, "doc_id", with_text=True).collect():
        assert hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 and len(r.kept_text) == r.n_bytes - r.n_removed


def test_empty(empty):
    assert S.remove_repeats(empty, "doc_id").count() == 0


def test_sorting():
    import numpy as np

    g = random.Random(5)
    own = [bytes(g.choice(b"ab") for _ in range(g.randint(1, 40))) for _ in range(300)]
    keys = np.frombuffer(b"".join(x[:16].ljust(16, b"\0") for x in own), ">u8").reshape(-1, 2).astype(np.uint64)
    flat = [own[i][:16].ljust(16, b"\0") for rows in S.multikey_quicksort(keys, 2) for i in rows]
    assert flat == sorted(flat)
    trie = S.BlindTrie(own)
    for i in range(len(own)):
        trie.insert(i)
    nodes = trie.nodes()
    assert [own[i] for i in nodes[-1][1]] == sorted(own)
    for depth, members in nodes:
        assert len({own[i][:depth] for i in members}) == 1
