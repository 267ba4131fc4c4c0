"""Removal of repeated byte strings by deep-shallow suffix sorting.

Every byte that a string of `width` bytes covers is removed if that string also starts at
another place, in the same text or in another. All strings count, at every offset.

1. Sampling. Of the GRAM-byte grams inside a window of `width` bytes the one with the least
   hash is its anchor. Equal windows have their anchors at equal offsets, so it is enough
   to sort the suffixes that begin at anchors. Anchors whose gram occurs once are left out.
2. Each anchor sends its context, up to width - GRAM bytes to the left and up to `width`
   bytes to the right and never beyond its text, to the bucket of its gram. Equal contexts
   of one block of texts go once: they repeat each other.
3. A bucket sorts its suffixes: multikey quicksort on 8-byte characters to SHALLOW
   characters, then a blind trie for each group that is still tied. A node of the trie at
   depth R joins suffixes that share R bytes; sorting the node's members by their reversed
   left contexts gives each one's longest common left part L with another. If L + R reaches
   the width, the bytes from L before to R after the anchor repeat.
4. The spans of each text are merged and cut out.

Grams are compared by 64-bit hashes when choosing what to sort; what is removed follows from
compared bytes alone.

Defined results: null counts as empty; texts shorter than the width are left alone; repeated
rows repeat each other wholly; no rows give no rows; texts are looked at whole, however long.
Other columns are not looked at; carried ones with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, kept, numbered, prefix_hash, range_hash

WIDTH = 200
#: Bytes of the grams whose hashes choose the anchors.
GRAM = 64
#: 8-byte characters that multikey quicksort looks at; deeper ties go to blind tries.
SHALLOW = 4
#: Repeated gram hashes that are broadcast at most (8 bytes each); beyond it anchors meet them in a shuffled join.
MAX_BROADCAST_GRAMS = 4_000_000
#: Contexts that a bucket holds on average.
BUCKET = 40_000


# ---------------------------------------------------------------- sampling


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of h[i : i + w] for each i with a full window, by doubling."""
    m, span = h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    return m


class Bytes:
    """Texts of a block joined, a zero byte after each."""

    def __init__(self, texts: list[bytes], width: int):
        self.raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.sizes = sizes
        self.width = width

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in raw, text number, gram hash) of all anchors."""
        none = np.zeros(0, np.int64)
        n = len(self.raw)
        if n < self.width + 1:
            return none, none, none.view(np.uint64)
        self.prefix = prefix_hash(self.raw)
        at = np.arange(n - GRAM + 1)
        h = range_hash(self.prefix, at, at + GRAM)
        windows = self.width - GRAM + 1
        # the upper half orders by hash, the lower half holds the place: the least one is the first place of the least hash
        least = sliding_least((h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), windows)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        inside = self.end[text[: len(least)]] - at[: len(least)] >= self.width
        where = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(where):
            return none, none, none.view(np.uint64)
        new = np.ones(len(where), bool)
        new[1:] = where[1:] != where[:-1]
        where = where[new]
        return where, text[where], h[where]


def gram_counts(width: int):
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for _, _, texts in blocks(batch):
                _, _, h = Bytes(texts, width).anchors()
                u, c = np.unique(h, return_counts=True)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.minimum(c, 2).astype(np.int32))], schema=schema)

    return run


def gram_places(width: int):
    """(h, rid, places) for the join with repeated grams."""
    schema = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for a, b, texts in blocks(batch):
                block = Bytes(texts, width)
                where, text, h = block.anchors()
                if not len(where):
                    continue
                order = np.lexsort((where, text, h))
                where, text, h = where[order], text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                cut = np.append(np.flatnonzero(new), len(h)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(cut), pa.array((where - block.start[text]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(rid[a:b][text[new]]), places], schema=schema)

    return run


# ---------------------------------------------------------------- contexts

CONTEXTS = "bucket int, blob binary, rid bigint, start int, end int"
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("rid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of half-open spans of each text, touching ones joined."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    big = int(end.max()) + 2
    far = np.maximum.accumulate(text.astype(np.int64) * big + end)
    new = np.ones(len(text), bool)
    new[1:] = text[1:].astype(np.int64) * big + start[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], start[at], (far[last] - text[at].astype(np.int64) * big).astype(start.dtype)


def contexts(width: int, buckets: int, grams):
    """mapInArrow function: contexts of repeated anchors as one compressed blob for each bucket, and spans that are settled already.

    grams: broadcast sorted hashes, or None where the rows carry their anchors in `places`.
    """

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            known = None if grams is not None else batch.column("places").to_pylist()
            for a, b, texts in blocks(batch):
                block = Bytes(texts, width)
                if grams is not None:
                    where, text, h = block.anchors()
                    all_ = grams.value
                    at = np.minimum(np.searchsorted(all_, h), max(len(all_) - 1, 0))
                    ok = all_[at] == h if len(all_) else np.zeros(len(h), bool)
                    where, text, h = where[ok], text[ok], h[ok]
                else:
                    own = [np.asarray(p or [], np.int64) for p in known[a:b]]
                    text = np.repeat(np.arange(b - a), [len(p) for p in own])
                    where = np.concatenate(own) + block.start[text] if own else np.zeros(0, np.int64)
                    block.prefix = prefix_hash(block.raw)
                    h = range_hash(block.prefix, where, where + GRAM)
                if not len(where):
                    continue
                left = np.minimum(where - block.start[text], width - GRAM)
                right = np.minimum(block.end[text] - where, width)
                digest = range_hash(block.prefix, where - left, where + right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                order = np.lexsort((where, digest, h))
                h, digest, where, text, left, right = (x[order] for x in (h, digest, where, text, left, right))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])
                raw = block.raw.tobytes()
                begin, stop = (where - left).tolist(), (where + right).tolist()
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                again = np.flatnonzero(~new)
                unlike = [i for i, j in zip(again.tolist(), first[again].tolist()) if raw[begin[i] : stop[i]] != raw[begin[j] : stop[j]]]
                if unlike:  # a collision: all contexts of its hash go on to the sorting
                    new |= np.isin(first, first[unlike])
                group = np.cumsum(new) - 1
                many = (np.bincount(group) > 1)[group]
                settled = many & (left + right >= width)
                base = block.start[text]
                s_text, s_start, s_end = merged(text[settled], (where - left - base)[settled], (where + right - base)[settled])
                if len(s_text):
                    k = len(s_text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(rid[a:b][s_text]), pa.array(s_start.astype(np.int32)), pa.array(s_end.astype(np.int32))], schema=_CONTEXTS
                    )
                h, where, text, left, right, many = (x[new] for x in (h, where, text, left, right, many))
                bucket = (h >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                ids, blobs = [], []
                for x, y in zip(cut[:-1], cut[1:]):
                    i = order[x:y]
                    head = np.zeros(len(i), [("rid", "<i8"), ("pos", "<i4"), ("left", "<u2"), ("right", "<u2"), ("many", "?")])
                    head["rid"], head["pos"], head["left"], head["right"], head["many"] = rid[a:b][text[i]], where[i] - block.start[text[i]], left[i], right[i], many[i]
                    body = b"".join([raw[p:q] for p, q in zip((where[i] - left[i]).tolist(), (where[i] + right[i]).tolist())])
                    ids.append(int(bucket[i[0]]))
                    blobs.append(len(i).to_bytes(4, "little") + press.compress(head.tobytes() + body))
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())], schema=_CONTEXTS)

    return run


# ---------------------------------------------------------------- deep-shallow sorting


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def multikey_quicksort(keys: np.ndarray, depth: int) -> list[np.ndarray]:
    """Order the rows of keys (n x depth 8-byte characters) by three-way partitions on one character at a time.

    Returns the groups of rows that are tied on all of them, in order.
    """
    out, stack = [], [(np.arange(len(keys)), 0)]
    while stack:
        rows, d = stack.pop()
        if len(rows) < 2 or d == depth:
            if len(rows):
                out.append(rows)
            continue
        c = keys[rows, d]
        if len(rows) <= 48:  # so few are sorted on all characters left at once
            order = sorted(range(len(rows)), key=lambda i: keys[rows[i], d:depth].tolist())
            part = [rows[order[0]]]
            for i, j in zip(order, order[1:]):
                if (keys[rows[i], d:depth] == keys[rows[j], d:depth]).all():
                    part.append(rows[j])
                else:
                    out.append(np.array(part))
                    part = [rows[j]]
            out.append(np.array(part))
            continue
        pivot = np.partition(c[:: max(1, len(c) // 63)], len(c[:: max(1, len(c) // 63)]) // 2)[len(c[:: max(1, len(c) // 63)]) // 2]
        stack.append((rows[c > pivot], d))
        stack.append((rows[c == pivot], d + 1))
        stack.append((rows[c < pivot], d))
    return out


class BlindTrie:
    """Compacted trie of suffixes: a node holds its depth and its children by their branching byte (-1: the suffix ends)."""

    __slots__ = ("root", "of")

    def __init__(self, of: list[bytes]):
        self.of, self.root = of, None

    def insert(self, i: int) -> None:
        s = self.of[i]
        if self.root is None:
            self.root = [len(s), None, [i]]
            return
        node = self.root
        while node[1] is not None:  # blind descent: only branching bytes are looked at
            d = node[0]
            child = node[1].get(s[d] if d < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = self.of[node[2][0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node[2].append(i)
            return
        above, node = None, self.root
        while node[1] is not None and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        mine = s[same] if same < len(s) else -1
        leaf = [len(s), None, [i]]
        if node[1] is not None and node[0] == same:
            node[1][mine] = leaf
            return
        theirs = other[same] if same < len(other) else -1
        # node's whole subtree shares `theirs` at depth same
        branch = [same, {theirs: node, mine: leaf}, None]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch

    def nodes(self):
        """(depth, members) of every node, deepest first along each path, members in suffix order."""
        out = []
        stack = [(self.root, False)]
        members: dict[int, list[int]] = {}
        while stack:
            node, done = stack.pop()
            if node[1] is None:
                members[id(node)] = node[2]
                out.append((node[0], node[2]))
            elif not done:
                stack.append((node, True))
                stack.extend((node[1][k], False) for k in sorted(node[1], reverse=True))
            else:
                own = [i for k in sorted(node[1]) for i in members.pop(id(node[1][k]))]
                members[id(node)] = own
                out.append((node[0], own))
        return out


def repeated_in_group(rows: list[int], right: list[bytes], left: list[bytes], width: int):
    """(row, bytes to the left, bytes to the right) that repeat. left holds reversed bytes."""
    if len(rows) == 2:
        i, j = rows
        r = common(right[i], right[j])
        if r + width - GRAM >= width:
            x = common(left[i], left[j])
            if x + r >= width:
                yield i, x, r
                yield j, x, r
        return
    trie = BlindTrie(right)
    for i in rows:
        trie.insert(i)
    for depth, members in trie.nodes():
        if depth < GRAM or len(members) < 2:
            continue
        order = sorted(members, key=left.__getitem__)
        shared = [common(left[i], left[j]) for i, j in zip(order, order[1:])]
        for k, i in enumerate(order):
            x = max(shared[k - 1] if k else 0, shared[k] if k < len(shared) else 0)
            if x + depth >= width:
                yield i, x, depth


def sort_bucket(width: int):
    schema = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        heads, right, left = [], [], []
        for blob in table.column("blob").to_pylist():
            n, data = int.from_bytes(blob[:4], "little"), expand.decompress(blob[4:])
            head = np.frombuffer(data, [("rid", "<i8"), ("pos", "<i4"), ("left", "<u2"), ("right", "<u2"), ("many", "?")], n)
            at = n * head.dtype.itemsize
            for a, b in zip(head["left"].tolist(), head["right"].tolist()):
                left.append(data[at : at + a][::-1])
                right.append(data[at + a : at + a + b])
                at += a + b
            heads.append(head)
        head = np.concatenate(heads)
        size = 8 * SHALLOW
        keys = np.frombuffer(b"".join(r[:size].ljust(size, b"\0") for r in right), ">u8").reshape(-1, SHALLOW).astype(np.uint64)
        who, back, on = [], [], []
        for rows in multikey_quicksort(keys, SHALLOW):
            if len(rows) > 1:
                for i, x, r in repeated_in_group(rows.tolist(), right, left, width):
                    who.append(i)
                    back.append(x)
                    on.append(r)
        who, back, on = np.array(who, np.int64), np.array(back, np.int64), np.array(on, np.int64)
        full = np.flatnonzero(head["many"] & (head["left"].astype(int) + head["right"] >= width))
        i = np.concatenate((who, full))
        pos = head["pos"][i].astype(np.int64)
        start = pos - np.concatenate((back, head["left"][full].astype(np.int64)))
        end = pos + np.concatenate((on, head["right"][full].astype(np.int64)))
        ids, number = np.unique(head["rid"][i], return_inverse=True)
        t, s, e = merged(number.astype(np.int64), start, end)
        return pa.Table.from_arrays([pa.array(ids[t], pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], schema=schema)

    return run


# ---------------------------------------------------------------- the operator


def spans(docs: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """(rid, start, end): repeated bytes; spans of one rid may overlap. docs: rid, text."""
    spark = docs.sparkSession
    long_ = docs.where(F.octet_length("text") >= width)
    counts = long_.select("text").mapInArrow(gram_counts(width), "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n"))
    again = kept(counts.where("n >= 2"), "repeated-grams")
    distinct, total = again.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = max(32, -(-int(total or 0) // BUCKET))
    if distinct <= max_broadcast:
        held = np.sort(again.select("h").toArrow().column("h").to_numpy().view(np.uint64))
        rows = long_.select("rid", "text").mapInArrow(contexts(width, buckets, spark.sparkContext.broadcast(held)), CONTEXTS)
    else:
        places = long_.select("rid", "text").mapInArrow(gram_places(width), "h bigint, rid bigint, places array<int>").join(again.select("h"), "h", "left_semi")
        places = places.groupBy("rid").agg(F.flatten(F.collect_list("places")).alias("places"))
        rows = long_.select("rid", "text").join(places, "rid").mapInArrow(contexts(width, buckets, None), CONTEXTS)
    rows = kept(rows, "contexts")
    sorted_ = rows.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(sort_bucket(width), "rid bigint, start int, end int")
    return sorted_.unionByName(rows.where("bucket is null").select("rid", "start", "end"))


def cut(carry: pa.Schema, with_text: bool):
    fields = [*carry, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields.append(("kept_text", pa.binary()))
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                parts, at, removed, n = [], 0, 0, 0
                if starts:
                    s, e = np.array(starts), np.array(ends)
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    n, removed = len(s), int((e - s).sum())
                    for x, y in zip(s.tolist(), e.tolist()):
                        parts.append(raw[at:x])
                        at = y
                parts.append(raw[at:])
                left = b"".join(parts)
                for o, v in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carry], *[pa.array(o, schema.field(len(carry) + k).type) for k, o in enumerate(out[: 5 if with_text else 4])]], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *carry: str, width: int = WIDTH, with_text: bool = False, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """docs' columns `carry`, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = tuple(c for c in carry if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])))
    own = docs.select(*[docs[c] for c in carry])
    src = numbered(docs, *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = spans(src.select("rid", "text"), width, max_broadcast).groupBy("rid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    names = [f"_c{i}" for i in range(len(carry))]
    arrow = pa.schema([pa.field(n, f.type) for n, f in zip(names, to_arrow_schema(own.schema))])
    head = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, own.schema)]
    tail = ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string", *(["kept_text binary"] if with_text else [])]
    out = src.join(found, "rid", "left").mapInArrow(cut(arrow, with_text), ", ".join(head + tail))
    return out.withColumnsRenamed(dict(zip(names, carry)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
