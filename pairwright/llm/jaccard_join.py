"""N-gram Jaccard join with signature trees.

A text's set is its distinct word n-grams; two texts link when their sets' Jaccard similarity
reaches a threshold. The result is each document's component of linked documents. All links
between different sets count: each pair is found by an exact candidate rule and verified on
the whole texts.

1. Equal sets collapse to one representative (a partial aggregation on a digest).
2. Stars: representatives with the same least hash (for several hash orders) are compared
   with the first of their group only. This joins groups of near copies in linear work.
3. Prefixes: in any fixed order of n-grams, linked sets share one of their first
   n - ceil(t * n) + 1. The order puts n-grams of heavy counters of a fixed-size sketch last. N-grams that are
   prefix members of several documents, not all of one component, become groups. Members with no
   other of a size that could link leave; groups with the same first document and nearly the
   same others become one, so few bitmaps travel.
4. Signature trees: a group's documents are leaves with token bitmaps; nodes hold the OR of
   their leaves' bitmaps, the range of sizes and of bit counts, and the component if there
   is just one. A dual traversal prunes node pairs whose maximum possible overlap is below
   what the threshold needs, or whose leaves are one component already.
5. Pairs that are left are verified; links give the components. Each document's best pairs go
   first: they join large groups of near copies, so few pairs between components are left
   for the second pass, which takes all of them in the groups where pairs were put off.

Defined results: words are white-space separated and A-Z is folded; a text of fewer words
than n is one n-gram; null, empty and word-free texts have no set, link with nothing and
are their own component; repeated rows link; a component's id is its smallest doc_id (null
only where all are null). docs must be a stored table: it is read several times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, Block, blocks, kept, mix, numbered, small_batches, stored, values, without

WORDS = 5
#: The threshold as a share of 100.
PERCENT = 75
#: Hash orders whose least n-grams make stars.
STARS = 4
#: Candidates of each document and group that are verified before all others.
BEST = 8
#: A star with more than one HOT-th of all sets is handled apart.
HOT = 256
#: Rows that one task takes whatever their keys.
FEW = 10_000
#: Counters of the sketch that finds frequent n-grams (a fixed size).
COUNTERS = 1 << 18
#: What a worker takes at a time: bytes of texts; prefix n-grams (16 bytes each) before they are packed.
PIECE_BYTES, HELD = 500_000, 250_000
#: Bytes of text for each bucket of prefixes.
BUCKET_BYTES = 8_000_000
LEAF = 8
#: Groups of one first document become one if it has no more members than this, or a quarter more than the largest of them.
SMALL_GROUP = 32
_U = np.uint64


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of all texts, ordered by text: (text number, hash)."""
    block = Block(texts)
    w = block.word_hashes()
    n = block.n_words
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    h = w.copy()
    m = len(w) - words + 1
    out_t, out_h = [], []
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(words):
            g = g * _U(0x9E3779B97F4A7C15) + h[k : k + m]
        ok = text[:m] == text[words - 1 :]
        out_t.append(text[:m][ok])
        out_h.append(mix(g[ok]))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        out_t.append(short)
        g = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n[short] > k
            at = np.minimum(block.first_word[short] + k, len(w) - 1)
            g = np.where(has, g * _U(0x9E3779B97F4A7C15) + w[at], g)
        out_h.append(mix(g + n[short].astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    t, h = np.concatenate(out_t), np.concatenate(out_h)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[new], h[new]


def bitmap_bits(n: int) -> int:
    """4 to 8 bits for each n-gram: then few n-grams share a bit, and the bound on an overlap is close to it."""
    return min(1 << 19, max(64, 1 << (4 * int(n) - 1).bit_length()))


# ---------------------------------------------------------------- one row for each document

FACTS = "rid bigint, doc_id bigint, n bigint, d1 bigint, d2 bigint, stars array<bigint>, bits binary"
_FACTS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("stars", pa.list_(pa.int64())), ("bits", pa.binary())])


def facts(words: int):
    def run(batches):
        for batch in batches:
            rid, ids = batch.column("rid"), batch.column("doc_id")
            for a, b, texts in blocks(batch, PIECE_BYTES):
                t, h = shingle_sets(texts, words)
                n = np.bincount(t, minlength=len(texts))
                first = np.cumsum(n) - n
                some = n > 0
                at = first[some]
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                stars = np.zeros((len(n), STARS), np.uint64)
                if len(at):
                    d1[some] = np.add.reduceat(mix(h + _U(1)), at)
                    d2[some] = np.bitwise_xor.reduceat(mix(h + _U(2)), at)
                    for k in range(STARS):
                        stars[some, k] = np.minimum.reduceat(mix(h + _U(101 + k)), at)
                bits = []
                for x, y in zip(first.tolist(), (first + n).tolist()):
                    field = np.zeros(bitmap_bits(y - x), bool)
                    field[(h[x:y] & _U(len(field) - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(field, bitorder="little").tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, STARS * len(n) + 1, STARS, dtype=np.int32)), pa.array(stars.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([rid.slice(a, b - a), ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, pa.array(bits, pa.binary())], schema=_FACTS)

    return run


# ---------------------------------------------------------------- verification


def linked_pairs(words: int, percent: int):
    """mapInArrow function: (a, b, text_a, text_b) to the pairs that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep, left, right, size = [], [], [], 0

            def settle(left, right):
                t, h = shingle_sets(left + right, words)
                k = len(left)
                pair = t % k
                order = np.lexsort((h, pair))
                same = (pair[order][1:] == pair[order][:-1]) & (h[order][1:] == h[order][:-1])
                both = np.bincount(pair[order][1:][same], minlength=k)
                either = np.bincount(pair, minlength=k) - both
                return (100 * both >= percent * either) & (either > 0)

            for x, y in zip(values(batch.column("text_a"), 64), values(batch.column("text_b"), 64)):
                x, y = x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass")
                if left and size + len(x) + len(y) > PIECE_BYTES:
                    keep.append(settle(left, right))
                    left, right, size = [], [], 0
                left.append(x)
                right.append(y)
                size += len(x) + len(y)
            if left:
                keep.append(settle(left, right))
            mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=schema)

    return run


def with_ids(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """texts joined with ids (column rid and others) on rid: broadcast if their checked number allows it."""
    n = ids.count()
    return texts.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, "rid", how)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link. texts: rid, text."""
    pairs = kept(pairs.select("a", "b").distinct(), "jaccard-pairs")
    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "jaccard-ids")
    own = with_ids(texts, ids, "left_semi")
    both = pairs.join(own.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    return kept(both.select("a", "b", "text_a", "text_b").mapInArrow(linked_pairs(words, percent), "a bigint, b bigint"), "jaccard-links")


def follow(rows: DataFrame, key: str, to: DataFrame) -> DataFrame:
    """rows with `key` replaced by its root where to (node, root) has one. Rows of a key that very many share aren't gathered:
    a key with more than a HOT-th of all rows is looked up in a broadcast, which has HOT rows at most."""
    to = to.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    if (number := rows.count()) <= FEW:  # no key has many rows
        return rows.join(to, F.col(key) == F.col("_node"), "left").withColumn(key, F.coalesce("_root", key)).drop("_node", "_root")
    often = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > number // HOT)
    often = kept(often.join(to, F.col("_key") == F.col("_node"), "left").select("_key", F.coalesce("_root", "_key").alias("_hot")), "component-hot")
    rows = rows.join(F.broadcast(often), F.col(key) == F.col("_key"), "left")
    other = rows.where(F.col("_key").isNull()).join(to, F.col(key) == F.col("_node"), "left").withColumn("_hot", F.coalesce("_root", key)).drop("_node", "_root")
    return rows.where(F.col("_key").isNotNull()).unionByName(other).withColumn(key, F.col("_hot")).drop("_key", "_hot")


def give_way(links: DataFrame, number: int) -> DataFrame:
    """node, root of the rows that give way in a round: each to its least neighbour, that one to its own, and so on.

    The least is the smallest number, so a star is done in two rounds; in each third round it is the smallest hash, so half of
    the rows give way, whatever the links."""
    salt = F.lit(number)
    rank = lambda x: F.struct((F.xxhash64(x, salt) if number % 3 == 2 else F.lit(0).cast("bigint")).alias("h"), F.col(x).alias("id"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(rank("b")).alias("low")).where(F.col("low") < rank("a"))
    to = kept(least.select(F.col("a").alias("node"), F.col("low.id").alias("root")), "component-ways")
    while not to.join(to.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
        to = kept(follow(to, "root", to), "component-ways")
    return to


def components(links: DataFrame) -> DataFrame:
    """rid, comp (smallest number) of all ends of links (a, b), by contraction: rows give way to others, and links go between
    those that are left. A link whose ends have become one leaves, so no later round sees it."""
    first = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "component-links")
    left, rounds = first, []
    while not left.isEmpty():
        to = give_way(left, len(rounds))
        rounds.append(to)
        moved = follow(kept(follow(left, "a", to), "component-moved"), "b", to).where("a <> b")
        left = kept(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-links")
    if not rounds:
        return first.select(F.col("a").alias("rid"), F.col("b").alias("comp"))
    whole = rounds[-1]
    for to in rounds[-2::-1]:
        whole = kept(follow(to, "root", whole).unionByName(whole), "component-roots")
    # only hashed rounds lead to others than the smallest number
    least = whole.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("comp"))
    out = follow(whole, "root", least.where("comp <> root").select(F.col("root").alias("node"), F.col("comp").alias("root"))).select(F.col("node").alias("rid"), F.col("root").alias("comp"))
    return kept(out.unionByName(least.select(F.col("root").alias("rid"), "comp")), "component-labels")


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """rid, comp of the components of known (rid, comp) and further links (a, b): only links between two of known's components
    are looked at again, as links between these."""
    labels = known.withColumnsRenamed({"rid": "node", "comp": "root"})
    ends = follow(kept(follow(links.select("a", "b"), "a", labels), "component-ends"), "b", labels)
    new = components(ends)
    moved = follow(known, "comp", new.withColumnsRenamed({"rid": "node", "comp": "root"}))
    return kept(moved.unionByName(new.join(known.select("rid"), "rid", "left_anti")), "component-labels")


# ---------------------------------------------------------------- prefixes


#: Counters of a part of the sketch; lanes whose parts are added first, so no task adds more than a 256th of the tasks' parts.
PART, LANES = 4096, 256


def sketch(words: int):
    """mapInArrow function: counts of hashed n-grams in COUNTERS counters, by parts."""
    schema = pa.schema([("lane", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, texts in blocks(batch, PIECE_BYTES):
                _, h = shingle_sets(texts, words)
                counts += np.bincount((h >> _U(46)).astype(np.int64), minlength=COUNTERS)
        press = zstandard.ZstdCompressor(level=1)
        if counts.any():
            n = COUNTERS // PART
            lane = TaskContext.get().partitionId() % LANES
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, lane, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([press.compress(counts[i : i + PART].tobytes()) for i in range(0, COUNTERS, PART)], pa.binary())], schema=schema)

    return run


def add_sketches(table: pa.Table) -> pa.Table:
    expand, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    total = np.zeros(PART, np.int64)
    for blob in table.column("blob"):
        total += np.frombuffer(expand.decompress(blob.as_py()), np.int64)
    return pa.Table.from_arrays([table.column("part").slice(0, 1).combine_chunks(), pa.array([press.compress(total.tobytes())], pa.binary())], names=["part", "blob"])


def heavy_counters(texts: DataFrame, words: int) -> np.ndarray:
    """Load of each counter that stands out from the others, else 0."""
    parts = texts.select("text").mapInArrow(sketch(words), "lane int, part int, blob binary")
    parts = parts.groupBy("lane", "part").applyInArrow(add_sketches, "part int, blob binary").groupBy("part").applyInArrow(add_sketches, "part int, blob binary").toArrow()
    loads = np.zeros((COUNTERS // PART, PART), np.int64)
    expand = zstandard.ZstdDecompressor()
    for p, b in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        loads[p] = np.frombuffer(expand.decompress(b), np.int64)
    loads = loads.ravel()
    usual = float(np.median(loads))
    return np.minimum(np.where(loads > usual + 6 * np.sqrt(usual + 1) + 8, loads, 0), np.iinfo(np.uint32).max).astype(np.uint32)


_PREFIX = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def prefixes(words: int, percent: int, buckets: int, heavy):
    """mapInArrow function: prefix n-grams of (rid, comp, text), packed by bucket."""

    def pack(press, h, number, rid, comp, n):
        """5 bytes of each hash, its document's place in a table of ids."""
        used, place = np.unique(number, return_inverse=True)
        five = np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        head = np.array([len(h), len(used)], "<u4").tobytes()
        return head + press.compress(rid[used].astype("<i8").tobytes() + comp[used].astype("<i8").tobytes() + n[used].astype("<i8").tobytes() + np.ascontiguousarray(five.T).tobytes() + place.astype("<u4").tobytes())

    def emit(press, held):
        h, number = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        rid, comp, n = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        bucket = ((h >> _U(40)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((number, bucket))
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        ids = [int(bucket[order[x]]) for x in cut[:-1]]
        blobs = [pack(press, h[order[x:y]], number[order[x:y]], rid, comp, n) for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=_PREFIX)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        load = heavy.value
        held, size, shift = [], 0, 0
        for batch in batches:
            rid, comp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rid", "comp"))
            for a, b, texts in blocks(batch, PIECE_BYTES):
                t, h = shingle_sets(texts, words)
                n = np.bincount(t, minlength=len(texts))
                order = np.lexsort((h, load[(h >> _U(46)).astype(np.int64)], t))
                rank = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                first = rank < np.repeat(n - (percent * n + 99) // 100 + 1, n)
                held.append((h[order][first], t[order][first] + shift, rid[a:b], comp[a:b], n))
                shift += b - a
                size += int(first.sum())
                if size > HELD:
                    yield emit(press, held)
                    held, size, shift = [], 0, 0
        if held:
            yield emit(press, held)

    return run


GROUPS = "members array<bigint>"


def lists(members: np.ndarray, size: np.ndarray) -> pa.Table:
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Table.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(members))], names=["members"])


def shared_prefixes(percent: int):
    """applyInArrow function: documents that share a prefix n-gram and are not all of one component, without those of a size far from all others'."""

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        parts = []
        for blob in table.column("blob").to_pylist():
            m, k = (int(x) for x in np.frombuffer(blob, "<u4", 2))
            data = expand.decompress(blob[8:])
            rid, comp, n = np.frombuffer(data, "<i8", 3 * k).reshape(3, k)
            eight = np.zeros((m, 8), np.uint8)
            eight[:, :5] = np.frombuffer(data, np.uint8, 5 * m, 24 * k).reshape(5, m).T
            place = np.frombuffer(data, "<u4", m, 24 * k + 5 * m)
            parts.append((eight.view("<u8").ravel(), rid[place], comp[place], n[place]))
        h, rid, comp, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((rid, n, h))
        h, rid, comp, n = h[order], rid[order], comp[order], n[order]
        # by size, a member has a partner if a neighbour is one
        near = np.zeros(len(h), bool)
        near[1:] = (h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:])
        alone = ~near
        alone[:-1] &= ~near[1:]
        # a chain of sizes is a group: between chains nothing links
        new = ~near[~alone]
        rid, comp = rid[~alone], comp[~alone]
        if not len(rid):
            return lists(rid, rid)
        at = np.flatnonzero(new)
        chain = np.cumsum(new)
        good = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
        size = np.diff(np.append(at, len(rid)))
        order = np.lexsort((rid, chain))
        return lists(rid[order][np.repeat(good, size)], size[good])

    return run


def merged_groups(table: pa.Table) -> pa.Table:
    """Groups of the same first document that have nearly the same members, as one; every two members of a group stay in one."""
    by_lead: dict[int, list[np.ndarray]] = {}
    column = table.column("members").combine_chunks()
    values, ends = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    for x, y in zip(ends[:-1], ends[1:]):
        by_lead.setdefault(int(values[x]), []).append(values[x:y])
    out = []
    for groups in by_lead.values():
        groups.sort(key=len, reverse=True)
        wide: list[list] = []  # [members, most members it may get]
        for g in groups:
            for w in wide[-16:]:
                both = np.union1d(w[0], g)
                if len(both) <= w[1]:
                    w[0] = both
                    break
            else:
                wide.append([g, max(SMALL_GROUP, len(g) + len(g) // 4)])
        out.extend(w[0] for w in wide)
    return lists(np.concatenate(out), np.array([len(w) for w in out]))


# ---------------------------------------------------------------- signature trees


class Node:
    __slots__ = ("low", "high", "bits", "least_bits", "comp", "kids", "rows")

    def __init__(self, low, high, bits, least_bits, comp, kids, rows):
        self.low, self.high, self.bits, self.least_bits, self.comp, self.kids, self.rows = low, high, bits, least_bits, comp, kids, rows


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, OR-folded to `size` bits; sizes are powers of two."""
    w = np.frombuffer(bits, np.uint64)
    k = size // 64
    return np.bitwise_or.reduce(w.reshape(-1, k), 0) if len(w) > k else w


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1).astype(np.int64)


class SignatureTree:
    """Leaves of up to LEAF documents in the order of their sizes; a node joins up to LEAF nodes."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, percent: int):
        self.n, self.comp, self.bits, self.count, self.percent = n, comp, bits, popcount(bits), percent
        order = np.argsort(n, kind="stable")
        level = []
        for i in range(0, len(order), LEAF):
            rows = order[i : i + LEAF]
            level.append(Node(int(n[rows].min()), int(n[rows].max()), np.bitwise_or.reduce(bits[rows], 0), int(self.count[rows].min()), self.only(comp[rows]), None, rows))
        while len(level) > 1:
            level = [self.join(level[i : i + LEAF]) for i in range(0, len(level), LEAF)]
        self.root = level[0]

    @staticmethod
    def only(c):
        return int(c[0]) if (c == c[0]).all() else None

    def join(self, kids):
        comps = {k.comp for k in kids}
        return Node(min(k.low for k in kids), max(k.high for k in kids), np.bitwise_or.reduce([k.bits for k in kids], 0), min(k.least_bits for k in kids), comps.pop() if len(comps) == 1 else None, kids, None)

    def may_link(self, a: Node, b: Node) -> bool:
        if a.comp is not None and a.comp == b.comp:
            return False
        if 100 * a.high < self.percent * b.low or 100 * b.high < self.percent * a.low:
            return False
        k = int(popcount(a.bits & b.bits))
        most = min(a.high - max(0, a.least_bits - k), b.high - max(0, b.least_bits - k))
        # overlap o links sizes x and y only if (100 + percent) * o >= percent * (x + y)
        return (100 + self.percent) * most >= self.percent * (a.low + b.low)

    def pairs(self):
        """(rows, rows, bound on the overlap as a share of both sizes) of documents that may link."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if not self.may_link(a, b):
                continue
            if a.kids is None and b.kids is None:
                i, j = (x.ravel() for x in np.meshgrid(a.rows, b.rows, indexing="ij"))
                if a is b:
                    i, j = i[i < j], j[i < j]
                ok = self.comp[i] != self.comp[j]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                k = popcount(self.bits[i] & self.bits[j])
                most = np.minimum(self.n[i] - (self.count[i] - k), self.n[j] - (self.count[j] - k))
                ok = (100 + self.percent) * most >= self.percent * (self.n[i] + self.n[j])
                yield i[ok], j[ok], most[ok] / (self.n[i] + self.n[j])[ok]
            elif b.kids is None or a.kids is not None and a is not b and a.high - a.low >= b.high - b.low:
                stack.extend((k, b) for k in a.kids)
            elif a is b:
                stack.extend((a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids)))
            else:
                stack.extend((a, k) for k in b.kids)


def distinct(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The unordered pairs (smaller id, larger id), each once."""
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[new], hi[new]


def foremost(i: np.ndarray, j: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Which pairs are among the `best` of one of their documents."""
    who, at = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-score[at], who))
    who = who[order]
    new = np.ones(len(who), bool)
    new[1:] = who[1:] != who[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
    keep = np.zeros(len(i), bool)
    keep[at[order][np.arange(len(who)) - first < best]] = True
    return keep


def tree_join(percent: int, best: int | None = None):
    """Pairs (a, b) of documents of a group that may link and are not of one component: all, or each document's best;
    then a row (null, null, gid) names a group that has others."""
    far = 1 << max(1, -(-100 // percent) - 1).bit_length()

    def run(table: pa.Table) -> pa.Table:
        gid, rid, n, comp = (table.column(k).to_numpy() for k in ("gid", "rid", "n", "comp"))
        bits = table.column("bits").to_pylist()
        order = np.lexsort((rid, gid))
        cut = np.flatnonzero(np.diff(gid[order], prepend=gid[order[0]] - 1, append=gid[order[-1]] + 1))
        out_a, out_b, put_off = [], [], set()
        for x, y in zip(cut[:-1], cut[1:]):
            rows = order[x:y]
            sizes = np.array([8 * len(bits[i]) for i in rows])
            # bitmaps grow with the sets, so those of linked sets differ by a factor of `far` at most;
            # a tree holds one size and those up to far times it, folded to it, so no bitmap fills up
            for size in np.unique(sizes):
                own = rows[(sizes >= size) & (sizes <= far * size)]
                if len(own) < 2:
                    continue
                field = np.stack([folded(bits[i], int(size)) for i in own])
                least = np.array([8 * len(bits[i]) == size for i in own])
                got = list(SignatureTree(n[own], comp[own], field, percent).pairs())
                if not got:
                    continue
                i, j, score = (np.concatenate(g) for g in zip(*got))
                ok = least[i] | least[j]  # pairs of larger sizes have a tree of their own
                if best is not None and ok.any():
                    first = foremost(i[ok], j[ok], score[ok], best)
                    if not first.all():
                        put_off.add(int(gid[rows[0]]))
                    ok[ok] = first
                out_a.append(rid[own[i[ok]]])
                out_b.append(rid[own[j[ok]]])
            if sum(map(len, out_a)) > 1_000_000:
                out_a, out_b = map(list, zip(distinct(out_a, out_b)))
        a, b = distinct(out_a, out_b)
        more = sorted(put_off)
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more, pa.int64())])]
        return pa.Table.from_arrays(columns, names=["a", "b", "gid"])

    return run


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, stars: int = STARS) -> DataFrame:
    """rid, doc_id, n, comp, component_id of every document. docs: doc_id, text; rid is the row's number as numbered() gives it."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent, stars)


def _near_duplicates(docs: DataFrame, words: int, percent: int, stars: int) -> DataFrame:
    spark = docs.sparkSession
    texts = numbered(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = kept(texts.mapInArrow(facts(words), FACTS), "jaccard-facts")
    key = ["n", "d1", "d2"]
    sets = base.where("n > 0").groupBy(*key).agg(F.min("rid").alias("rep"))
    reps = kept(base.select("rid", "n", "stars").join(sets.select(F.col("rep").alias("rid")), "rid", "left_semi"), "jaccard-sets")
    texts = texts.select("rid", "text")

    # stars
    keys = reps.select("rid", "n", F.posexplode("stars").alias("k", "star")).where(F.col("k") < stars)
    lead = kept(keys.groupBy("k", "star").agg(F.min(F.struct("rid", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-stars")
    # a star of a 256th of all sets is hot; there are 256 of each order at most, so they can be broadcast
    large = max(2, reps.count() // HOT)
    hot, cold = F.broadcast(lead.where(F.col("m") >= large)), lead.where(F.col("m") < large)
    near = keys.join(hot, ["k", "star"]).unionByName(keys.join(hot.select("k", "star"), ["k", "star"], "left_anti").join(cold, ["k", "star"])).where(F.col("lead.rid") != F.col("rid"))
    near = near.where((100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    links = verified(near.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b")), texts, words, percent)
    comp = components(links)

    # all other links: prefixes, signature trees
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, -(-size // BUCKET_BYTES)))
    heavy = spark.sparkContext.broadcast(heavy_counters(texts, words))
    # documents that are not their own component, or no representatives (comp null), are the smaller part
    odd = base.where("n > 0").select("rid").join(reps.select("rid"), "rid", "left_anti").select("rid", F.lit(True).alias("copy"), F.lit(None).cast("bigint").alias("comp"))
    odd = kept(odd.unionByName(comp.select("rid", F.lit(False).alias("copy"), "comp")), "jaccard-odd")
    rows = with_ids(texts, odd, "left").where(F.coalesce("copy", F.lit(False)) == F.lit(False)).select("rid", F.coalesce("comp", "rid").alias("comp"), "text")
    groups = rows.mapInArrow(prefixes(words, percent, buckets, heavy), "bucket int, blob binary").groupBy("bucket").applyInArrow(shared_prefixes(percent), GROUPS)
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(buckets))).groupBy("bucket").applyInArrow(merged_groups, GROUPS)
    groups = kept(groups.withColumn("gid", F.xxhash64("members")), "jaccard-groups")

    def candidates(groups: DataFrame, known: DataFrame, best: int | None) -> DataFrame:
        member = groups.select("gid", F.explode("members").alias("rid")).join(known, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        several = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
        member = kept(member.join(several, "gid", "left_semi"), "jaccard-members")
        leaves = member.join(base.select("rid", "n", "bits"), "rid").withColumn("bucket", F.pmod("gid", F.lit(max(64, 2 * buckets))))
        return kept(leaves.groupBy("bucket").applyInArrow(tree_join(percent, best), "a bigint, b bigint, gid bigint"), "jaccard-found")

    # the best candidates of each document join large groups of near copies; all that is left between components follows
    found = candidates(groups, comp, BEST)
    comp = joined(comp, verified(found.where("a is not null"), texts, words, percent))
    rest = groups.join(found.where("gid is not null").select("gid"), "gid", "left_semi")
    whole = joined(comp, verified(candidates(rest, comp, None), texts, words, percent))

    # back to the documents
    full = sets.join(whole.withColumnRenamed("rid", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    out = base.select("rid", "doc_id", *key).join(full.select(*key, "comp"), key, "left").withColumn("comp", F.coalesce("comp", "rid"))
    out = kept(out.select("rid", "doc_id", "n", "comp"), "jaccard-out")
    least = out.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return out.join(least, "comp")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id (then the first as stored); the columns stay as they are."""
    docs = stored(docs)
    found = near_duplicates(docs, words, percent)
    stays = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("stay"))
    return without(docs, found.join(stays, "comp").where(F.col("rid") != F.col("stay")).select("rid"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
