"""Language-model scores from a log-frequency Bloom filter.

Counting covers every training text: words and pairs of neighbouring words, hashed to 64
bits, are summed by task, sent to buckets as packed blocks and summed there. Counts are
quantised by a codebook that grows geometrically; an n-gram with the q-th value of the
codebook enters the filter q times, as (n-gram, 1) to (n-gram, q), so its count is read back
by probing until a probe fails. The filter is cut into segments by hash, pairs apart from
words and context sums; each segment is built on its own and is as large as its counts
need, so nothing stays out. Up to FILTER_BITS the filter is broadcast; beyond, blocks of
texts send the distinct n-grams that they ask for to the segments in a shuffled join and
get the counts back. Both ways give the same scores.

A text's score is the log10 probability of its words and one end under a pair model with
absolute discounting that falls back to single words with add-one smoothing; all the counts
that it uses come from probes. The base score is the exact add-one model of single words: the counts
of the most frequent words are broadcast (MAX_WORDS at most), those of all others meet
the texts in a shuffled join.

Defined results: null and empty texts hold just the end; without training texts every
probability is 1 and every score 0; repeated rows count as often as they occur and are
scored alike; without documents there are no rows; texts are scored whole, however long.
Only doc_id (for the split) and text are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, blocks, held_out, kept, mix, numbered

#: Bits of a filter that is broadcast at most (128 MB).
FILTER_BITS = 1 << 30
#: MB of the filter that come to the driver at a time.
PIECE_MB = 8
#: Segments of the pairs, and as many of words and context sums; more where there are more buckets of counts.
SEGMENTS = 256
PROBES = 5
#: Words whose exact counts are broadcast at most (12 bytes each).
MAX_WORDS = 2_000_000
#: Bytes of text for each bucket of counts.
BUCKET_BYTES = 16_000_000
#: Bytes of text that ask the segments together.
ASK_BYTES = 16_000_000
DISCOUNT = 0.5
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_W40, _W32 = np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1)
_U = np.uint64


def codebook(growth: float, first: int) -> np.ndarray:
    values, x = [first], float(first)
    while values[-1] < 1 << 62:
        x = max(x * growth, values[-1] + 1)
        values.append(int(x))
    return np.array(values[:-1], np.int64)


WORD_CODE, PAIR_CODE = codebook(1.15, 1), codebook(1.5, 1)


def sequences(texts: list[bytes]):
    """Hashed tokens of all texts, each text's ended by END: (context, token, number of tokens of each text)."""
    block = Block(texts)
    n = block.n_words + 1
    total = int(n.sum())
    ends = np.cumsum(n)
    token = np.empty(total, np.uint64)
    is_end = np.zeros(total, bool)
    is_end[ends - 1] = True
    token[is_end] = END
    token[~is_end] = block.word_hashes()
    context = np.empty(total, np.uint64)
    context[1:] = token[:-1]
    context[ends - n] = START
    return context, token, n


def pair_key(context: np.ndarray, w40: np.ndarray) -> np.ndarray:
    """The upper 24 bits, which choose bucket and segment, spread a context's pairs over 16 places at most."""
    return (mix(context + (w40 & _U(15))) & ~_W40) | (mix(context * _U(3) + w40 + _U(0xB1)) & _W40)


def word_key(w: np.ndarray) -> np.ndarray:
    return mix(w + _U(0xA0))


def kinds_key(w: np.ndarray) -> np.ndarray:
    return mix(w + _U(0xD3))


# ---------------------------------------------------------------- counting

_BLOBS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
COUNTS = "kind int, w bigint, n bigint, q int, bits binary"
_COUNTS = pa.schema([("kind", pa.int32()), ("w", pa.int64()), ("n", pa.int64()), ("q", pa.int32()), ("bits", pa.binary())])


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray | None):
    """Distinct rows of (a, b) with their summed n, ordered."""
    order = np.lexsort((b, a)) if a is not b else np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(a))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return a[at], b[at], sums


def tally(buckets: int, flush: int = 1_500_000):
    """mapInArrow function: training texts to packed counts."""

    def pack(press, ctx, w, n):
        """ctx as runs, then 5 bytes of each w, then counts; ordered by ctx."""
        new = np.ones(len(ctx), bool)
        new[1:] = ctx[1:] != ctx[:-1]
        runs = np.diff(np.append(np.flatnonzero(new), len(ctx))).astype("<u4")
        five = np.ascontiguousarray(w.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        head = np.array([len(ctx), len(runs)], "<u4").tobytes()
        return head + press.compress(ctx[new].astype("<u8").tobytes() + runs.tobytes() + np.ascontiguousarray(five.T).tobytes() + n.astype("<u4").tobytes())

    def emit(press, held):
        ctx, token = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        w, _, n = summed(token, token, None)
        starts = int((ctx == START).sum())
        w, n = np.append(w, START), np.append(n, starts)
        bucket = ((w >> _U(40)) % _U(buckets)).astype(np.int64)
        kinds, ids, blobs = [], [], []
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for x, y in zip(cut[:-1], cut[1:]):
            i = order[x:y]
            kinds.append(0)
            ids.append(int(bucket[i[0]]))
            blobs.append(np.array([len(i)], "<u4").tobytes() + press.compress(w[i].astype("<u8").tobytes() + n[i].astype("<u4").tobytes()))
        c, v, n = summed(ctx, token & _W40, None)
        bucket = segment_of(pair_key(c, v), buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for x, y in zip(cut[:-1], cut[1:]):
            i = order[x:y]
            kinds.append(1)
            ids.append(int(bucket[i[0]]))
            blobs.append(pack(press, c[i], v[i], n[i]))
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=_BLOBS)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        held, size = [], 0
        for batch in batches:
            for _, _, texts in blocks(batch):
                held.append(sequences(texts)[:2])
                size += len(held[-1][0])
                if size >= flush:
                    yield emit(press, held)
                    held, size = [], 0
        if held:
            yield emit(press, held)

    return run


def counts_of(kind: int, w: np.ndarray, n: np.ndarray, q: np.ndarray | None = None, bits: list[bytes] | None = None) -> pa.Table:
    q = np.zeros(len(w), np.int32) if q is None else q.astype(np.int32)
    bits = pa.nulls(len(w), pa.binary()) if bits is None else pa.array(bits, pa.binary())
    return pa.Table.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array(w.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64)), pa.array(q), bits], schema=_COUNTS)


def total(segments: int):
    """The sums of one bucket: counts of words (kind 0), or segments of the pairs (kind 1) with the bucket's share of each context's count of different pairs (2)."""

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        kind = table.column("kind")[0].as_py()
        cs, ws, ns = [], [], []
        for blob in table.column("blob").to_pylist():
            if kind == 0:
                m = int.from_bytes(blob[:4], "little")
                data = expand.decompress(blob[4:])
                ws.append(np.frombuffer(data, "<u8", m))
                ns.append(np.frombuffer(data, "<u4", m, 8 * m).astype(np.int64))
            else:
                m, r = (int(x) for x in np.frombuffer(blob, "<u4", 2))
                data = expand.decompress(blob[8:])
                cs.append(np.repeat(np.frombuffer(data, "<u8", r), np.frombuffer(data, "<u4", r, 8 * r)))
                five = np.frombuffer(data, np.uint8, 5 * m, 12 * r).reshape(5, m)
                eight = np.zeros((m, 8), np.uint8)
                eight[:, :5] = five.T
                ws.append(eight.view("<u8").ravel())
                ns.append(np.frombuffer(data, "<u4", m, 12 * r + 5 * m).astype(np.int64))
        w, n = np.concatenate(ws), np.concatenate(ns)
        if kind == 0:
            w, _, n = summed(w, w, n)
            return counts_of(0, w, n, np.searchsorted(WORD_CODE, n, side="right"))
        c, w, n = summed(np.concatenate(cs), w, n)
        at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        h, q = pair_key(c, w), np.searchsorted(PAIR_CODE, n, side="right")
        segment = segment_of(h, segments)
        order = np.argsort(segment, kind="stable")
        cut = np.flatnonzero(np.diff(segment[order], prepend=-1, append=-1))
        ids = segment[order][cut[:-1]].astype(np.uint64)
        fields = [filled(h[order[x:y]], q[order[x:y]]) for x, y in zip(cut[:-1], cut[1:])]
        return pa.concat_tables([counts_of(2, c[at], np.diff(np.append(at, len(c)))), counts_of(1, ids, np.diff(cut), bits=fields)])

    return run


# ---------------------------------------------------------------- the filter


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment by an item's upper bits; segments is a power of two."""
    return (h >> _U(65 - segments.bit_length())).astype(np.int64)


def places(h: np.ndarray, level: int, size):
    """Bit addresses of (item, level) in its segment of `size` bits, a row for each probe.

    Within its segment an item is known by its lower 32 bits: a segment holds some 10^5 items, so two of them are
    taken for one far more rarely than the filter errs anyway.
    """
    x = mix((h & _W32) + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    a, b = x & _W32, (x >> _U(32)) | _U(1)
    for i in range(PROBES):
        yield (((a + _U(i) * b) & _W32) * size) >> _U(32)


def filled(h: np.ndarray, q: np.ndarray, size: int = 0) -> bytes:
    """A segment of the filter; without a size as large as its counts need."""
    size = size or -(-max(64, int(q.sum() * PROBES / 0.69)) // 64) * 64
    field = np.zeros(size, bool)
    level = 1
    while len(h):
        for p in places(h, level, _U(size)):
            field[p.astype(np.int64)] = True
        level += 1
        more = q >= level
        h, q = h[more], q[more]
    return np.packbits(field, bitorder="little").tobytes()


def items(segments: int):
    """mapInArrow function: (segment, item, q) of counted words and context sums. Their segments follow those of the pairs."""
    schema = pa.schema([("segment", pa.int32()), ("h", pa.int64()), ("q", pa.int32())])

    def run(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            w, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("w", "n"))
            w = w.view(np.uint64)
            h = np.where(kind == 0, word_key(w), kinds_key(w))
            q = np.searchsorted(WORD_CODE, n, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((segment_of(h, segments) + segments).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(q)], schema=schema)

    return run


def segment_bits(bits: int = 0):
    schema = pa.schema([("segment", pa.int32()), ("bytes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        field = filled(table.column("h").to_numpy().view(np.uint64), table.column("q").to_numpy(), bits // SEGMENTS)
        return pa.Table.from_arrays([table.column("segment").slice(0, 1).combine_chunks(), pa.array([field], pa.binary())], schema=schema)

    return run


class Filter:
    """Segments one behind the other, of the same size or of `sizes` bits (0: nothing in it)."""

    def __init__(self, field: np.ndarray, bits: int, sizes: np.ndarray | None = None, segments: int = SEGMENTS):
        self.field, self.segments = field, segments
        self.sizes = np.full(segments, bits // segments, np.int64) if sizes is None else sizes
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, h: np.ndarray, first: int = 0) -> np.ndarray:
        """The quantised count of each item: probes (item, 1), (item, 2) ... until one fails."""
        segment = segment_of(h, self.segments) + first if self.segments > 1 else np.zeros(len(h), np.int64)
        out = np.zeros(len(h), np.int32)
        at, level = np.flatnonzero(self.sizes[segment] > 0), 1
        start, size = self.starts[segment[at]].astype(np.uint64), self.sizes[segment[at]].astype(np.uint64)
        while len(at):
            rest = np.arange(len(at))
            x = mix((h[at] & _W32) + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            a, b = x & _W32, (x >> _U(32)) | _U(1)
            for i in range(PROBES):
                p = start[rest] + ((((a + _U(i) * b) & _W32) * size[rest]) >> _U(32))
                hit = (self.field[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    rest, a, b = rest[hit], a[hit], b[hit]
            at, start, size = at[rest], start[rest], size[rest]
            out[at] += 1
            level += 1
        return out

    def pairs(self, h: np.ndarray) -> np.ndarray:
        return self.levels(h)

    def words(self, h: np.ndarray) -> np.ndarray:
        return self.levels(h, self.segments)


class Answers:
    """What the segments answered to one block of texts: levels of pairs and of words by item."""

    def __init__(self, asked, levels: dict):
        self.asked, expand = [], zstandard.ZstdDecompressor()
        for h, segment, cut in asked:
            level = np.zeros(len(h), np.int32)
            for x, y in zip(cut[:-1], cut[1:]):  # the answers are in the order of the items' lower bits
                level[x:y][np.argsort(h[x:y] & _W32, kind="stable")] = np.frombuffer(expand.decompress(levels[int(segment[x])]), np.uint8)
            self.asked.append((h, level))

    def pairs(self, h: np.ndarray) -> np.ndarray:
        return self.asked[0][1][np.searchsorted(self.asked[0][0], h)]

    def words(self, h: np.ndarray) -> np.ndarray:
        return self.asked[1][1][np.searchsorted(self.asked[1][0], h)]


def low(code: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, code[np.maximum(q - 1, 0)], 0).astype(np.float64)


def high(code: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, code[np.minimum(q, len(code) - 1)] - 1, 0).astype(np.float64)


# ---------------------------------------------------------------- scoring

SCORED = "rid bigint, n_tokens bigint, n_known bigint, log_sum double, score double, tail_h array<bigint>, tail_n array<int>"
_SCORED = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64()), ("tail_h", pa.list_(pa.int64())), ("tail_n", pa.list_(pa.int32()))])


def rated(texts: list[bytes], rid: np.ndarray, model, look) -> pa.RecordBatch:
    """Scores of texts. model: (words, counts, complete, N, V); look: a Filter or Answers."""
    words, counts, complete, n_all, kinds = model
    floor = float(n_all + kinds + 1)
    context, token, n = sequences(texts)
    text = np.repeat(np.arange(len(n)), n)
    u, number = np.unique(np.append(token, START), return_inverse=True)
    start_number, number = number[-1], number[:-1]
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(n) - n] = start_number
    # exact counts of the words that are broadcast
    at = np.minimum(np.searchsorted(words, u), max(len(words) - 1, 0))
    known = words[at] == u if len(words) else np.zeros(len(u), bool)
    c = np.where(known, counts[at], 0) if len(words) else np.zeros(len(u), np.int64)
    settled = known | complete
    per_word = np.where(settled, np.log10(c + 1.0), 0.0)
    log_sum = np.bincount(text, weights=per_word[number], minlength=len(n))
    n_known = np.bincount(text, weights=(c > 0)[number], minlength=len(n)).astype(np.int64)
    # the model: everything from probes
    qw, qk = (look.words(f(u)) for f in (word_key, kinds_key))
    single = (low(WORD_CODE, qw) + 1) / floor
    times = np.maximum(high(WORD_CODE, qw), 1.0)
    # a context's pairs occur as often as the word itself, so the discounts of its different pairs are what is left
    rest = np.where(qw > 0, np.clip(DISCOUNT * low(WORD_CODE, qk) / times, 1e-3, 1.0), 1.0)
    # a pair is asked for once, and pairs of a segment one after the other
    asked, place = np.unique(pair_key(context, token & _W40), return_inverse=True)
    pair = low(PAIR_CODE, look.pairs(asked))[place]
    p = np.maximum(pair - DISCOUNT, 0) / times[before] + rest[before] * single[number]
    score = np.bincount(text, weights=np.log10(np.minimum(p, 1.0)), minlength=len(n))
    loose = np.flatnonzero(~settled[number])
    if len(loose):
        t_text, t_word, t_n = summed(text[loose].astype(np.int64), number[loose].astype(np.int64), None)
        offsets = np.searchsorted(t_text, np.arange(len(n) + 1)).astype(np.int32)
        tail_h, tail_n = u[t_word].view(np.int64), t_n.astype(np.int32)
    else:
        offsets, tail_h, tail_n = np.zeros(len(n) + 1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (tail_h, tail_n)]
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n.astype(np.int64)), pa.array(n_known), pa.array(log_sum), pa.array(score), *lists], schema=_SCORED)


def scorer(model):
    """mapInArrow function with the filter broadcast. model: broadcast (model of rated, field, sizes, segments)."""

    def run(batches):
        own, field, sizes, segments = model.value
        bloom = Filter(np.frombuffer(field, np.uint8), 0, sizes, segments)
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for a, b, texts in blocks(batch, 1_000_000):
                yield rated(texts, rid[a:b], own, bloom)

    return run


def packed(batches):
    """mapInArrow function: texts as blocks that are numbered by task."""
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=1)
    schema = pa.schema([("block", pa.int64()), ("rids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
    for batch in batches:
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        for a, b, texts in blocks(batch, ASK_BYTES):
            row = [(task << 32) + k], [rid[a:b].astype("<i8").tobytes()], [np.array([len(t) for t in texts], "<i8").tobytes()], [press.compress(b"".join(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)
            k += 1


def unpacked(sizes: bytes, texts: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    whole = zstandard.ZstdDecompressor().decompress(texts)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def wanted(texts: list[bytes], segments: int):
    """What a block asks: distinct items of pairs and of words, ordered, their segments, and where each segment starts."""
    context, token, _ = sequences(texts)
    u = np.unique(np.append(token, START))
    for first, h in (0, pair_key(context, token & _W40)), (segments, np.concatenate([f(u) for f in (word_key, kinds_key)])):
        h = np.unique(h)
        segment = segment_of(h, segments) + first
        yield h, segment, np.flatnonzero(np.diff(segment, prepend=-1, append=-1))


def packed_items(press, h: np.ndarray) -> bytes:
    """The lower 32 bits of items, as differences of ordered values, a plane for each byte."""
    low32 = np.sort(h & _W32).astype("<u4")
    step = np.diff(low32, prepend=np.zeros(1, "<u4")).astype("<u4")
    return len(h).to_bytes(4, "little") + press.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked_items(expand, blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    step = np.ascontiguousarray(np.frombuffer(expand.decompress(blob[4:]), np.uint8).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(step, dtype=np.uint64)


def ask(segments: int):
    """mapInArrow function: packed blocks to (segment, block, items)."""
    schema = pa.schema([("segment", pa.int32()), ("block", pa.int64()), ("items", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, sizes, texts in zip(*(batch.column(k).to_pylist() for k in ("block", "sizes", "texts"))):
                for h, segment, cut in wanted(unpacked(sizes, texts), segments):
                    blobs = [packed_items(press, h[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(segment[cut[:-1]].astype(np.int32)), pa.array(np.full(len(blobs), block)), pa.array(blobs, pa.binary())], schema=schema)

    return run


def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
    """The levels of all that one segment is asked."""
    schema = pa.schema([("block", pa.int64()), ("segment", pa.int32()), ("levels", pa.binary())])
    press, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    blobs = [unpacked_items(expand, x) for x in asked.column("items").to_pylist()]
    if own.num_rows:
        data = own.column("bytes")[0].as_py()
        bloom = Filter(np.frombuffer(data, np.uint8), 0, np.array([len(data) * 8]), 1)
        out = [press.compress(bloom.levels(x).astype(np.uint8).tobytes()) for x in blobs]
    else:
        out = [press.compress(bytes(len(x))) for x in blobs]
    return pa.Table.from_arrays([asked.column("block"), asked.column("segment"), pa.array(out, pa.binary())], schema=schema)


def rate(model, segments: int):
    """cogroup function: one block of texts and its answers to scores."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        levels = dict(zip(answers.column("segment").to_pylist(), answers.column("levels").to_pylist()))
        out = []
        for rids, sizes, whole in zip(*(block.column(k).to_pylist() for k in ("rids", "sizes", "texts"))):
            texts = unpacked(sizes, whole)
            out.append(rated(texts, np.frombuffer(rids, "<i8"), model.value, Answers(wanted(texts, segments), levels)))
        return pa.Table.from_batches(out, schema=_SCORED)

    return run


def counted(train: DataFrame) -> tuple[DataFrame, int]:
    """Counts as total() gives them, and the number of segments. train: text."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << (max(16, -(-size // BUCKET_BYTES)) - 1).bit_length()
    segments = max(SEGMENTS, buckets)
    blobs = train.select("text").mapInArrow(tally(int(buckets)), "kind int, bucket int, blob binary")
    return kept(blobs.groupBy("kind", "bucket").applyInArrow(total(segments), COUNTS), "lm-counts"), segments


def build_filter(counts: DataFrame, segments: int) -> DataFrame:
    """segment, bytes: the filter, as large as the counts need. Segments in which nothing is are missing."""
    sums = counts.where("kind = 2").groupBy("kind", "w").agg(F.sum("n").alias("n"))
    rows = counts.where("kind = 0").select("kind", "w", "n").unionByName(sums)
    words = rows.mapInArrow(items(segments), "segment int, h bigint, q int").groupBy("segment").applyInArrow(segment_bits(), "segment int, bytes binary")
    return counts.where("kind = 1").select(F.col("w").cast("int").alias("segment"), F.col("bits").alias("bytes")).unionByName(words)


def scores(docs: DataFrame, train: DataFrame, *carry: str, bits: int = FILTER_BITS, max_words: int = MAX_WORDS) -> DataFrame:
    """docs' columns `carry`, n_tokens, n_known, train_tokens, base_score, score, which replace carried columns of these names.
    docs and train: text. bits: of a filter that is broadcast at most."""
    spark = docs.sparkSession
    counts, segments = counted(train)
    start = int(START.view(np.int64))
    words = counts.where((F.col("kind") == 0) & (F.col("w") != start))
    n_all, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    levels = {r["q"]: r["c"] for r in words.groupBy("q").agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = 1, kinds
    while held > max_words:
        held -= levels.get(least, 0)
        least += 1
    complete = least == 1
    got = words.where(F.col("q") >= least).select("w", "n").toArrow()
    w = got.column("w").to_numpy().view(np.uint64)
    order = np.argsort(w)
    base_model = w[order], got.column("n").to_numpy()[order], complete, n_all, kinds
    parts = kept(build_filter(counts, segments), "lm-filter")
    size = 8 * (parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0)
    carry = tuple(c for c in carry if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    own = numbered(docs, *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], docs["text"].alias("text"))
    if size <= bits:
        sizes = np.zeros(2 * segments, np.int64)
        for r in parts.select("segment", F.octet_length("bytes").alias("n")).collect():
            sizes[r["segment"]] = 8 * r["n"]
        field, at = bytearray(int(sizes.sum()) // 8), (np.cumsum(sizes) - sizes) // 8
        step = max(1, 2 * segments * PIECE_MB * 8_000_000 // max(int(sizes.sum()), 1))
        for k in range(0, 2 * segments, step):  # `bits` in all, some MB at a time
            for r in parts.where(F.col("segment").between(k, k + step - 1)).toLocalIterator():
                field[at[r["segment"]] : at[r["segment"]] + len(r["bytes"])] = r["bytes"]
        model = spark.sparkContext.broadcast((base_model, field, sizes, segments))
        del field
        rows = own.select("rid", "text").mapInArrow(scorer(model), SCORED)
    else:
        model = spark.sparkContext.broadcast(base_model)
        texts = kept(own.select("rid", "text").mapInArrow(packed, "block bigint, rids binary, sizes binary, texts binary"), "lm-texts")
        asked = texts.mapInArrow(ask(segments), "segment int, block bigint, items binary")
        answers = asked.groupBy("segment").cogroup(parts.groupBy("segment")).applyInArrow(answer, "block bigint, segment int, levels binary")
        rows = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate(model, segments), SCORED)
    scored = kept(rows, "lm-scores")
    if complete:
        tail = scored.select("rid", F.lit(0.0).alias("t_sum"), F.lit(0).cast("bigint").alias("t_known")).limit(0)
    else:
        rare = words.where(F.col("q") < least).select(F.col("w").alias("h"), F.col("n").alias("c"))
        loose = scored.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("rid", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("k"))
        tail = loose.join(rare, "h").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("t_sum"), F.sum("k").alias("t_known"))
    base = F.col("log_sum") + F.coalesce("t_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(float(n_all + kinds + 1))))
    full = scored.drop("tail_h", "tail_n").join(tail, "rid", "left").join(own.drop("text"), "rid")
    return full.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out(7, 2).alias("held_out"), "text")
    return scores(docs, docs.where(~F.col("held_out")), "doc_id", "held_out")
