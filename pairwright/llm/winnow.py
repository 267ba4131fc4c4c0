"""Document fingerprints by winnowing.

A hash is taken of every k-gram of code points as it rolls over the text; of every window of
w hashes the smallest is chosen, of equal ones the rightmost, and its position is kept. So
two texts that share k + w - 1 consecutive code points share a chosen hash, and the positions
say where. A text is cut into pieces that overlap by k + w - 2, so each window lies whole in
one piece and the arrays of a piece stay small however long the text is.

The fingerprint of a text that joins the beginnings of two others needs only their
fingerprints and the seam: which window first chose an entry follows from the entry and the
one before it, so the windows of a beginning are a slice of the fingerprint.

Defined results: a null text is empty and has an empty fingerprint; a text of fewer than k
code points is one gram; fewer than w hashes are one window; two empty fingerprints are
alike (1), an empty one and another are not (0). In the order of descending ids null ids come
last, equal ids follow the number of their row (file and row), and the first row follows the
last; a single row is its own next. Repeated rows are documents of their own. No rows give no rows.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, numbered, text_of

#: Code points of a gram, hashes of a window (a power of 4).
GRAM, WINDOW = 16, 16
#: Windows of a piece of text; places within a piece take 10 bits.
PIECE = 512
#: Bytes of text of a range of rows, and ranges at most (some 30 bytes each): beyond it ranges grow, and sort on disk. Ranges of a task.
RANGE_BYTES, MAX_RANGES, TASK_RANGES = 1_000_000, 65_536, 4


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def marks(hashes: Column, positions: Column) -> Column:
    return F.struct(hashes.alias("hashes"), positions.alias("positions"))


def none() -> Column:
    return marks(F.array().cast("array<bigint>"), F.array().cast("array<int>"))


def _least_of_four(step: int):
    return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step), F.get(a, i + 2 * step), F.get(a, i + 3 * step)))


def _chosen(piece: Column, k: int, w: int) -> Column:
    """Of each window of a piece the smallest hash (53 bits) and its place, in one number; the larger place is the smaller number."""
    # a look ahead at every code point, that is, not at the second half of a surrogate pair
    grams = F.regexp_extract_all(piece, F.lit(f"(?s)(?=([^\\x{{DC00}}-\\x{{DFFF}}].{{{k - 1}}}))"), F.lit(1))
    grams = let(grams, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(piece)))
    least = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 11), 10) + (1023 - i))
    step = 1
    while step < w:
        least = let(least, _least_of_four(step))
        step *= 4
    return F.array_distinct(F.slice(least, 1, F.greatest(F.lit(1), F.length(piece) - (k + w - 2))))


def _place(chosen: Column) -> Column:
    return 1023 - chosen.bitwiseAND(1023).cast("int")


def marks_of(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The fingerprint of a text: hashes and positions (from 0) of the chosen grams, by position."""
    size = 4
    while size < w:
        size *= 4
    if size != w or w > PIECE:
        raise ValueError("a window is 4, 16, 64 or 256 hashes")
    overlap = k + w - 2
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    after = lambda c, i: [F.left(F.coalesce(F.get(c, i + j), F.lit("")), F.lit(min(PIECE, overlap - (j - 1) * PIECE))) for j in range(1, 1 + -(-overlap // PIECE))]
    pieces = let(cut, lambda c: F.transform(c, lambda x, i: F.concat(x, *after(c, i))))
    # what is left after the last whole window lies in the piece before
    pieces = F.filter(pieces, lambda p, i: (i == 0) | (F.length(p) > overlap))
    chosen = F.transform(pieces, lambda p: _chosen(p, k, w))
    # a piece may begin with the mark that the piece before it ends with
    again = lambda c, i: _place(F.get(c, i - 1)[F.size(F.get(c, i - 1)) - 1]) == _place(F.get(c, i)[0]) + PIECE
    apart = let(chosen, lambda c: F.transform(c, lambda x, i: F.when((i > 0) & again(c, i), F.slice(x, 2, F.size(x))).otherwise(x)))
    hashes = lambda c: F.flatten(F.transform(c, lambda x: F.transform(x, lambda v: F.shiftright(v, 10))))
    positions = lambda c: F.flatten(F.transform(c, lambda x, i: let(i * PIECE, lambda at: F.transform(x, lambda v: at + _place(v)))))
    return let(apart, lambda c: marks(hashes(c), positions(c)))


def first_windows(fp: Column, count: Column, w: int = WINDOW) -> Column:
    """How many marks the first `count` windows choose, of a text of more than one window.

    A mark is first chosen when it enters the window, if it beats the mark before it, else when that one leaves. So only marks
    that begin in the w - 1 places from `count` on have to be looked at."""
    h, p = fp["hashes"], fp["positions"]
    since = lambda j: F.when(F.get(h, j) <= F.get(h, j - 1), F.get(p, j) - w + 1).otherwise(F.get(p, j - 1) + 1)
    sure = F.size(F.filter(p, lambda x: x < count))
    near = lambda n: F.when(n < F.size(p), F.sequence(n, F.least(n + w - 1, F.size(p) - 1))).otherwise(F.array().cast("array<int>"))
    return let(sure, lambda n: n + F.size(F.filter(near(n), lambda j: (j == 0) | (since(j) < count))))


def spliced(head: Column, head_marks: Column, tail: Column, tail_marks: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The marks of head + tail. head_marks and tail_marks are those of texts that begin with head and with tail."""
    t = k + w - 1

    def joined(x: Column) -> Column:
        h, b, a, c = x["h"], x["b"], x["a"], x["c"]
        long = h >= t
        seam = F.when(long, F.concat(F.substring(head, -(t - 1), t - 1), F.left(tail, F.lit(t - 1)))).otherwise(F.concat(head, tail))
        first = F.when(long, let(first_windows(a, h - t + 1, w), lambda n: marks(F.slice(a["hashes"], 1, n), F.slice(a["positions"], 1, n)))).otherwise(none())
        before = F.greatest(F.lit(0), h - (t - 1))
        middle = F.when(long & (b == 0), none()).otherwise(let(marks_of(seam, k, w), lambda m: marks(m["hashes"], F.transform(m["positions"], lambda p: p + before))))
        last = F.when(long & (b >= t), let(first_windows(c, b - t + 1, w), lambda n: marks(F.slice(c["hashes"], 1, n), F.transform(F.slice(c["positions"], 1, n), lambda p: p + h)))).otherwise(none())
        return let(F.struct(first.alias("first"), middle.alias("middle"), last.alias("last")), lambda y: _appended(_appended(y["first"], y["middle"]), y["last"]))

    # what is counted or read here isn't counted or read again for each mark
    return let(F.struct(F.length(head).alias("h"), F.length(tail).alias("b"), head_marks.alias("a"), tail_marks.alias("c")), joined)


def _appended(a: Column, b: Column) -> Column:
    """Marks a, then b without its first one where a ends with it."""

    def join(x: Column) -> Column:
        a, b = x["a"], x["b"]
        same = F.element_at(a["positions"], F.when(F.size(a["positions"]) > 0, F.lit(-1)).otherwise(None)) == F.get(b["positions"], F.lit(0))
        start = F.when(same, 2).otherwise(1)
        put = lambda c: F.concat(a[c], F.slice(b[c], start, F.size(b[c])))
        return marks(put("hashes"), put("positions"))

    return let(F.struct(a.alias("a"), b.alias("b")), join)


def likeness(a: Column, b: Column) -> Column:
    """Share of the different hashes of both that both have."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def shared(a: Column, b: Column) -> Column:
    """(hash, pos_a, pos_b): the first places of each hash that two fingerprints share."""
    at = lambda x, h: F.get(x["positions"], F.array_position(x["hashes"], h).cast("int") - 1)
    return F.transform(F.array_intersect(a["hashes"], b["hashes"]), lambda h: F.struct(h.alias("hash"), at(a, h).alias("pos_a"), at(b, h).alias("pos_b")))


def rendered(fp: Column) -> Column:
    """sha256 of all hashes and positions."""
    return F.sha2(F.concat_ws("@", fp["hashes"].cast("string"), fp["positions"].cast("string")).cast("binary"), 256)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes, positions of every row."""
    return docs.select("doc_id", F.length(text_of()).cast("bigint").alias("n_chars"), marks_of(text_of(), k, w).alias("fp")).select("doc_id", "n_chars", "fp.*")


def ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """rid, doc_id, text, key, range, guest: rows in ranges of descending ids. The first row of a range is also a guest at
    the end of the range before it, that of the first range at the end of the last. And the number of ranges."""
    spark = docs.sparkSession
    rows = numbered(docs, F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNull().alias("absent"), F.bitwise_not("doc_id").alias("down"), F.col("rid")))
    keys = kept(rows.select("key", F.octet_length("text").alias("bytes")), "winnow-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    number = int(min(MAX_RANGES, max(1, -(-total // RANGE_BYTES))))
    # the smallest key of each range, and no more, comes to the driver
    firsts = sorted((r[1] for r in keys.repartitionByRange(number, "key").groupBy(F.spark_partition_id()).agg(F.min("key")).collect()), key=lambda x: (x.absent, x.down or 0, x.rid))
    if not firsts:
        return rows.withColumn("range", F.lit(0)).withColumn("guest", F.lit(False)), 0
    wide = int(len(firsts) ** 0.5) + 1
    blocks = [firsts[i : i + wide] for i in range(0, len(firsts), wide)]
    kind = rows.schema["key"].dataType.simpleString()
    bounds = spark.createDataFrame([([b[0] for b in blocks], blocks)], f"_tops array<{kind}>, _blocks array<array<{kind}>>")
    at = lambda a: F.size(F.filter(a, lambda x: x <= F.col("key"))) - 1
    rows = rows.join(F.broadcast(bounds)).withColumn("_top", at(F.col("_tops"))).withColumn("_block", F.get("_blocks", F.col("_top"))).withColumn("_at", at(F.col("_block")))
    rows = rows.select("rid", "doc_id", "text", "key", (F.col("_top") * wide + F.col("_at")).alias("_range"), (F.get("_block", F.col("_at"))["rid"] == F.col("rid")).alias("_first"))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(firsts))).alias("range"), F.lit(True).alias("guest"))
    return rows.select("rid", "doc_id", "text", "key", F.inline(F.when(F.col("_first"), F.array(own, guest)).otherwise(F.array(own)))), len(firsts)


def with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, text, fp (hashes, positions) of every row, and next_text, next_fp of the next row, by descending id.

    Texts move once, to their range; fingerprints are made there, once for each row."""
    rows, number = ranged(docs)
    rows = rows.repartition(-(-number // TASK_RANGES) or 1, "range").withColumn("fp", marks_of(F.col("text"), k, w))
    order = Window.partitionBy("range").orderBy("guest", "key")
    rows = rows.select("doc_id", "guest", "text", "fp", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return rows.where(~F.col("guest")).drop("guest")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("head", F.left("text", n - half)).withColumn("tail", F.left("next_text", half))
    rows = rows.withColumn("edited", spliced(F.col("head"), F.col("fp"), F.col("tail"), F.col("next_fp")))
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"),
        F.sha2(F.concat("head", "tail").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("fp")).alias("fingerprint"), rendered(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fp.hashes"), F.col("edited.hashes")).alias("near_edited"), likeness(F.col("fp.hashes"), F.col("next_fp.hashes")).alias("near_next"),
        F.size("fp.hashes").cast("bigint").alias("n_chosen"), F.size("edited.hashes").cast("bigint").alias("edited_n_chosen"),
    )
