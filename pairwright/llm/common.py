"""What the operators of this subpackage share: the shared folder, text helpers, hashing."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel to the executors by value, so workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: White space between words is 0x20 and 0x09 to 0x0D, nothing else.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; set only where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        # the warehouse is shared where no folder is named; a machine's own temporary folder isn't
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a stored table; the tables that were written on the way are deleted."""
    _made.append([])
    try:
        out = kept(make(), name)
    finally:
        paths = _made.pop()
    for path in paths[:-1]:  # the last one is the result's
        remove(spark, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of a plan that pass each row of a file on once at most.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
#: Files whose numbers are broadcast at most (some 150 bytes each); rows of more files are stored once with their numbers.
MAX_FILES = 100_000


def files_of(docs: DataFrame) -> list[str]:
    """The files that docs is read from row by row; none if its rows come in another way."""

    def names(plan):
        yield plan.nodeName()
        for i in range(plan.children().size()):
            yield from names(plan.children().apply(i))

    return sorted(docs.inputFiles()) if set(names(docs._jdf.queryExecution().analyzed())) <= _ROW_BY_ROW else []


def stored(docs: DataFrame) -> DataFrame:
    """docs itself if its rows come straight from files, else docs as written to the shared folder once."""
    return docs if files_of(docs) else kept(docs, "stored")


def numbered(docs: DataFrame, *columns: str | Column, name: str = "rid") -> DataFrame:
    """The columns, and a number for each row that is the same however often, in whatever splits and on whatever
    executors the row is read: its file's place among the files and its row in the file.

    Rows that don't come straight from files are stored once with their numbers.
    """
    files = files_of(docs)
    if not 0 < len(files) <= MAX_FILES:
        return kept(docs.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered")
    at, row, file, number = (f"_{x}_{uuid.uuid4().hex}" for x in ("at", "row", "file", "number"))
    meta = docs.metadataColumn("_metadata")
    plain = lambda x: re.sub("^file:/+", "file:/", x)
    own = docs.select(*columns, F.regexp_replace(meta["file_path"], "^file:/+", "file:/").alias(at), meta["row_index"].alias(row))
    places = docs.sparkSession.createDataFrame([(plain(f), i) for i, f in enumerate(files)], f"{file} string, {number} bigint")
    lost = F.raise_error(F.concat(F.lit("no number for the rows of "), F.col(at))).cast("bigint")
    rid = F.when(F.col(number).isNotNull(), F.shiftleft(F.col(number), 40) + F.col(row)).otherwise(lost)
    out = own.join(F.broadcast(places), F.col(at) == F.col(file), "left").withColumn(name, rid)
    return out.drop(at, row, file, number)


#: Row numbers that are broadcast at most (8 bytes each); beyond it they meet the rows in a shuffled join.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose numbers are in gone's column rid; the columns stay as they are. docs comes straight from files."""
    name = f"_rid_{uuid.uuid4().hex}"
    gone = kept(gone.select(F.col("rid").alias(name)).distinct(), "gone")
    n = gone.count()
    return numbered(docs, "*", name=name).join(F.broadcast(gone) if n <= MAX_BROADCAST_IDS else gone, name, "left_anti").drop(name)


#: Slots of 64 bits of a Bloom filter of hashes, one broadcast row each at most. A filter that fills up lets more rows through.
SLOTS = 1 << 20


def slot_of(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS))


def bits_of(h: Column) -> Column:
    """Two of the 64 bits of a slot."""
    one = F.lit(1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, F.pmod(F.shiftright(h, k), F.lit(64)).cast("int"))
    return bit(32).bitwiseOR(bit(40))


def likely(rows: DataFrame, h: Column, known: DataFrame, known_h: Column) -> DataFrame:
    """The rows whose hash h is in a Bloom filter of known's hashes: all that are among them and some others."""
    slot, mask, at, bits = (f"_{x}_{uuid.uuid4().hex}" for x in ("slot", "mask", "at", "bits"))
    field = known.select(slot_of(known_h).alias(at), bits_of(known_h).alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    out = rows.withColumn(slot, slot_of(h)).withColumn(mask, bits_of(h)).join(F.broadcast(field), F.col(slot) == F.col(at))
    return out.where(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask)).drop(slot, mask, at, bits)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change letters outside ASCII."""
    return F.translate(c, UPPER, LOWER)


def held_out(divisor: int, remainder: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor) == remainder


def unit(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values of cols alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


# ---------------------------------------------------------------- hashing with numpy

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _POWERS[name] = have
    return have[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """p[i] = sum over j < i of value(raw[j]) * BASE**j modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(BYTE_VALUE[raw] * powers(len(raw), BASE, "up"), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range; depends on the bytes alone."""
    down = powers(len(prefix), BASE_INVERSE, "down")
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


class Block:
    """Texts of a batch as one array of bytes, with the bounds of texts and of white-space words."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        self.n = len(texts)
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        self.raw = ASCII_LOWER[raw] if fold else raw
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        space = IS_SPACE[self.raw]
        before = np.empty(len(space), bool)
        before[0] = True
        before[1:] = space[:-1]
        self.word_start = np.flatnonzero(before & ~space)
        after = np.empty(len(space), bool)
        after[-1] = True
        after[:-1] = space[1:]
        self.word_end = np.flatnonzero(after & ~space) + 1
        self.first_word = np.searchsorted(self.word_start, self.starts)
        self.last_word = np.searchsorted(self.word_start, self.ends)
        self.n_words = self.last_word - self.first_word

    def word_hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.raw), self.word_start, self.word_end)


#: Rows of an Arrow batch of whole texts, where Spark's own setting isn't smaller.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession):
    """While texts go to workers: batches of BATCH_ROWS rows, so that neither side holds tens of MB of one. The results don't depend
    on it; another query that starts in this session meanwhile gets such batches too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def values(column, step: int = 256):
    """The values of an Arrow column, of which few are Python objects at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def blocks(batch, size: int = 2_000_000):
    """Cut an Arrow batch by bytes of text: pairs (row numbers from, to, texts as bytes)."""
    at, total, texts = 0, 0, []
    for t in values(batch.column("text")):
        t = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if total and total + len(t) > size:
            yield at, at + len(texts), texts
            at, total, texts = at + len(texts), 0, []
        texts.append(t)
        total += len(t) + 1
    if texts:
        yield at, at + len(texts), texts
