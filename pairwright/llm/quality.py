"""Quality classifier by co-training.

Two views of a document: its text (hashed words and word shapes, repetition) and its page
metadata (language, source, length, layout of lines and characters). A logistic model for
each view is fitted on the labelled rows; in each round each view scores all documents
outside these rows, names the SURE that it is surest of, and they join the other view's
training rows. Then each view is calibrated (Platt) on labelled rows kept aside, and the
calibrated views are combined by a last logistic fit on those rows.

TRAIN_ROWS bounds the labelled rows that are fitted (those of the smallest id hashes); what a
round adds is the parameter SURE, and all documents stand for choice. Every document is
scored on its whole text.

Defined results: null and empty texts have zero text features; a null source or language is
a value of its own; label rows without label or document are not used, several label rows of
an id all count; with labels of fewer than two kinds every score is the share of ones among
them (0.5 without any); where the rows kept aside, or the others, have labels of one kind only, all
rows are fitted and calibrate. Repeated rows are scored alike, and of rows with equal scores, as copies
have, one at most joins a round's training rows, that of the smallest number. Empty tables give no rows.
Of the carried columns one named score is replaced; others are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, blocks, held_out, kept, mix, numbered, prefix_hash, range_hash, stored
from .toxicity import picked

TRAIN_ROWS = 5000
#: Documents that each view names in each round.
SURE = 640
ROUNDS = 2
WORDS, SHAPES, FACTS = 512, 256, 4
TAGS, LAYOUT = 64, 8
_UPPER, _LOWER, _DIGIT, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _LOWER
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0


def tag_place(field: int, value: str | None) -> int:
    """The column of a tag, by a hash of the whole value and its field; null is a value of its own."""
    own = b"" if value is None else b"=" + value.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(b"%d" % field + own, digest_size=8).digest(), "little") % TAGS


def features(texts: list[bytes], tags: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Text view and metadata view, a row for each text."""
    n = len(texts)
    block = Block(texts, fold=False)
    raw = block.raw
    doc = np.repeat(np.arange(n), block.n_words)
    start, end = block.word_start, block.word_end
    hashes = range_hash(prefix_hash(raw), start, end)
    # a shape keeps one byte of each run of a class; other characters stay as they are
    kind = _CLASS[raw]
    shape = np.where(kind == _OTHER, raw, kind)
    turn = np.ones(len(raw), bool)
    turn[1:] = shape[1:] != shape[:-1]
    squeezed = shape[turn]
    place = np.cumsum(turn) - 1
    shapes = range_hash(prefix_hash(squeezed), place[start], place[end - 1] + 1) if len(start) else hashes
    text = np.zeros((n, WORDS + SHAPES + FACTS), np.float32)
    per = np.maximum(block.n_words, 1).astype(np.float32)[:, None]
    width = WORDS + SHAPES
    both = np.bincount(doc * width + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * width)
    both += np.bincount(doc * width + WORDS + (shapes % np.uint64(SHAPES)).astype(np.int64), minlength=n * width)
    text[:, :width] = np.sqrt(both.reshape(n, width).astype(np.float32) / per)
    order = np.lexsort((hashes, doc))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    kinds = np.bincount(doc[order][first], minlength=n)
    inside = doc[1:] == doc[:-1]  # a pair of words lies in one text
    two, doc2 = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[inside], doc[:-1][inside]
    o2 = np.lexsort((two, doc2))
    f2 = np.ones(len(o2), bool)
    f2[1:] = (two[o2][1:] != two[o2][:-1]) | (doc2[o2][1:] != doc2[o2][:-1])
    kinds2 = np.bincount(doc2[o2][f2], minlength=n)
    letters = np.bincount(doc, weights=end - start, minlength=n)
    text[:, width] = kinds / per[:, 0]
    text[:, width + 1] = kinds2 / per[:, 0]
    text[:, width + 2] = letters / per[:, 0] / 10
    text[:, width + 3] = np.log1p(block.n_words) / 10
    meta = np.zeros((n, TAGS + LAYOUT), np.float32)
    for i, own in enumerate(tags):
        for k, v in enumerate(own):
            meta[i, tag_place(k, v)] = 1
    bounds = np.stack((block.starts, block.ends), 1).ravel()
    size = np.maximum(block.ends - block.starts, 1)
    for k, mask in enumerate((kind == _UPPER, kind == _DIGIT, kind == _OTHER, kind == 0, raw == 0x0A, raw == 0x7C)):
        c = np.concatenate(([0], np.cumsum(mask)))
        meta[:, TAGS + k] = (c[block.ends] - c[block.starts]) / size * (20 if k == 4 else 5)
    del bounds
    meta[:, TAGS + 6] = np.log1p(size) / 10
    meta[:, TAGS + 7] = 1.0
    return text, meta


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4):
    """Adam from zero: deterministic. Returns (mean, scale, w, b)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / scale
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        e = (1 / (1 + np.exp(-np.clip(z @ w + b, -35, 35))) - y) * weight
        g, gb = z.T @ e.astype(np.float32) + decay * w, float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w = (w - rate * (m / c) / (np.sqrt(v / d) + 1e-8)).astype(np.float32)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return mean.astype(np.float32), scale.astype(np.float32), w, b


def logit(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w, b = model
    # summed row by row: a matrix product may round a row otherwise in another batch, and copies have one score
    return (((x - mean) / scale) * w).sum(1) + b


def joined(parts) -> tuple:
    """A model of all training rows of a view; pseudo-labels weigh less."""
    x, y = zip(*parts)
    return fit_logistic(np.concatenate(x), np.concatenate(y), np.concatenate([np.full(len(a), 1.0 if i == 0 else 0.3) for i, a in enumerate(y)]))


def calibrated(models, sides: list[np.ndarray], y: np.ndarray):
    """Platt scaling of each view and the combination of the calibrated views, on rows kept aside."""
    sides = np.stack([logit(m, v) for m, v in zip(models, sides)], 1).astype(np.float32)
    platt = [fit_logistic(sides[:, [k]], y, np.ones(len(y)), 400, 0.05, 0.0) for k in (0, 1)]
    both = np.stack([logit(p, sides[:, [k]]) for k, p in enumerate(platt)], 1).astype(np.float32)
    return platt, fit_logistic(both, y, np.ones(len(y)), 400, 0.05, 1e-3)


def combined(model, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    models, last, base = model
    if models is None:
        return np.full(len(text), base)
    sides = [logit(m, v)[:, None] for m, v in zip(models, (text, meta))]
    z = logit(last[1], np.concatenate([logit(p, s)[:, None] for p, s in zip(last[0], sides)], 1).astype(np.float32))
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _features_of(batch):
    langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    for a, b, texts in blocks(batch):
        yield features(texts, list(zip(langs[a:b], sources[a:b])))


def _extract(batches):
    for batch in batches:
        got = list(_features_of(batch))
        if not got:
            continue
        text, meta = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_y"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())],
            names=["doc_id", "_y", "text", "meta"],
        )


def _gathered(rows: DataFrame):
    """rows: doc_id, _y, text, lang, source. Ids, features of both views, _y."""
    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_y").cast("int").alias("_y"), "text", "lang", "source").mapInArrow(_extract, "doc_id bigint, _y int, text binary, meta binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("_y", "ascending"), ("text", "ascending"), ("meta", "ascending")])
    view = lambda c, w: np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(-1, w)
    return [view("text", WORDS + SHAPES + FACTS), view("meta", TAGS + LAYOUT)], got.column("_y").to_numpy().astype(np.int64)


def _logits(models):
    """mapInArrow function: (rid, text, lang, source) to (rid, logit of each view)."""

    def run(batches):
        for batch in batches:
            sides = [[logit(m, v) for m, v in zip(models, views)] for views in _features_of(batch)]
            both = [np.concatenate([s[k] for s in sides] or [np.zeros(0)]).astype(np.float64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(both[0]), pa.array(both[1])], names=["rid", "s0", "s1"])

    return run


def surest(scored: DataFrame, view: int, up: int, down: int) -> list[tuple[int, int]]:
    """(rid, 2 * view + label) of the documents that a view is surest of. Copies have one score and count once."""
    s = f"s{view}"
    one = scored.groupBy(s).agg(F.min("rid").alias("rid"))
    high = one.where(F.col(s) > 0).orderBy(F.col(s).desc()).limit(up).collect()
    low = one.where(F.col(s) < 0).orderBy(s).limit(down).collect()
    return [(r["rid"], 2 * view + 1) for r in high] + [(r["rid"], 2 * view) for r in low]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, sure: int = SURE, rounds: int = ROUNDS):
    """docs: doc_id, text, lang, source. What comes to the driver: features of `rows` labelled rows and of 2 * sure documents a round."""
    spark = docs.sparkSession
    docs = stored(docs.select("doc_id", "text", "lang", "source"))
    own = picked(labels, label, rows)
    views, y = _gathered(docs.join(F.broadcast(own), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows))
    n = len(y)
    base = float(y.mean()) if n else 0.5
    if len(set(y.tolist())) < 2:
        return None, None, base
    aside = mix(np.arange(n, dtype=np.uint64)) % np.uint64(10) < 3
    fitted = ~aside
    if len(set(y[fitted].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside = fitted = np.ones(n, bool)
    parts = [[(v[fitted], y[fitted].astype(np.float64))] for v in views]
    used = own.select(F.col("doc_id").alias("_id")).distinct()
    free = numbered(docs, "doc_id", "text", "lang", "source").join(F.broadcast(used), F.col("doc_id") == F.col("_id"), "left_anti")
    taken: list[tuple[int, int]] = []
    for r in range(rounds + 1):
        models = [joined(p) for p in parts]
        if r == rounds:
            break
        scored = kept(free.select("rid", "text", "lang", "source").mapInArrow(_logits(models), "rid bigint, s0 double, s1 double"), "quality-logits")
        gone = F.broadcast(spark.createDataFrame([(rid,) for rid, _ in taken], "rid bigint"))  # at most 2 * sure a round
        scored = scored.join(gone, "rid", "left_anti")
        up, down = max(1, int(sure * base)), max(1, int(sure * (1 - base)))
        named = [x for k in (0, 1) for x in surest(scored, k, up, down)]
        if not named:
            break
        ids = F.broadcast(spark.createDataFrame(named, "rid bigint, _y int"))
        new, what = _gathered(free.drop("doc_id").join(ids, "rid").withColumnRenamed("rid", "doc_id"))
        for k in (0, 1):
            own = what // 2 == k
            parts[1 - k].append((new[1 - k][own], (what[own] % 2).astype(np.float64)))
        taken += named
    return models, calibrated(models, [v[aside] for v in views], y[aside].astype(np.float64)), base


def score(docs: DataFrame, model, *carry: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = tuple(c for c in carry if c != "score")
    own = docs.select(*[docs[c] for c in carry])
    arrow = to_arrow_schema(own.schema)
    schema = pa.schema([*arrow, pa.field("score", pa.float64())])

    def run(batches):
        for batch in batches:
            out = [combined(model, *f) for f in _features_of(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in arrow], pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], schema=schema)

    src = docs.select(*[docs[c] for c in dict.fromkeys([*carry, "text", "lang", "source"])])
    return src.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + ["score double"]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from label rows whose crc32(doc_id as text) mod 5 is not 0. predicted: 1 if score >= 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0)))
    rows = score(docs.withColumn("held_out", held_out(5, 0)), model, "doc_id", "held_out")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
