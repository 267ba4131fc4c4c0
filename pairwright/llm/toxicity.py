"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its marks: hashed
words and beginnings of words (3 to 6 characters), so that inflected forms share evidence. A
document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels:
their likelihood trains the weights, and afterwards the sentences with a high probability of
their own are the offending ones.

1. Screening: over the training rows, documents of either label are counted for each mark, by
   task and then in a shuffle. Marks stay if the log-likelihood ratio of their association with
   the label is beyond what chance gives among that many marks, and if they raise the rate of
   the label LIFT-fold.
2. Training rows become the marks of their sentences. A sentence without a mark has
   probability 0, so a document's length alone says nothing.
3. The fit maximises the likelihood of the labels with two flip rates: labels of toxic
   documents that say 0 and of clean ones that say 1. A score is the probability of label 1.

TRAIN_ROWS bounds the labelled rows that are fitted (those of the smallest id hashes, whole
texts); every document is scored on its whole text.

Defined results: a null, empty or word-free text has no marked sentence and gets the score
of all texts without one; label rows without label or without a document are not used; without
any usable label all scores are 0; several label rows of an id all count, equal ones as
often as they occur. Ids that repeat among the documents are scored row by row, and when
training TRAIN_ROWS bounds their rows too. Empty tables give no rows. Only the text is looked
at when scoring; of the carried columns one named score (or sentences) is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, blocks, held_out, kept, prefix_hash, range_hash

#: Labelled documents that are fitted at most.
TRAIN_ROWS = 20_000
#: Characters of the beginnings of words that are marks.
BEGINNINGS = (3, 4, 5, 6)
#: A mark's documents have the label at least so many times as often as all.
LIFT = 3.0
#: Marks that chance alone would let through the screening, on average.
BY_CHANCE = 0.1
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
_U = np.uint64


class Bags:
    """Texts as marks with their sentence, sentences with their text; each text ends a sentence."""

    def __init__(self, texts: list[bytes]):
        raw = ASCII_LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        # capital letters of the Latin-1 block are two bytes, the first of them 0xC3
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        raw[capital] += 0x20
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        word = _WORD[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.n, self.doc_start, self.raw = len(texts), ends - sizes, raw
        piece = np.cumsum(_STOP[raw])[self.start]
        doc = np.searchsorted(ends, self.start)
        new = np.ones(len(self.start), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        #: of each word its sentence, of each sentence its text and its bounds
        self.sentence = np.cumsum(new) - 1
        self.doc_of = doc[new]
        self.bounds = (self.start[new], self.end[np.append(np.flatnonzero(new)[1:], len(self.end)) - 1]) if len(self.end) else (self.start, self.end)

    def marks(self):
        """Pairs (word number, mark), one array pair for whole words and one for each length of beginning."""
        if not len(self.start):
            return
        prefix = prefix_hash(self.raw)
        yield np.arange(len(self.start)), range_hash(prefix, self.start, self.end)
        letter = np.flatnonzero((self.raw & 0xC0) != 0x80)  # where characters begin
        first, last = np.searchsorted(letter, self.start), np.searchsorted(letter, self.end)
        for k in BEGINNINGS:
            who = np.flatnonzero(last - first >= k)
            cut = np.append(letter, len(self.raw))[first[who] + k]
            yield who, range_hash(prefix, self.start[who], cut) ^ _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def known_marks(bags: Bags, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, place in the sorted marks), each pair once, ordered."""
    if not len(marks) or not len(bags.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(marks >> _U(48)).astype(np.int64)] = True
    out = []
    for who, h in bags.marks():
        may = seen[(h >> _U(48)).astype(np.int64)]
        who, h = who[may], h[may]
        at = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
        ok = marks[at] == h
        out.append(bags.sentence[who[ok]] * len(marks) + at[ok])
    both = np.unique(np.concatenate(out))
    return both // len(marks), both % len(marks)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) of each document; log(1 - sigmoid(z)) is -log(1 + e^z)."""
    return -np.expm1(np.bincount(doc, weights=-np.logaddexp(0, z), minlength=n))


class Model:
    """Sorted marks, their weights, the bias of a marked sentence, and the two flip rates."""

    def __init__(self, marks: np.ndarray, weights: np.ndarray, bias: float, missed: float, wrong: float):
        self.marks, self.weights, self.bias, self.missed, self.wrong = marks, weights, bias, missed, wrong

    def sentences(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Marked sentences and their logits."""
        sentence, at = known_marks(bags, self.marks)
        own, place = np.unique(sentence, return_inverse=True)
        return own, self.bias + np.bincount(place, weights=self.weights[at], minlength=len(own))

    def label(self, toxic: np.ndarray) -> np.ndarray:
        return self.wrong + (1 - self.missed - self.wrong) * toxic


def train(sentence: np.ndarray, mark: np.ndarray, doc_of: np.ndarray, y: np.ndarray, kinds: int, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4):
    """Adam on the likelihood of the labels. sentence, mark: pairs; doc_of: of each sentence. Returns weights, bias, missed, wrong."""
    most = 0.2  # flip rates stay below
    w, rest = np.zeros(kinds), np.array([-1.0, -2.5, -2.5])
    theta = np.concatenate((w, rest))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(y), 1)
    for t in range(1, epochs + 1):
        w, b, (f0, f1) = theta[:kinds], theta[kinds], most * sigmoid(theta[kinds + 1 :])
        z = b + np.bincount(sentence, weights=w[mark], minlength=len(doc_of))
        toxic = noisy_or(z, doc_of, len(y))
        q = np.clip(f1 + (1 - f0 - f1) * toxic, 1e-9, 1 - 1e-9)
        dq = np.where(y == 1, -1 / q, 1 / (1 - q))
        dz = (dq * (1 - f0 - f1) * (1 - toxic))[doc_of] * sigmoid(z)
        flips = np.array([(dq * -toxic).sum() * f0 * (1 - f0 / most), (dq * (1 - toxic)).sum() * f1 * (1 - f1 / most)])
        g = np.concatenate((np.bincount(mark, weights=dz[sentence], minlength=kinds), [dz.sum()], flips)) / n
        g[:kinds] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    f0, f1 = most * sigmoid(theta[kinds + 1 :])
    return theta[:kinds], float(theta[kinds]), float(f0), float(f1)


def picked(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, _y of at most `rows` label rows, those whose ids have the smallest hashes; stored once."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    return kept(own.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows), "labels-picked")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """The picked() label rows with their documents, stored once. Needs doc_id in both."""
    return kept(docs.select("doc_id", *[c for c in carry if c != "doc_id"]).join(F.broadcast(picked(labels, label, rows)), "doc_id"), "labels-documents")


def mark_counts(batches):
    """mapInArrow function: (text, _y) to (mark, documents, documents of label 1), summed for each block of texts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("ones", pa.int64())])
    for batch in batches:
        y = batch.column("_y").to_numpy()
        for a, b, texts in blocks(batch, 16_000_000):
            bags = Bags(texts)
            pairs = [(bags.doc_of[bags.sentence[who]], h) for who, h in bags.marks()]
            if not pairs:
                continue
            doc, h = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h)))), pa.array(np.add.reduceat(y[a:b][doc].astype(np.int64), at))], schema=schema)


def screened(rows: DataFrame, total: int, ones: int) -> np.ndarray:
    """Sorted marks that are associated with label 1."""
    p = ones / total
    counts = rows.select("text", "_y").mapInArrow(mark_counts, "h bigint, n bigint, ones bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    counts = kept(counts.where("ones > 1"), "toxicity-marks")
    a, b = F.col("ones"), F.col("n") - F.col("ones")
    c, d = F.lit(ones) - a, F.lit(total - ones) - b
    part = lambda x, among, of: F.when(x > 0, x * F.log(x * F.lit(float(total)) / (among * F.lit(float(of))))).otherwise(0.0)
    ratio = 2 * (part(a, F.col("n"), ones) + part(b, F.col("n"), total - ones) + part(c, F.lit(total) - F.col("n"), ones) + part(d, F.lit(total) - F.col("n"), total - ones))
    counts = counts.withColumn("g", ratio)
    kinds = max(counts.count(), 1)
    # a chi-square of one degree passes x with a probability of about exp(-x / 2)
    least = 2 * float(np.log(kinds / BY_CHANCE))
    got = counts.where((F.col("g") >= least) & (a / F.col("n") >= min(LIFT * p, 0.5 * (1 + p)))).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().view(_U))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    sample = labelled_sample(docs, labels, label, rows)
    total, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not ones or ones == total:
        return Model(np.zeros(0, _U), np.zeros(0), -35.0, 0.0, 1.0 if total and ones == total else 0.0)
    marks = screened(sample, total, ones)

    def extract(batches):
        schema = pa.schema([("key", pa.int64()), ("_y", pa.int32()), ("found", pa.binary())])
        for batch in batches:
            for a, b, texts in blocks(batch):
                bags = Bags(texts)
                sentence, at = known_marks(bags, marks)
                doc = bags.doc_of[sentence]
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                pairs = np.stack((sentence, at), 1).astype("<i4")
                pairs[:, 0] -= np.repeat(pairs[np.minimum(edges[:-1], max(len(pairs) - 1, 0)), 0], np.diff(edges)) if len(pairs) else 0
                found = [pairs[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), batch.column("_y").slice(a, b - a).cast(pa.int32()), pa.array(found, pa.binary())], schema=schema)

    got = sample.select(F.xxhash64("doc_id").alias("key"), "_y", "text").mapInArrow(extract, "key bigint, _y int, found binary")
    got = got.orderBy("key", "_y", "found").limit(rows).toArrow()
    y = got.column("_y").to_numpy().astype(np.int64)
    sentences, at, docs_of, shift = [], [], [], 0
    for i, blob in enumerate(got.column("found").to_pylist()):
        pairs = np.frombuffer(blob, "<i4").reshape(-1, 2)
        own, place = np.unique(pairs[:, 0], return_inverse=True)
        sentences.append(place + shift)
        at.append(pairs[:, 1])
        docs_of.append(np.full(len(own), i))
        shift += len(own)
    return Model(marks, *train(np.concatenate(sentences), np.concatenate(at), np.concatenate(docs_of), y, len(marks)))


def scorer(model: Model, carry: list[str], spans: bool = False, least: float = 0.5):
    def run(batches):
        for batch in batches:
            scores, found = [np.zeros(0)], []
            for _, _, texts in blocks(batch):
                bags = Bags(texts)
                own, z = model.sentences(bags)
                scores.append(model.label(noisy_or(z, bags.doc_of[own], bags.n)))
                if spans:
                    said: list[list[str]] = [[] for _ in texts]
                    for s in own[sigmoid(z) >= least]:
                        d = bags.doc_of[s]
                        a, b = bags.bounds[0][s] - bags.doc_start[d], bags.bounds[1][s] - bags.doc_start[d]
                        said[d].append(texts[d][a:b].decode("utf-8", "replace"))
                    found += said
            out = np.clip(np.concatenate(scores), 0, 1)
            columns = [*[batch.column(c) for c in carry], pa.array(out), *([pa.array(found, pa.list_(pa.string()))] if spans else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "score", *(["sentences"] if spans else [])])

    return run


def score(docs: DataFrame, model: Model, *carry: str, spans: bool = False) -> DataFrame:
    carry = [c for c in carry if c not in ("score", *(["sentences"] if spans else []))]
    own = docs.select(*[docs[c] for c in carry])
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema]
    src = docs.select(*[docs[c] for c in carry], *([] if "text" in carry else [docs["text"]]))
    # the screened marks, 16 bytes each; plain values, as workers can't import this module
    known = docs.sparkSession.sparkContext.broadcast((model.marks, model.weights, model.bias, model.missed, model.wrong))

    def run(batches):
        yield from scorer(Model(*known.value), carry, spans)(batches)

    return src.mapInArrow(run, ", ".join([*head, "score double", *(["sentences array<string>"] if spans else [])]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), model, "doc_id", "held_out")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
