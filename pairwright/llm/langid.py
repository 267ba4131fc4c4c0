"""Language identification of mixed text.

Learning counts, for every language, hashed character 1- to 4-grams of words and the letters
of each script range. A word's candidates are the languages that use its script; each
candidate gets the word's mean log likelihood times a capped length, and a Viterbi pass with
a penalty for switching labels the words. The spans of equal labels are the result; the
document's language is the one with the most letters.

Defined results: a letter is a code point of Unicode category L. Null texts and texts without a
letter are `und` with score 0; letters of a script that no learned language uses leave all
languages as candidates; with no labelled rows at all every text is `und`. A tie goes to the
language that is first in order. Empty tables give no rows; repeated rows are scored alike;
texts are never cut, however long. More than MAX_LANGUAGES learned languages are refused with
an error. Only text and lang are looked at when learning, only text when predicting.
"""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mix, values

#: First code points of ranges and the script that their letters are taken for. They only narrow a word's
#: candidates; whether a code point is a letter is its Unicode category's to say.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0870, "arabic"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA8E0, "devanagari"),
    (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32400, "other"),
]
NAMES = sorted({s for _, s in SCRIPTS})
#: Of each code point: 0 for anything but a letter or mark, MARK for a combining mark, else 1 + the number of the script in NAMES.
MARK = 255
_CATEGORY = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
_KIND = np.repeat([NAMES.index(s) + 1 for _, s in SCRIPTS], np.diff([a for a, _ in SCRIPTS] + [0x110000])).astype(np.uint8)
_KIND[_CATEGORY != ord("L")] = 0
_KIND[_CATEGORY == ord("M")] = MARK
#: Hashed features of each language.
BUCKETS = 1 << 16
#: Languages that a model may hold; the tables grow with their number.
MAX_LANGUAGES = 256
#: Code points that are worked on at a time.
CHUNK = 400_000
#: Cells of (gram, language) that are added at a time.
TABLE_CELLS = 2_000_000
#: Words between Viterbi passes (a text is never cut).
PASS_WORDS = 1_000_000


class Words:
    """Runs of letters, and of combining marks between and after them, of some texts; code points folded to lower case
    where that is one code point."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        kind = _KIND[points]
        letter = (kind > 0) & (kind < MARK)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], kind > 0, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        before = np.concatenate(([0], np.cumsum(letter)))
        some = before[end] > before[start]
        start, end = start[some], end[some]
        places = np.flatnonzero(letter)
        self.start, self.end = (places[before[start]] if len(start) else start), end  # a word begins with a letter
        self.first = np.searchsorted(self.start, ends - sizes)
        self.last = np.searchsorted(self.start, ends)
        self.script = kind[self.start]
        upper = (points < len(_LOWER)) & letter
        low = points.copy()
        low[upper] = _LOWER[points[upper]]
        self.points = low
        self.length = self.end - self.start

    def grams(self):
        """(feature bucket, word number) arrays, one pair for each length of gram; a word is seen with a mark at either side."""
        n = len(self.start)
        if not n:
            return
        # copy each word with one mark before and after it
        padded = self.length + 2
        total = int(padded.sum())
        ends = np.cumsum(padded)
        begin = ends - padded
        text = np.ones(total, np.int64)
        word = np.repeat(np.arange(n, dtype=np.int32), padded)
        inside = np.ones(total, bool)
        inside[begin] = False
        inside[ends - 1] = False
        take = np.repeat(self.start, self.length) + (np.arange(int(self.length.sum())) - np.repeat(np.cumsum(self.length) - self.length, self.length))
        text[inside] = self.points[take]
        v = mix(text.astype(np.uint64))
        h = v.copy()
        for k in (1, 2, 3, 4):
            if k > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + v[k - 1 :]
            m = len(h)
            if m <= 0:
                return
            whole = word[:m] == word[k - 1 : k - 1 + m]
            if k == 1:
                whole = whole & inside[:m]
            yield (mix(h[whole] + np.uint64(k)) >> np.uint64(48)).astype(np.int64), word[:m][whole]


_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x2000)])


def _chunks(texts):
    """Lists of texts of about CHUNK code points."""
    part, total = [], 0
    for t in texts:
        if total and total + len(t) > CHUNK:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t) + 1
    if part:
        yield part


def counter(languages: list[str]):
    """mapInArrow function: labelled texts to (lang, bucket, n) sums of a task; scripts have buckets from BUCKETS on."""
    place = {x: i for i, x in enumerate(languages)}
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums = np.zeros((len(languages), BUCKETS + len(NAMES) + 1), np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for x in set(langs):
                own = [t for t, y in zip(texts, langs) if y == x and t]
                for part in _chunks(own):
                    w = Words(part)
                    for bucket, _ in w.grams():
                        sums[place[x], :BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    sums[place[x], BUCKETS:] += np.bincount(w.script, weights=w.length, minlength=len(NAMES) + 1).astype(np.int64)
        for i in range(len(languages)):
            at = np.flatnonzero(sums[i])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[i][at])], schema=schema)

    return run


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = 4.0):
        self.languages, self.penalty = languages, penalty
        seen = counts[:, :BUCKETS].astype(np.float64) + 0.5
        self.table = np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32).T.copy() if languages else None
        scripts = counts[:, BUCKETS:]
        # a language uses a script if at least one letter in 200 is of it
        uses = scripts * 200 >= np.maximum(scripts.sum(1, keepdims=True), 1)
        uses[:, ~uses.any(0)] = True
        self.uses = uses.T.copy()  # script -> languages

    def word_scores(self, w: Words) -> np.ndarray:
        """Log likelihood of each word in each language, scaled so that one word of evidence stays comparable."""
        n = len(w.start)
        out = np.zeros((n, len(self.languages)), np.float32)
        seen = np.zeros(n, np.int64)
        step = max(1, TABLE_CELLS // len(self.languages))
        for bucket, word in w.grams():
            if not len(word):
                continue
            seen += np.bincount(word, minlength=n)
            # words come in order, so the rows of a word are neighbours; they are added for all languages at once
            at = np.flatnonzero(np.diff(word, prepend=-1))
            cut = np.append(at[np.unique(np.searchsorted(at, np.arange(0, len(word), step)).clip(0, len(at) - 1))], len(word))
            for x, y in zip(cut[:-1], cut[1:]):
                own = at[np.searchsorted(at, x) : np.searchsorted(at, y)]
                out[word[own]] += np.add.reduceat(self.table[bucket[x:y]], own - x, axis=0)
        out *= (np.minimum(w.length, 8) / np.maximum(seen, 1))[:, None]
        out -= out.max(1, keepdims=True)
        out[~self.uses[w.script]] = -50.0
        return out

    def label(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Viterbi over the words of each text, all texts in step; texts in the order of their length."""
        n = last - first
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        labels = np.zeros(len(scores), np.int16)
        if not len(n) or not n[0]:
            return labels
        back = np.zeros((len(scores), scores.shape[1]), np.int16)
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
        dp = scores[first[: active[0]]].copy()
        last_dp = np.zeros((len(n), scores.shape[1]), np.float32)
        own = np.arange(scores.shape[1], dtype=np.int16)
        for t in range(1, int(n[0])):
            m = active[t]
            if m < len(dp):
                last_dp[m : len(dp)] = dp[m:]
                dp = dp[:m]
            at = first[:m] + t
            top = dp.argmax(1)
            jump = dp[np.arange(m), top] - self.penalty
            keep = dp >= jump[:, None]
            back[at] = np.where(keep, own, top[:, None].astype(np.int16))
            dp = np.where(keep, dp, jump[:, None]) + scores[at]
        last_dp[: len(dp)] = dp
        state = last_dp.argmax(1).astype(np.int16)
        for t in range(int(n[0]) - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            labels[at] = state[:m]
            state[:m] = back[at, state[:m]] if t else state[:m]
        return labels


def predictor(model: Model, carry: pa.Schema, spans: bool = False, names: tuple[str, str] = ("lang_pred", "score")):
    """mapInArrow function: adds lang_pred, score and, if asked for, spans (lang, from, to: code points) of each text."""
    fields = [*carry, pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]
    if spans:
        fields.append(pa.field("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
    schema = pa.schema(fields)

    def finish(group):
        """group: (batch, row number, Words, scores) of a pass."""
        shift = np.cumsum([0, *(len(g[1]) for g in group)])
        scores = np.concatenate([g[1] for g in group])
        group[:] = [(w, None) for w, _ in group]  # not held twice
        first = np.concatenate([g[0].first + s for g, s in zip(group, shift)])
        last = np.concatenate([g[0].last + s for g, s in zip(group, shift)])
        length = np.concatenate([g[0].length for g in group]).astype(np.float64)
        labels = model.label(scores, first, last)
        text = np.repeat(np.arange(len(first)), last - first)
        k = len(model.languages)
        mass = np.bincount(text * k + labels, weights=length, minlength=len(first) * k).reshape(-1, k)
        best = mass.argmax(1)
        total = mass.sum(1)
        share = mass[np.arange(len(best)), best] / np.maximum(total, 1)
        found = [model.languages[b] if t else "und" for b, t in zip(best, total)]
        places = []
        if spans:
            base = 0
            for w, _ in group:
                text_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in w.texts])))
                for i, (a, b) in enumerate(zip(w.first, w.last)):
                    own = labels[base + a : base + b]
                    cut = np.flatnonzero(np.diff(own)) + 1
                    edges = [0, *cut.tolist(), len(own)] if len(own) else [0]
                    places.append([{"lang": model.languages[own[x]], "start": int(w.start[a + x] - text_start[i]), "end": int(w.end[a + y - 1] - text_start[i])} for x, y in zip(edges, edges[1:])])
                base += len(w.start)
        return found, share, places

    def run(batches):
        for batch in batches:
            names, shares, places, group, words = [], [], [], [], 0
            if not model.languages:
                names, shares, places = ["und"] * len(batch), [0.0] * len(batch), [[]] * len(batch)
            else:
                for part in _chunks(t or "" for t in values(batch.column("text"))):
                    w = Words(part)
                    s = model.word_scores(w)
                    if spans:
                        w.texts = part
                        w.script = w.points = None
                    else:
                        w.start = w.end = w.script = w.points = None
                    group.append((w, s))
                    words += len(s)
                    if words >= PASS_WORDS:
                        for to, x in zip((names, shares, places), finish(group)):
                            to.extend(x)
                        group, words = [], 0
                if group:
                    for to, x in zip((names, shares, places), finish(group)):
                        to.extend(x)
            own = [batch.column(f.name) for f in carry]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(np.asarray(shares, np.float64)), *([pa.array(places, fields[-1].type)] if spans else [])], schema=schema)

    return run


def fit(rows: DataFrame, penalty: float = 4.0) -> Model:
    """Learn from all rows of (text, lang) whose lang is not null. What comes to the driver is bounded by MAX_LANGUAGES tables."""
    rows = rows.where(F.col("lang").isNotNull()).select("text", "lang")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS + len(NAMES) + 1), np.int64)
    if languages:
        sums = rows.mapInArrow(counter(languages), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        for b in sums.toArrow().to_batches():
            counts[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
    return Model(languages, counts, penalty)


def predict(docs: DataFrame, model: Model, *carry: str, spans: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns `carry`, lang_pred, score (and spans), which replace carried columns of these names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = [c for c in carry if c not in (*names, *(["spans"] if spans else []))]
    own = docs.select(*[docs[c] for c in carry])
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    tail = f"`{names[0]}` string, `{names[1]}` double" + (", spans array<struct<lang:string,start:bigint,end:bigint>>" if spans else "")
    arrow = to_arrow_schema(own.schema)
    src = docs.select(*[docs[c] for c in carry], *([] if "text" in carry else [docs["text"]]))
    return src.mapInArrow(predictor(model, arrow, spans, names), f"{head}, {tail}" if head else tail)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(4, 2)).select("text", "lang"))
    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without texts that have no letter or no language with `least` of the letters; the columns stay as they are."""
    u = uuid.uuid4().hex
    found = predict(docs, model, *docs.columns, names=(f"_l_{u}", f"_s_{u}"))
    return found.where((F.col(f"_l_{u}") != "und") & (F.col(f"_s_{u}") >= least)).drop(f"_l_{u}", f"_s_{u}")
