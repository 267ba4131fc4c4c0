"""Fill-in-middle transformation by injected delimiters.

A text is cut into units by the regular expression of its unit. A delimiter is escaped
inside the text and appended after each unit; counting it counts the units, and
substring_index takes the parts between ranked delimiters: so prefix, middle and suffix are
ranges of units, found without an array of them. The parts are unescaped and assembled in
one of two orders, or the text stays plain. All steps are string functions of one row; no
row moves. Every draw is a hash of the seed and the row's id, so reruns and other splits
agree, and a row of a lost executor is made again as it was.

Defined results: a null text is empty; an empty text, and one that holds a mark, stay plain,
with no parts; a text of one unit has one empty part at least; a null id draws as an empty
id; rows with equal ids and texts are equal rows; white space and control characters stay,
the delimiter and the escape character among them. Texts are transformed whole, however
long. No rows give no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: The escape character and the delimiter: control characters, of which neither ends a unit.
ESCAPE, DELIMITER = "\x10", "\x1f"
#: Units are lines with their line ends.
LINE = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Plan:
    """Marks, unit and rates. A unit's expression leaves no character out, ends units at
    characters of its own (line ends, spaces) and takes control characters and digits for others. Of `rate` per cent of the texts a middle is taken, of `spm` per cent of these the suffix comes first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINE
    rate: int = 100
    spm: int = 50
    seed: str = "7"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for m in marks:
            # a mark may begin only where it stands: then none arises where a part meets a mark
            if len(m) < 2 or any(m[i:].startswith(o[: len(m) - i]) or o in m[1:] for o in marks for i in range(1, len(m))):
                raise ValueError("no mark may begin inside a mark")
        if len(set(marks)) < 3:
            raise ValueError("marks differ")


def escaped(c: Column) -> Column:
    """c without the delimiter; every escape character is followed by a digit."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def plain(c: Column) -> Column:
    """Reverses escaped(), and drops the delimiters between units."""
    c = F.replace(c, F.lit(DELIMITER))
    return F.replace(F.replace(c, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(c: Column, unit: str) -> Column:
    return F.regexp_replace(escaped(c), unit, "$0" + DELIMITER)


def units(c: Column) -> Column:
    """Number of units of a marked text."""
    return (F.length(c) - F.length(F.replace(c, F.lit(DELIMITER)))).cast("bigint")


def part(c: Column, first: Column, last: Column) -> Column:
    """The text of the units after the first `first` up to unit `last` of a marked text."""
    head = F.call_function("substring_index", c, F.lit(DELIMITER), last.cast("int"))
    cut = F.call_function("substring_index", head, F.lit(DELIMITER), (first - last).cast("int"))
    return plain(F.when(last > first, cut).otherwise(""))


def draw(id_: Column, k: int, seed: str) -> Column:
    """The k-th group of 8 hexadecimal digits of the sha256 of `seed:id`, as a number; k from 0."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def transformed(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix (null if plain) and output of every row. docs: doc_id, text."""
    rows = docs.select("doc_id", text_of().alias("text"), marked(text_of(), plan.unit).alias("marked"), *(draw(F.col("doc_id"), k, plan.seed).alias(f"h{k + 1}") for k in range(4)))
    rows = rows.withColumn("n", units(F.col("marked")))
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    has_mark = F.contains("text", F.lit(plan.prefix)) | F.contains("text", F.lit(plan.suffix)) | F.contains("text", F.lit(plan.middle))
    form = F.when((F.col("text") == "") | has_mark | (F.col("h3") % 100 >= plan.rate), "plain").when(F.col("h4") % 100 < plan.spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"), form.alias("form"))
    split = F.col("form") != "plain"
    parts = (("prefix", F.lit(0), F.col("lo")), ("middle", F.col("lo"), F.col("hi")), ("suffix", F.col("hi"), F.col("n")))
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(split, part(F.col("marked"), a, b)).alias(name) for name, a, b in parts))
    p, s, m = F.lit(plan.prefix), F.lit(plan.suffix), F.lit(plan.middle)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output was made from, by its form and marks alone."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, plan.middle, 1)
        return a, b, F.substr(rest, F.length(b) + len(plan.middle) + 1)

    prefix, suffix, middle = between(plan.prefix, plan.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(plan.suffix, plan.prefix)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda name: F.length(name).cast("bigint").alias(f"{name}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB makes a list of the units; the restored text is the text itself.
OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y) + 1:], '') AS c
  FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
