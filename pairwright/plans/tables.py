"""Logical tables of the pair-evidence model, derived from the stored ones; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn
from .registry import cte


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_IMAGE_COLUMNS = """
  vec_id AS image_id, CAST(label AS BIGINT) AS identity, 'img_' || lpad(CAST(vec_id AS {s}), 6, '0') AS name,
  CAST((vec_id * 37) % 101 AS DOUBLE) / 100 AS sharp, CAST((vec_id * 17) % 23 AS DOUBLE) / 100 AS clip,
  200 + (vec_id * 131) % 1400 AS width, 150 + (vec_id * 89) % 1100 AS height,
  CASE vec_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'front' ELSE 'unknown' END AS side,
  CAST((vec_id * 29) % 100 AS DOUBLE) / 100 AS visible, 'site_' || CAST(vec_id % 7 AS {s}) AS site,
  CASE WHEN vec_id % 3 = 0 THEN 'urban' ELSE 'wild' END AS domain,
  CASE WHEN vec_id % 5 = 0 THEN 'lynx-wild' WHEN vec_id % 3 = 0 THEN 'bobcat-urban' ELSE 'bobcat-wild' END AS scope,
  CASE WHEN vec_id % 5 = 0 THEN 'lynx' ELSE 'bobcat' END AS species,
  vec_id % 19 = 0 AS failed
"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id is not null")
    cols = [c.strip() for c in _split(_IMAGE_COLUMNS.format(s="STRING"))]
    return e.selectExpr(*cols, "CAST(embedding AS ARRAY<DOUBLE>) AS v")


def _split(text: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


cte("images", "SELECT " + _IMAGE_COLUMNS.format(s="VARCHAR") + ", CAST(embedding AS DOUBLE[]) AS v FROM embeddings")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, v: what the first descriptor searches, as stored."""
    return table(spark, sf, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def halves(spark: SparkSession, sf: str) -> DataFrame:
    """id, v: what the second descriptor takes the direction of."""
    return vectors(spark, sf).withColumn("v", F.slice("v", 1, 32))


def memberships(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Directed candidates of two descriptors: descriptor, query, candidate, similarity, rank."""
    mega = knn.knn(vectors(spark, sf), k).withColumn("descriptor", F.lit("mega"))
    return mega.unionByName(knn.knn(halves(spark, sf), k, unit=True).withColumn("descriptor", F.lit("dino"))).select("descriptor", "query", "candidate", "similarity", "rank")


cte("halves", "SELECT image_id, list_transform(v[1:32], lambda x: x / sqrt(list_inner_product(v[1:32], v[1:32]))) AS h FROM images", "images")
cte(
    "memberships",
    """
SELECT descriptor, query, candidate, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY descriptor, query ORDER BY similarity DESC, candidate) AS rank FROM (
    SELECT 'mega' AS descriptor, a.image_id AS query, b.image_id AS candidate, round(list_inner_product(a.v, b.v), 6) AS similarity
    FROM images a JOIN images b ON a.image_id <> b.image_id
    UNION ALL
    SELECT 'dino', a.image_id, b.image_id, round(list_inner_product(a.h, b.h), 6)
    FROM halves a JOIN halves b ON a.image_id <> b.image_id))
WHERE rank <= 20""",
    "images", "halves",
)


def pairs(spark: SparkSession, sf: str, members: DataFrame | None = None) -> DataFrame:
    """Canonical unordered pairs a < b with what the memberships (searched for if not given) say about them."""
    m = memberships(spark, sf) if members is None else members
    c = m.withColumn("a", F.least("query", "candidate")).withColumn("b", F.greatest("query", "candidate")).withColumn("forward", F.col("query") == F.col("a"))

    def rank(d: str, forward: bool):
        return F.min(F.when((F.col("descriptor") == d) & (F.col("forward") == forward), F.col("rank")))

    return c.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.min("rank").alias("best_rank"),
        F.countDistinct("descriptor").alias("n_descriptors"),
        F.max(F.when(F.col("descriptor") == "mega", F.col("similarity"))).alias("mega_sim"),
        F.max(F.when(F.col("descriptor") == "dino", F.col("similarity"))).alias("dino_sim"),
        rank("mega", True).alias("mega_ab"), rank("mega", False).alias("mega_ba"),
        rank("dino", True).alias("dino_ab"), rank("dino", False).alias("dino_ba"),
        F.max("similarity").alias("sim"),
    )


cte(
    "pairs",
    """
SELECT least(query, candidate) AS a, greatest(query, candidate) AS b, count(*) AS n_members, min(rank) AS best_rank,
  count(DISTINCT descriptor) AS n_descriptors,
  max(similarity) FILTER (descriptor = 'mega') AS mega_sim, max(similarity) FILTER (descriptor = 'dino') AS dino_sim,
  min(rank) FILTER (descriptor = 'mega' AND query < candidate) AS mega_ab, min(rank) FILTER (descriptor = 'mega' AND query > candidate) AS mega_ba,
  min(rank) FILTER (descriptor = 'dino' AND query < candidate) AS dino_ab, min(rank) FILTER (descriptor = 'dino' AND query > candidate) AS dino_ba,
  max(similarity) AS sim
FROM memberships GROUP BY 1, 2""",
    "memberships",
)


_EVIDENCE = """
  m.descriptor, m.query, m.candidate, m.rank, m.similarity, x.identity = y.identity AS same, x.identity AS q_identity, y.identity AS c_identity,
  least(x.width, x.height) AS q_dim, least(y.width, y.height) AS c_dim,
  x.width / CAST(x.height AS DOUBLE) AS q_aspect, y.width / CAST(y.height AS DOUBLE) AS c_aspect,
  x.side AS q_side, y.side AS c_side, x.domain AS q_domain, y.domain AS c_domain, x.scope AS q_scope, y.scope AS c_scope,
  x.species AS q_species, y.species AS c_species, x.site AS q_site, y.site AS c_site,
  x.sharp AS q_sharp, y.sharp AS c_sharp, x.visible AS q_visible, y.visible AS c_visible, x.clip AS q_clip, y.clip AS c_clip,
  0.5 * least(x.sharp, y.sharp) + 0.5 * least(x.visible, y.visible) AS reliability,
  (x.failed OR y.failed) AS failed
"""


def evidence(spark: SparkSession, sf: str, members: DataFrame | None = None) -> DataFrame:
    """Directed candidates (searched for if not given) with both endpoints' image facts (query side x, candidate side y)."""
    m, im = memberships(spark, sf) if members is None else members, images(spark, sf).drop("v")
    j = m.alias("m").join(im.alias("x"), F.col("m.query") == F.col("x.image_id")).join(im.alias("y"), F.col("m.candidate") == F.col("y.image_id"))
    return j.selectExpr(*[c.strip() for c in _split(_EVIDENCE)])


cte("evidence", "SELECT " + _EVIDENCE + " FROM memberships m JOIN images x ON m.query = x.image_id JOIN images y ON m.candidate = y.image_id", "memberships", "images")

_OUTCOME = """
  l.doc_id AS id, CAST(l.quality AS BIGINT) AS y, CAST(l.toxic AS BIGINT) AS t,
  least(0.999, greatest(0.001, CAST((l.doc_id * 7919) % 97 AS DOUBLE) / 97 * 0.8 + CAST(l.quality AS DOUBLE) * 0.15)) AS p,
  least(0.999, greatest(0.001, CAST((l.doc_id * 104729) % 89 AS DOUBLE) / 89 * 0.7 + CAST(l.quality AS DOUBLE) * 0.25)) AS p2,
  1 + l.doc_id % 3 AS w, l.doc_id % 5 AS fold, l.doc_id % 40 AS comp, l.doc_id % 23 AS a, 23 + l.doc_id % 29 AS b, d.lang AS lang, d.source AS source, d.n_chars AS n_chars
"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Adjudicated outcomes: label y (and t), two scores, weight, fold, component, endpoints a and b, strata."""
    return table(spark, sf, "labels").alias("l").join(table(spark, sf, "documents").alias("d"), F.col("l.doc_id") == F.col("d.doc_id")).selectExpr(*[c.strip() for c in _split(_OUTCOME)])


cte("outcomes", "SELECT " + _OUTCOME + " FROM labels l JOIN documents d ON l.doc_id = d.doc_id")

_REVIEW = """
  event_id, event_id % 400 AS packet, user_id % 6 AS reviewer, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'click' THEN 'review_ready' WHEN 'view' THEN 'review_ready' WHEN 'purchase' THEN 'not_review_ready' ELSE 'uncertain' END AS decision, value
"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Review log: packet, reviewer, ts, decision; several responses for each packet and reviewer."""
    return table(spark, sf, "events").selectExpr(*[c.strip() for c in _split(_REVIEW)])


cte("reviews", "SELECT " + _REVIEW + " FROM events")

_ORDERS = """
  o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_orderstatus || '__' || o_orderpriority AS cell, o_totalprice AS price, o_custkey AS cust
"""


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling frame: id, cell and its two strata, price, cust."""
    return table(spark, sf, "orders").selectExpr(*[c.strip() for c in _split(_ORDERS)])


cte("frame", "SELECT " + _ORDERS + " FROM orders")
