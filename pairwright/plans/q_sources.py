"""Further sources and sinks as round trips through the shared folder (SRC, SNK), hash-bound inputs, image metrics."""

from __future__ import annotations

import uuid
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import models as D
from ..sources import io
from ..sources.shared import shared_folder, stored
from . import tables as T
from .registry import query

c, t = F.col, T.table


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nation(spark, sf):
    return t(spark, sf, "nation").select(c("n_nationkey").cast("string").alias("k"), c("n_name").alias("v"))


@query("SRC3_required_columns", "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def src3(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(_nation(spark, sf), p, ["k", "v"])
    return io.read_csv(spark, p, required=["k", "v"])


@query("SRC5_raw_text_keeps_blanks", "SELECT n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'NA' END AS v FROM nation")
def src5(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(_nation(spark, sf).select("k", F.when(c("k").cast("int") % 2 == 0, "").otherwise("NA").alias("v")), p, ["k", "v"])
    return io.read_csv(spark, p)


@query("SRC6_header_only", "SELECT * FROM (VALUES ('k'), ('v')) h(name)")
def src6(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(_nation(spark, sf).coalesce(1), p, ["k", "v"])
    return spark.createDataFrame([(n,) for n in io.csv_header(spark, p)], "name string")


@query("SRC7_zip_member", "SELECT row_number() OVER (ORDER BY n_nationkey) AS line, n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def src7(spark, sf):
    """The member is read, another one beside it isn't."""
    lines = io.bounded_rows(_nation(spark, sf).orderBy(c("k").cast("int")), 1000)
    held = BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("other.csv", "k,v\n-1,none\n")
        z.writestr("data/nation.csv", "\ufeffk,v\n" + "".join(f"{r['k']},{r['v']}\n" for r in lines))
    p = _path(spark, "zip") + "/archive.zip"
    io.write_bytes(spark, held.getvalue(), p)
    return io.read_zip_csv(spark, p, "data/nation.csv").select("line", c("cells")["k"].alias("k"), c("cells")["v"].alias("v"))


@query("SRC8_byte_order_mark", "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def src8(spark, sf):
    p = _path(spark, "bom")
    n = _nation(spark, sf)
    body = n.select(F.concat_ws(",", "k", "v").alias("line")).agg(F.concat(F.lit("﻿k,v\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value"))
    body.coalesce(1).write.text(p)
    return io.read_csv(spark, p).toDF("k", "v")


@query("SRC10_tsv_sample", "SELECT r_regionkey::VARCHAR AS k, r_name AS v FROM region")
def src10(spark, sf):
    p = _path(spark, "tsv")
    t(spark, sf, "region").select(c("r_regionkey").alias("k"), c("r_name").alias("v")).write.option("header", True).option("sep", "\t").csv(p)
    return io.read_csv(spark, p, sep="\t").limit(100)


@query("SRC11_camera_trap_metadata", "SELECT image_id::VARCHAR AS id, identity AS category_id, name || '.jpg' AS file_name, width, height FROM images", "images")
def src11(spark, sf):
    p = _path(spark, "coco")
    i = T.images(spark, sf)
    image = F.struct(c("image_id").cast("string").alias("id"), F.concat("name", F.lit(".jpg")).alias("file_name"), "width", "height")
    note = F.struct(c("image_id").cast("string").alias("id"), c("image_id").cast("string").alias("image_id"), c("identity").alias("category_id"))
    i.agg(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations")).coalesce(1).write.json(p)
    return io.coco_images(spark, p)


@query("SRC12_embedding_manifest", "SELECT image_id, round(sqrt(list_inner_product(h, h)), 6) AS norm FROM halves", "halves")
def src12(spark, sf):
    from ..operators import knn

    p = _path(spark, "embeddings")
    T.images(spark, sf).select("image_id", F.slice("v", 1, 32).alias("v")).write.parquet(p)
    h = spark.read.parquet(p).select("image_id", knn.normalised(c("v")).alias("h"))
    return h.select("image_id", F.round(F.sqrt(knn.cosine(c("h"), c("h"))), 6).alias("norm"))


@query("SRC18_checkpoint_scan", "SELECT a, b, best_rank FROM pairs WHERE best_rank <= 2", "pairs")
def src18(spark, sf):
    p = _path(spark, "checkpoints")
    T.pairs(spark, sf).where("best_rank <= 2").select("a", "b", "best_rank", (c("a") % 5).alias("shard")).write.partitionBy("shard").json(p)
    return io.checkpoint_rows(spark, p, "a bigint, b bigint, best_rank bigint")


@query("SNK1_strict_csv", "SELECT r_regionkey::VARCHAR AS k FROM region")
def snk1(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(t(spark, sf, "region").select(c("r_regionkey").alias("k")), p, ["k"])
    return io.read_csv(spark, p)


@query("SNK2_projecting_csv", "SELECT r_name FROM region")
def snk2(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(t(spark, sf, "region"), p, ["r_name"], strict=False)
    return io.read_csv(spark, p)


@query("SNK3_committed_write", "SELECT count(*) AS n FROM nation")
def snk3(spark, sf):
    """Spark's committer moves whole task results into place; a reader sees all of a finished write."""
    p = _path(spark, "committed")
    _nation(spark, sf).write.parquet(p)
    return spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))


@query("SNK4_atomic_json", "SELECT count(*) AS n, max(n_name) AS last, 1::BIGINT AS files FROM nation")
def snk4(spark, sf):
    """The second record takes the first one's place; nothing else is left in the folder."""
    folder = _path(spark, "json")
    n, last = _nation(spark, sf).agg(F.count(F.lit(1)), F.max("v")).first()
    io.write_json_atomic(spark, {"n": -1, "last": "a longer record that is to go" * 20}, f"{folder}/record.json")
    io.write_json_atomic(spark, {"n": n, "last": last}, f"{folder}/record.json")
    files = io.list_files(spark, folder).count()
    return io.read_json(spark, f"{folder}/record.json", "n bigint, last string", lines=False).select("n", "last", F.lit(files).cast("bigint").alias("files"))


@query("SNK5_refuses_overwrite", "SELECT true AS refused, count(*) AS n FROM nation")
def snk5(spark, sf):
    """The refused rows are others than those there, which stay."""
    p = _path(spark, "once")
    _nation(spark, sf).write.parquet(p)
    try:
        _nation(spark, sf).where("k < 5").write.mode("errorifexists").parquet(p)
        refused = False
    except Exception as e:
        refused = "already exists" in str(e).lower() or "ALREADY_EXISTS" in str(e)
    return spark.read.parquet(p).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("SNK9_markdown", "SELECT '| ' || r_regionkey::VARCHAR || ' | ' || r_name || ' |' AS line FROM region")
def snk9(spark, sf):
    text = io.markdown_table(t(spark, sf, "region").select("r_regionkey", "r_name"))
    return spark.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")


@query("SNK11_partition_checkpoints", "SELECT n_regionkey::BIGINT AS shard, count(*) AS n FROM nation GROUP BY 1")
def snk11(spark, sf):
    """One shard is written again: only its partition is replaced."""
    p = _path(spark, "parts")
    n = t(spark, sf, "nation").select("n_name", c("n_regionkey").alias("shard"))
    n.write.partitionBy("shard").parquet(p)
    n.where("shard = 1").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(p)
    return spark.read.parquet(p).groupBy(c("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("VA11_hash_bound_inputs", "SELECT * FROM (VALUES ('as declared', 0::BIGINT, 0::BIGINT), ('file added', 0, 1)) v(inputs, only_first, only_second)")
def va11(spark, sf):
    """The declared sums against the files as they are, before and after a file comes in."""
    p = _path(spark, "bound")
    n = _nation(spark, sf).coalesce(1)
    n.write.parquet(p)
    declared, before = stored(io.checksums(spark, p)), stored(io.checksums(spark, p))
    n.where("k < 5").write.mode("append").parquet(p)
    found = {"as declared": before, "file added": io.checksums(spark, p)}
    return A.union_all([A.same_rows(declared, f).select(F.lit(k).alias("inputs"), "*") for k, f in found.items()])


@query("SC32_image_metrics")
def sc32(spark, sf):
    """Each embedding as an 8 x 8 grey image."""
    i = T.images(spark, sf).select("image_id", F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * x))).cast("bigint")), 2, "0")), "")).alias("content"))
    return D.image_metrics(i, "image_id", "content", 8)
