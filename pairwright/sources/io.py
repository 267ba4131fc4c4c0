"""Sources and sinks: typed scans, guarded writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audits import assert_exact_columns, assert_required_columns


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names alone; a byte-order mark is taken off."""
    line = spark.read.text(path).limit(1).first()
    names = next(iter(__import__("csv").reader([line[0]], delimiter=sep))) if line else []
    return [n.lstrip("﻿") for n in names]


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, columns: list[str] | None = None, sep: str = ",", blank_is_null: bool = False) -> DataFrame:
    """Every cell as text. required: columns that must be there. columns: those that are kept (the scan reads no others)."""
    names = csv_header(spark, path, sep)
    reader = spark.read.schema(text_schema(names)).option("header", True).option("sep", sep).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    reader = reader.option("nullValue", "").option("emptyValue", "") if blank_is_null else reader.option("nullValue", "\u0000").option("emptyValue", "")
    df = reader.csv(path)
    assert_required_columns(df, required or [])
    df = df.select(*columns) if columns else df
    return df if blank_is_null else df.fillna("")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text to types: what doesn't parse becomes NULL, and so does NaN."""
    out = []
    for c in df.columns:
        if c not in types:
            out.append(F.col(c))
        else:
            v = F.nullif(F.trim(c), F.lit("")).try_cast(types[c])
            out.append((F.when(F.isnan(v), None).otherwise(v) if types[c] in ("double", "float") else v).alias(c))
    return df.select(*out)


def strict_boolean(c):
    """true / false; any other text is an error when it is read."""
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(t, F.lit("NULL")))).cast("boolean"))


def lax_boolean(c):
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_zip_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """A CSV member of each archive: rows (path, line number, cells as a map). Archives are opened where they are read."""
    import csv
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(b)) as z, z.open(member) as f:
                    rows = list(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig")))
                yield pd.DataFrame({"path": p, "line": range(1, len(rows) + 1), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line bigint, cells map<string,string>")


def coco_images(spark: SparkSession, path: str) -> DataFrame:
    """Camera-trap metadata: one row for each annotation with its image's fields."""
    m = read_json(spark, path, "images array<struct<id:string,file_name:string,width:bigint,height:bigint>>, annotations array<struct<id:string,image_id:string,category_id:bigint>>", lines=False)
    im = m.select(F.explode("images").alias("i")).select("i.*")
    return m.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("id"), F.col("a.category_id").alias("category_id")).join(im, "id")


def embedding_literal(c):
    return F.from_json(c, "array<float>")


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, row, vector) of .npy matrices."""
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(b), allow_pickle=False)
                yield pd.DataFrame({"path": p, "row": range(len(a)), "vector": [r.astype("float32").tolist() for r in a]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row bigint, vector array<float>")


def list_files(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", "length", "modificationTime")


def reviewer_files(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """All reviewers' files as one table, each row with the file's stem as reviewer."""
    df = spark.read.schema(text_schema(columns)).option("header", True).csv(pattern)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("reviewer"))


def checkpoint_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, columns: list[str], strict: bool = True) -> None:
    """strict: exactly these columns. Otherwise they are picked. An existing path is an error; Spark's committer publishes whole results only."""
    (assert_exact_columns(df, columns) if strict else assert_required_columns(df, columns)).select(*columns).write.mode("errorifexists").option("header", True).option("escape", chr(34)).csv(path)


def publish(df: DataFrame, path: str, validate) -> None:
    """Write aside, validate what was written, then move it to its place; a failed validation leaves nothing."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside = f"{path}.staging-{uuid.uuid4().hex}"
    src, dst = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    if fs.exists(dst):
        raise FileExistsError(path)
    df.write.parquet(aside)
    try:
        validate(spark.read.schema(df.schema).parquet(aside))
        if not fs.rename(src, dst):
            raise OSError(f"{aside} could not be moved to {path}")
    finally:
        if fs.exists(src):
            fs.delete(src, True)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """A small file, through Spark's own file system layer: written aside, then it takes the path's place in one move."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    dst = fs.makeQualified(dst)
    src = jvm.org.apache.hadoop.fs.Path(f"{dst.toString()}.{uuid.uuid4().hex}")
    out = fs.create(src)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), conf).rename(src, dst, over)


def write_json_atomic(spark: SparkSession, record: dict, path: str) -> None:
    """A small record as one JSON file; readers see the old file or the new one."""
    write_bytes(spark, (json.dumps(record, indent=2, sort_keys=True) + "\n").encode(), path)


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """sha256 and path of every file under root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.sha2("content", 256).alias("sha256"), "path")


def bounded_rows(df: DataFrame, limit: int) -> list:
    """All rows of a small result; more rows than the limit are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as Markdown; more rows than the limit are an error."""
    rows = bounded_rows(df, limit)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
