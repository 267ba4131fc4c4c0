"""Tables written to the folder that all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions travel to the executors by value, so workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names (spark.checkpoint.dir, or a checkpoint folder set before); the warehouse where none is named."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        now = sc._jsc.sc().getCheckpointDir()
        # the warehouse is shared by all executors; a machine's own temporary folder isn't
        found = now.get() if now.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
