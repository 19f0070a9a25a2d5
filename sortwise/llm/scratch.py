"""Shared scratch tables: lineage is cut by writing Parquet to the folder that
every executor sees (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .textvec import RELEASE, release


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local session (tests), whose driver
    and executors are one process, may fall back to a folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sortwise-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and
    found again after an executor is lost.  What the driver's Python has used before
    (training, counts) goes back to the system first: the driver is small."""
    release(RELEASE)
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sortwise-llm/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``docs.mapInArrow`` for a function that returns the columns as they came, whatever
    their names are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
