"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.session import ensure_checkpoint_dir

#: The white space of the word and normalisation rules, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a durable, columnar checkpoint."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def travels(module: str) -> None:
    """Functions of ``module`` go to the executors by value: these need not have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)
