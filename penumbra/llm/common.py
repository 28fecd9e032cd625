"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators.graph import cut_lineage as cut  # noqa: F401

#: Words of the white-space contract: bytes.split() splits at just these characters.
SPACE = r"\x20\x09-\x0D"
#: What separates words in the decontamination contract.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that Python workers get at once, so that very long texts don't pile up in their memory.
BATCH_ROWS, BATCH_BYTES = 2000, "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df, its session set to pass small batches to Python workers; smaller limits of the session's own stay."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def lowered(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0, so it is held out where 0 means that."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
