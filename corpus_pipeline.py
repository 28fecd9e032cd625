"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage takes null ids, texts and sources, repeated rows and ids, and empty tables, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm.common import crc_mod, table
from penumbra.llm.decontaminate import drop_contaminated
from penumbra.llm.langid import UNKNOWN, identify, train
from penumbra.llm.mixing import mix
from penumbra.llm.simhash import keep_one
from penumbra.llm.substrings import remove_repeats
from penumbra.operators.graph import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction less sure than this is rejected, as is a text without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told; the others go (null texts and texts without a letter among them, and all if nothing could be learned). Null ids and repeated rows are treated alike."""
    langs, model = train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    return identify(docs.select(*COLUMNS), langs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the least doc_id, a null one last. Rows of one id in different groups each stay; null and empty texts are one group."""
    return keep_one(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a lesser id has; a row of which nothing is left goes. Rows with a null id, and null or empty texts, stay as they are; repeated rows are cut alike."""
    return remove_repeats(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with a benchmark item; null and empty texts have none. Each of repeated rows is judged by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: each row with its whole copies (epochs) and the words of one more (rest). Null is a source; rows without a word go."""
    return mix(docs, carry=("text", "lang", "n_chars")).filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken", "epochs", "rest")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID and MinHash banding have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
