"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup,
benchmark decontamination, packing. Every stage reads what the one before it
wrote; all but the last return the columns of ``documents``.

In every stage: a null text has no words and is empty; a null key is a key like
any other (near-dedup sorts it last); a text may be of any length; repeated rows
are judged each, but near-dedup keeps one of them; an empty table gives an empty
result; extra columns of any name are kept as they are, since the operators see
numbers in place of names. ``documents`` needs doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solarloom.llm.common import discard, materialize, numbered, slot
from solarloom.llm.contamination import decontaminate
from solarloom.llm.packing import pack_tokens
from solarloom.llm.quality import quality_rules
from solarloom.llm.simhash import simhash_dedup
from solarloom.llm.suffix_trees import substring_dedup


def _columns(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """The documents with numbered columns, their names, and the numbers of
    text and key."""
    inner, names = numbered(docs)
    return inner, names, slot(names, "text"), slot(names, "doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forests reject go: those of no text or
    under 50 words among them."""
    inner, names, text, key = _columns(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", key)
    return quality_rules(inner, labels, text, key).filter("kept").select(*inner.columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest
    key; on ties that of the smallest text hash, then row hash."""
    inner, names, text, key = _columns(docs)
    return simhash_dedup(inner, text, key).toDF(*names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text that loses some is its kept words
    joined by one space, perhaps none, any other text stays as it is, null too.
    ``n_chars``, where there is one, is counted anew."""
    inner, names, text, key = _columns(docs)
    found = substring_dedup(inner, text, key)
    out = found.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    if "n_chars" in names:
        n = slot(names, "n_chars")
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text).cast(inner.schema[n].dataType)).otherwise(F.col(n)))
    return out.select(*inner.columns).toDF(*names)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    inner, names, text, key = _columns(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(inner, benchmark, text, key).filter("not contaminated").select(*inner.columns).toDF(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens; an empty text
    is its end token."""
    import public_tokenizers

    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("substring dedup", repeated_passages),
          ("benchmark decontamination", benchmark_passages), ("packing", packing)]
#: SQL can express neither the isolation forest nor the packing; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared
    folder and read again; a stage's input goes once its output is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
