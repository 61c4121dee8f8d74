"""Filter interaction audit by lattice-edge aggregation (operator 11).

What a filter removes after others depends only on the subset already applied,
never on their order. So the 120 orders of five filters are paths through the
lattice of 32 subsets, and every step of every order is one of its 80 edges
(subset, next filter). Documents are counted once by the mask of filters they
fail, each mask adds its counts to the 80 edges, and the 600 steps are looked
up in the aggregated edges. Everything is DataFrame functions; what is shuffled
per document is its key, a digest and a few flags, never its text.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65,
            "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 5, "D": text.rlike(r"[#$%&*|]")}


def edges() -> list[tuple[int, int, int]]:
    """The lattice: (subset, bit) of each edge and how many of the orders run
    through it."""
    out = []
    for i, _ in enumerate(FILTERS):
        others = [b for b in range(len(FILTERS)) if b != i]
        for size in range(len(others) + 1):
            for some in combinations(others, size):
                out.append((sum(1 << b for b in some), 1 << i, factorial(size) * factorial(len(others) - size)))
    return out


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, subset, bit): the orders as paths."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        subset = 0
        for step, b in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, subset, 1 << b))
            subset |= 1 << b
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, bit int")


def fail_counts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit i
    of the mask for the i-th. Equal texts are found by their SHA-256; a group
    of copies of any size is reduced by partial aggregates to one row for each
    part and label before anything of it meets in one task."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    said = docs.select(docs[f"`{key}`"].alias("k"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), body.alias("body"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("body")).values())), F.lit(0))
    narrow = said.select("k", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))
    low = {c.lower(): c for c in labels.columns}
    marks = labels.select(labels[f"`{low[key.lower()]}`"].alias("k1"), *[(F.coalesce(labels[f"`{low[c]}`"] == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    marks = marks.filter("k1 is not null").groupBy("k1").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    # Rows without a key are spread by their text.
    narrow = narrow.withColumn("spread", F.when(F.col("k").isNull(), F.xxhash64("digest", "part")).otherwise(F.xxhash64("k")))
    each = narrow.join(marks.withColumn("spread1", F.xxhash64("k1")), (F.col("spread") == F.col("spread1")) & (F.col("k") == F.col("k1")), "left")
    # A document is a row; rows of one key and text never precede each other.
    group = ["digest", "part", "mask", "good", "toxic"]
    each = each.select("spread", "k", "part", "mask", "digest", *flags).groupBy("spread", "k", *group).agg(F.count("*").alias("n"))
    keyed = F.when(F.col("k").isNotNull(), F.struct("k", "n"))
    found = each.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("unkeyed"), F.min(keyed).alias("first"))
    found = found.withColumn("lowest", F.min("first.k").over(Window.partitionBy("digest")))
    passes = F.coalesce(F.col("unkeyed"), F.lit(0)) + F.when(F.col("first.k") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = found.select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), passes.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - passes).alias("n")))).alias("x"))
    return split.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley (what the
    filter removes, summed over all orders) and filter (its letter).

    Null text is empty and, like any text under 50 words, fails A; a text may
    be of any length. A null part is the empty part. Documents are rows:
    repeated rows count each, and none is a copy of another, since their keys
    are equal; of a text under several keys all but the smallest key's fail E,
    whatever part they are in. A row without a key never fails E and makes no
    other row fail it. Label rows of one key are joined: good or toxic if any
    says so. Of ``docs`` only the three named columns are read, so no other can
    clash. Empty table: no part, so an empty result.
    """
    spark = docs.sparkSession
    counts = fail_counts(docs, labels, text, key, part)
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("subset")) != 0

    def total(condition, of="n"):
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    # At most 32 masks a part reach this, each contributing to all 80 edges.
    edge = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("weight")) for s, b, w in edges()])
    lattice = counts.select("*", F.inline(edge)).groupBy("part", "subset", "bit", "weight").agg(
        total(~hit & ~gone).alias("kept"), total(hit & ~gone).alias("removed"), total(hit & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(hit & ~gone, "good").alias("good_lost"), total(hit & ~gone, "toxic").alias("toxic_lost"))
    lattice = lattice.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "bit")))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return lattice.join(F.broadcast(steps(spark)), ["subset", "bit"]).select(  # 600 rows
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in [*COUNTS, "shapley"]], letter.alias("filter"))

