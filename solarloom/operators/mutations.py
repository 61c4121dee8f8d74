"""Upserts, flags and tiered compaction as whole-table rewrites (SNK-*):
plain Parquet has no MERGE, so each gives the new content of a partition,
to be written with dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the highest ``seq`` per key wins (SNK-01); one without
    loses to any other, but is kept where no row of the key has one."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked(seq)).alias("r")).select(*keys, "r.*")


def ranked(column: str):
    """An order in which NULL is lowest, but still a place."""
    return F.struct(F.col(column).isNotNull(), F.col(column))


def coalesce_merge(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per column the latest value that is not null (SNK-02)."""
    rest = [c for c in rows.columns if c not in [*keys, seq]]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """New rows win but for the column ``keep`` of rows that exist (SNK-03)."""
    before = old.select(*keys, F.col(keep).alias("__keep"), F.lit(True).alias("__had"))
    fresh = new.join(before, keys, "left").withColumn(keep, F.when(F.col("__had"), F.col("__keep")).otherwise(F.col(keep))).drop("__keep", "__had")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First writer wins (SNK-04)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """SNK-05."""
    return old.filter(F.col("scope") != scope).unionByName(new)


def replace_latest_segment(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest geometry segment of each string in ``new`` is replaced
    (SNK-07)."""
    top = old.join(new.select("string_id").distinct(), "string_id", "left_semi").groupBy("string_id").agg(F.max("valid_from_ts_utc").alias("valid_from_ts_utc"))
    return old.join(top, ["string_id", "valid_from_ts_utc"], "left_anti").unionByName(new)


def flag_curtailment(fivemin: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set ``limit_binding`` and the kind that follows from it; reversible,
    and reconstructed rows keep their kind (SNK-09)."""
    v = verdicts.select("ts_utc", "string_id", F.col("limit_binding").alias("__new"), F.lit(True).alias("__judged"))
    kind = F.when(F.col("value_kind") == "reconstructed", F.col("value_kind")).when(F.col("__new"), "lower_bound").when(~F.col("__new") & (F.col("value_kind") == "lower_bound"), "measured").otherwise(F.col("value_kind"))
    return fivemin.join(v, ["ts_utc", "string_id"], "left").withColumn("value_kind", F.when(F.col("__judged"), kind).otherwise(F.col("value_kind"))).withColumn(
        "limit_binding", F.when(F.col("__judged"), F.col("__new")).otherwise(F.col("limit_binding"))).select(*fivemin.columns)


def clear_string(effects: DataFrame, string_id: str) -> DataFrame:
    """Effects without a string's own key and its combinations (SNK-11)."""
    return effects.filter((F.col("key") != string_id) & ~F.col("key").startswith(f"{string_id}|"))


def clear_pairs(pairs: DataFrame, string_id: str) -> DataFrame:
    return pairs.filter((F.col("scope_id") != string_id) & ~F.array_contains("members", string_id))


def compact_raw(raw: DataFrame, hourly: DataFrame, now: int, days: int = C.RAW_DAYS) -> DataFrame:
    """Raw rows past ``days`` go only if their hour is folded (SNK-13)."""
    old = F.coalesce(F.col("ts_utc") < now - days * 86400, F.lit(False))
    folded = hourly.select("string_id", F.col("ts_utc").alias("__h")).distinct()
    gone = raw.withColumn("__h", (F.floor(F.col("ts_utc") / 3600) * 3600).cast("long"))
    marked = gone.join(folded.withColumn("__f", F.lit(True)), ["string_id", "__h"], "left")
    return marked.filter(~(old & F.col("__f").isNotNull())).select(*raw.columns)


def compact_issues(log: DataFrame, now: int, keys: list[str], days: int = C.ISSUE_DAYS) -> DataFrame:
    """Past ``days`` only the newest issue of a target stays; a row without a
    time is not past."""
    old = F.coalesce(F.col("ts_utc") < now - days * 86400, F.lit(False))
    rest = [c for c in log.columns if c not in keys]
    newest = log.filter(old).groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked("issued_at_utc")).alias("r")).select(*keys, "r.*")
    return log.filter(~old).unionByName(newest.select(*log.columns))


def thin_shading(obs: DataFrame, now: int) -> DataFrame:
    """Past 120 days every fourth on-grid row stays, off-grid rows all; past
    730 days none."""
    ts, grid = F.col("ts_utc"), F.col("ts_utc") % 300 == 0
    return obs.filter(ts >= now - C.SHADING_DAYS * 86400).filter((ts >= now - C.THIN_DAYS * 86400) | ~grid | (F.floor(ts / 300) % 4 == 0))
