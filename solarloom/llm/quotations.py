"""Quotation linking in conversations (operator 3), native throughout.

Lines that begin with ``>`` are quoted, one level per ``>``; consecutive lines
of one level are a passage. A message's own passages and the passages that
others quote are hashed after normalising case and white space; a quotation
links to the latest earlier message of its conversation with that passage,
that paragraph, that whole body or those lines one after another (blank lines
don't count). Runs of lines are hashed only where the first line and the number
of lines are those of a quotation in the conversation. Only distinct
(conversation, hash, turn) go into the as-of step, and that is dealt by blocks
of turns, so neither a hot conversation nor a hot line meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, numbered, slot

TURNS = 1024
PARAGRAPH = r"\n(?:[ \t\r\f\x0B]*\n)+"


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _said_lines(text):
    """The lines that are not blank, normalised."""
    return F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "")


def _lines(text):
    """Array of (level, body) of a text's lines."""
    mark = r"^(?:[ \t]*>)+"
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, mark, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, mark + "[ \t]?", "").alias("body")))


def _parsed(rows: DataFrame) -> DataFrame:
    """Adds ``passages``, array of (level, body, hash) in order. Each step is a
    column of its own, so that no line is parsed twice."""
    out = rows.withColumn("lines", _lines(F.col("text")))
    out = out.withColumn("cuts", F.expr("filter(sequence(1, size(lines)), i -> i = 1 or lines[i-1].level <> lines[i-2].level)"))
    out = out.withColumn("runs", F.expr("transform(cuts, (c, i) -> slice(lines, c, coalesce(get(cuts, i + 1), size(lines) + 1) - c))"))
    out = out.withColumn("runs", F.transform("runs", lambda r: F.struct(r[0]["level"].alias("level"), F.array_join(F.transform(r, lambda x: x["body"]), "\n").alias("body"))))
    out = out.withColumn("runs", F.transform("runs", lambda p: F.struct(p["level"].alias("level"), p["body"].alias("body"), _normal(p["body"]).alias("normal"))))
    said = F.filter("runs", lambda p: p["normal"] != "")
    return out.withColumn("passages", F.transform(said, lambda p: F.struct(p["level"].alias("level"), p["body"].alias("body"), F.sha2(p["normal"], 256).alias("hash")))).drop("lines", "cuts", "runs")


def _runs(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hashes of the runs of ``lines`` that begin and are as long as a wanted
    one: at most one for each line and each wanted length, however often a
    quotation is repeated."""
    each = messages.select("__c", "__t", "__h", F.size("lines").alias("of"), F.posexplode("lines").alias("pos", "line"))
    starts = each.select("__c", "__t", "__h", "of", "pos", F.sha2("line", 256).alias("first")).join(wanted, ["__c", "first"]).filter("pos + n <= of")
    at = starts.groupBy("__c", "__t", "__h").agg(F.collect_set(F.struct("pos", "n")).alias("at"))
    run = F.transform("at", lambda x: F.sha2(F.array_join(F.slice("lines", x["pos"] + 1, x["n"]), " "), 256))
    return messages.join(at, ["__c", "__t", "__h"]).select("__c", "__t", F.explode(run).alias("hash"))


def link_quotations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All columns with body (the text without quotations), n_quotes
    (quotation passages), n_linked (those found in an earlier message), levels
    (deepest nesting), parent_turn (the latest message quoted at level one,
    else null) and root_turn (the end of the chain of parents, own turn
    without one); ordering a conversation by (root_turn, turn) puts replies
    behind what they quote.

    Null text is empty; a text may be of any length. Null conversation or
    turn: the row is kept and never linked. Messages of the same turn share
    parent and root; the later parent wins. Repeated rows come out as often as
    they come in. Extra columns of any name are kept, but those named like the
    added ones are replaced. Empty table: empty result.
    """
    added = ["body", "n_quotes", "n_linked", "levels", "parent_turn", "root_turn"]
    base, names = numbered(conversations, added)
    conv, turn, text = (F.col(slot(names, c)) for c in (conv, turn, text))
    rows = _parsed(base.select(F.struct(*base.columns).alias("row"), conv.alias("__c"), turn.cast("long").alias("__t"), text.alias("text")))
    body = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    rows = materialize(rows.withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", "")).withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).drop("text"))
    quotes = rows.select("__c", "__t", F.explode("passages").alias("p"))
    parts = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: F.concat(F.array(p["body"]), F.split(p["body"], "\n"), F.split(p["body"], PARAGRAPH)))
    own = rows.select("__c", "__t", F.explode(F.array_distinct(F.concat(F.array("body"), F.flatten(parts)))).alias("part"))
    own = own.select("__c", "__t", _normal(F.col("part")).alias("part")).filter("part <> ''").select("__c", "__t", F.sha2("part", 256).alias("hash"))
    quoted = quotes.filter("p.level > 0").select("__c", "__t", "p.level", "p.hash", _said_lines(F.col("p.body")).alias("lines"))
    quoted = materialize(quoted.select("__c", "__t", "level", "hash", F.sha2(F.col("lines")[0], 256).alias("first"), F.size("lines").alias("n")))
    asked = quoted.groupBy("__c", "__t", "hash").agg(F.min("level").alias("level"))
    runs = _runs(rows.select("__c", "__t", "__h", _said_lines(F.col("body")).alias("lines")).filter("size(lines) > 1"), quoted.filter("n > 1").select("__c", "first", "n").distinct())
    said = own.union(runs).distinct().join(asked.select("__c", "hash").distinct(), ["__c", "hash"], "left_semi")
    points = said.select("__c", "hash", "__t", F.lit(None).cast("int").alias("level"), F.col("__t").alias("origin")).union(
        asked.select("__c", "hash", "__t", "level", F.lit(None).cast("long"))).groupBy("__c", "hash", "__t").agg(F.max("level").alias("level"), F.max("origin").alias("origin"))
    points = points.withColumn("block", F.floor(F.col("__t") / TURNS))
    per_block = points.groupBy("__c", "hash", "block").agg(F.max("origin").alias("top"))
    before = Window.partitionBy("__c", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.withColumn("carried", F.max("top").over(before)).drop("top")
    inside = Window.partitionBy("__c", "hash", "block").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    linked = points.withColumn("near", F.max("origin").over(inside)).join(carried, ["__c", "hash", "block"]).filter("level is not null")
    linked = materialize(linked.select("__c", "__t", "hash", "level", F.coalesce("near", "carried").alias("origin")).filter("origin is not null"))

    # Parents, then roots by doubling the chains of parents.
    parent = linked.filter("level = 1").groupBy("__c", "__t").agg(F.max("origin").alias("parent"))
    chain = materialize(parent.select("__c", "__t", "parent", F.col("parent").alias("root")))
    while True:
        jump = chain.select("__c", F.col("__t").alias("root"), F.col("root").alias("next"))
        new = materialize(chain.join(jump, ["__c", "root"], "left").select("__c", "__t", "parent", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(chain)
        chain = new
        if not new.filter("moved").limit(1).count():
            break
    mine = quoted.select("__c", "__t", "hash").distinct()
    found = mine.join(linked.select("__c", "__t", "hash"), ["__c", "__t", "hash"], "left_semi").groupBy("__c", "__t").agg(F.collect_set("hash").alias("found"))
    info = materialize(chain.drop("moved").join(found, ["__c", "__t"], "full"))
    discard(quoted, linked, chain)
    out = rows.join(info, ["__c", "__t"], "left")
    passages = F.filter("passages", lambda p: p["level"] > 0)
    # Users' names come last: in one projection they would hide ours.
    return out.select(
        *[F.col(f"row.{c}").alias(f"__{c}") for c in base.columns], F.col("body").alias("__body"), F.size(passages).cast("long"),
        F.size(F.filter(passages, lambda p: F.array_contains(F.coalesce("found", F.array().cast("array<string>")), p["hash"]))).cast("long"),
        F.coalesce(F.array_max(F.transform(passages, lambda p: p["level"])), F.lit(0)).cast("long"),
        F.col("parent").alias("__parent"), F.coalesce("root", "__t")).toDF(*names, *added)
