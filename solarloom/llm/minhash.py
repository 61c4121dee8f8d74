"""MinHash near-duplicates with one-permutation hashing (operator 13).

One hash per shingle fills all bins of a signature; empty bins borrow from a
full one that a hash of (bin, attempt) picks, which keeps the estimate unbiased
(optimal densification). BANDS bands of ROWS bins make the buckets: at a
similarity of 0.85 two sets miss each other in all of them with a chance of two
in ten million.

A bucket proposes a star, never its pairs: the hub is the set that shares most
buckets with others, so the original of a group of copies is the hub of nearly
all its buckets and the stars fall together. Every proposed pair is confirmed
on the full shingle sets. What the stars join is settled; where a bucket still
holds sets of different components, a link between two of them may be missing
from the star, so pairs across components, of fitting sizes and each in one
bucket alone, are confirmed as well. So no link is lost to the star's shape,
and copies, which fall into one component at once, are never paired.

Those pairs are few, because the star bounds what two of its members share.
Take any set P of shingles, here the hub's and those that many members have
besides. Of P they share at most the lesser of their shares of it. So they are
linked only if that is enough, which copies of one length that are too far from
their original fail, or if they have one of their other, rarer shingles in
common, and then enough of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, bounded_batches, content_hashes, discard, materialize, mix, row_chunks, text_buffer, word_numbers, word_spans
from .components import connected_components

WORDS, PERCENT = 5, 85
BANDS, ROWS = 48, 8
BINS = BANDS * ROWS
#: Shingles and members of a task's share of a hub's star, about.
SHARE, MEMBERS = 250_000, 500
#: Rows of a bucket whose pairs across components one task looks for.
ACROSS = 500
#: Members of a star that have a shingle its hub lacks, beyond which it counts
#: like the hub's own.
OFTEN = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of consecutive rows as sorted 64-bit hashes, and
    where each row's begin. A row of fewer words has one, its whole sequence;
    lengths never meet, since each starts from its own constant."""
    part, cuts = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends, rows = word_spans(part, cuts)
    numbers, words = word_numbers(part, starts, ends)
    hashes = content_hashes(words)[numbers]
    n, sizes = len(rows) - 1, np.diff(rows)
    count = np.where(sizes == 0, 0, np.maximum(1, sizes - width + 1))
    row = np.repeat(np.arange(n), count)
    first = np.repeat(rows[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(width, sizes)[row]
    value = mix(length.astype(np.uint64) + np.uint64(0x51ED27))
    padded = np.append(hashes, np.zeros(width, np.uint64))
    for j in range(width):
        value = np.where(j < length, mix(value * np.uint64(0x9E3779B97F4A7C15) ^ padded[first + j]), value)
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(n + 1))


def signatures(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One-permutation signatures of the sets with a shingle or more."""
    sizes = np.diff(cuts)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(full), BINS), np.uint64)
    row = np.repeat(np.arange(len(full)), sizes[full])
    place = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    # Sorted by value, so by bin: the first of a bin is its least.
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    have = np.zeros(out.shape, bool)
    out[row[head], place[head]], have[row[head], place[head]] = values[head], True
    r, b = np.nonzero(~have)
    attempt = 0
    while len(r):
        attempt += 1
        pick = (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)[b]
        hit = have[r, pick]
        out[r[hit], b[hit]] = out[r[hit], pick[hit]]
        r, b = r[~hit], b[~hit]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bins = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77)), bins.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ bins[:, :, j])
    return key


def _body(docs: DataFrame, text: str) -> DataFrame:
    return F.coalesce(docs[f"`{text}`"], F.lit(""))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, th, n, id, bands): key, text hash, set size, the set's own hash and
    its band keys; the last is null for sets too small to be linked to a
    different one."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[f"`{key}`"].alias("k"), F.xxhash64(_body(docs, text)).alias("th"), docs[f"`{text}`"].alias("text"))
    # Below this size one shingle of difference is too much already.
    least = -(-PERCENT // (100 - PERCENT))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in row_chunks(offsets):
                values, cuts = shingle_sets(data, offsets[lo : hi + 1])
                sizes = np.diff(cuts)
                ids = [xxhash.xxh3_64_intdigest(values[a:b].tobytes(), 13) for a, b in zip(cuts[:-1], cuts[1:])]
                wide = np.flatnonzero(sizes >= least)
                held = np.repeat(sizes >= least, sizes)
                keys = band_keys(signatures(values[held], np.concatenate(([0], np.cumsum(sizes[wide]))))).view(np.int64)
                bands = [None] * (hi - lo)
                for i, r in enumerate(wide):
                    bands[r] = keys[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["k", "th", "n", "id", "bands"])

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, th long, n long, id long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, shingles) of the ``wanted`` (k, th, id), each once."""
    rows = docs.select(docs[f"`{key}`"].alias("k0"), _body(docs, text).alias("text")).withColumn("th0", F.xxhash64("text"))
    rows = rows.join(wanted, F.col("k0").eqNullSafe(F.col("k")) & (F.col("th0") == F.col("th"))).select("id", "text")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                values, cuts = shingle_sets(data, offsets[lo : hi + 1])
                sets = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sets, pa.large_binary())], names=["id", "n", "shingles"])

    return rows.mapInArrow(run, "id long, n long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, id, n, both, linked, own) of the ``pairs`` (hub, id, n): how much
    the full sets share, whether they are linked, and the member's shingles
    that the hub lacks. A hub's star is dealt into shares of bounded size, each
    with a copy of the hub's set, so a hub of any size takes as many tasks as
    it needs."""
    shares = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.sum("n") / SHARE, F.count("*") / MEMBERS)).cast("int").alias("shares"))
    member = pairs.join(shares, "hub").select("hub", F.expr("cast(pmod(xxhash64(id, 7), shares) as int)").alias("share"), "id", F.lit(False).alias("is_hub"))
    hubs = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("hub").alias("id"), F.lit(True).alias("is_hub"))
    filled = member.unionByName(hubs).join(sets, "id")

    def judge(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["id", "is_hub"])
        hub = np.frombuffer(frame.loc[frame["is_hub"], "shingles"].iloc[0], np.uint64)
        out = []
        for id_, body in frame.loc[~frame["is_hub"], ["id", "shingles"]].itertuples(index=False):
            mine = np.frombuffer(body, np.uint64)
            inside = hub[np.minimum(np.searchsorted(hub, mine), len(hub) - 1)] == mine
            both = int(inside.sum())
            out.append((key[0], id_, len(mine), both, 100 * both >= PERCENT * (len(hub) + len(mine) - both), mine[~inside].view(np.int64)))
        return pd.DataFrame(out, columns=["hub", "id", "n", "both", "linked", "own"])

    return filled.groupBy("hub", "share").applyInPandas(judge, "hub long, id long, n long, both long, linked boolean, own array<long>")


def links_of(found: DataFrame) -> DataFrame:
    return found.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _linkable(shared, n, other):
    """Whether sets of these sizes are linked if they share so much."""
    return shared * (100 + PERCENT) >= (n + other) * PERCENT


def stars(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``hub`` of their bucket, its set of greatest weight;
    the hub's own are left out."""
    best = rows.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("one"))
    return rows.join(best.select("bucket", (-F.col("one.id")).alias("hub")), "bucket").filter("id <> hub")


def across(member: DataFrame, found: DataFrame, roots: DataFrame | None, cut: Cuts) -> DataFrame:
    """(hub, id, n): pairs of members of one star that are in different
    components and may be linked, each once; ``hub`` is just one of the two."""
    star = found.select(F.col("hub").alias("star"), "id", "n", "both", "own")
    if roots is None:
        star = star.withColumn("root", F.col("id"))
    else:
        star = star.join(roots, F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))
    live = star.groupBy("star").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("star")
    star = cut(star.join(live, "star"))
    # Shingles of many members of a star count like its hub's.
    each = star.select("star", "id", F.explode("own").alias("shingle"))
    often = each.groupBy("star", "shingle").agg(F.count("*").alias("c"))
    rare = each.join(often.filter(f"c > 1 and c <= {OFTEN}").drop("c"), ["star", "shingle"])
    many = each.join(often.filter(f"c > {OFTEN}").drop("c"), ["star", "shingle"]).groupBy("star", "id").agg(F.count("*").alias("many"))
    mine = rare.groupBy("star", "id").agg(F.sort_array(F.collect_list("shingle")).alias("rare"))
    star_ = star.drop("own").join(many, ["star", "id"], "left").join(mine, ["star", "id"], "left")
    star_ = cut(star_.select("star", "id", "n", "root", (F.col("both") + F.coalesce("many", F.lit(0))).alias("both"), F.coalesce("rare", F.array().cast("array<long>")).alias("rare")))
    enough = _linkable(F.least("both", "both1"), F.col("n"), F.col("n1"))
    apart = (F.col("root") != F.col("root1")) & (F.col("id") < F.col("id1"))
    pair = [F.least("id", "id1").alias("hub"), F.greatest("id", "id1").alias("id"), F.when(F.col("id") < F.col("id1"), F.col("n1")).otherwise(F.col("n")).alias("n")]

    # Common shingles: each has OFTEN members at most; a pair is proposed at
    # its first one.
    def by_shingle(suffix):
        return star_.select(*[F.col(c).alias(c + suffix) for c in ("star", "id", "n", "root", "both", "rare")], F.explode("rare").alias("shingle" + suffix))

    both = F.array_intersect("rare", "rare1")
    second = by_shingle("").join(by_shingle("1"), (F.col("star") == F.col("star1")) & (F.col("shingle") == F.col("shingle1")) & apart & (F.array_min(both) == F.col("shingle"))
                                 & _linkable(F.least("both", "both1") + F.size(both), F.col("n"), F.col("n1")))
    # Shares of P alone, by bucket: only members whose share leaves room for
    # some other member of it, of those only the ones outside of the bucket's
    # largest component against all.
    rows = member.select("bucket", F.col("hub").alias("star"), "id").join(star_.drop("rare"), ["star", "id"])
    rows = rows.withColumn("room", F.floor((F.col("both") * (100 + PERCENT) - F.col("n") * PERCENT) / PERCENT)).filter(F.col("room") * 100 >= F.col("n") * PERCENT)
    limits = rows.groupBy("bucket").agg(F.min("n").alias("least"), F.max("room").alias("most"))
    rows = rows.join(limits, "bucket").filter("room >= least and n <= most").drop("room", "least", "most")
    size = rows.groupBy("bucket", "root").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("major"), F.max("size").alias("top"), F.sum("size").alias("all"))
    size = size.filter(F.col("all") > F.col("top")).select("bucket", "major", F.ceil((F.col("all") - F.col("top")) / ACROSS).cast("int").alias("parts"))
    rows = cut(rows.join(size, "bucket"))
    rows = rows.join(rows.groupBy("id").agg(F.collect_list("bucket").alias("buckets")), "id")  # at most BANDS
    left = rows.filter("root <> major").select("bucket", F.expr("pmod(xxhash64(id, 3), parts)").alias("part"), "id", "n", "root", "both", "buckets")
    parts = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
    right = rows.select(F.col("bucket").alias("bucket1"), F.explode(parts).alias("part1"), F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("root").alias("root1"), F.col("both").alias("both1"), F.col("buckets").alias("buckets1"), F.col("major").alias("major1"))
    once = (F.col("root") != F.col("root1")) & ((F.col("root1") == F.col("major1")) | (F.col("id") < F.col("id1")))
    first = left.join(right, (F.col("bucket") == F.col("bucket1")) & (F.col("part") == F.col("part1")) & once & enough & (F.array_min(F.array_intersect("buckets", "buckets1")) == F.col("bucket")))
    return first.select(*pair).unionByName(second.select(*pair)).groupBy("hub", "id").agg(F.first("n").alias("n"))


def link(sketched: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame | None:
    """(node, root) of all sets that are linked to another, None if there are
    none."""
    bound = sketched.filter("bands is not null")
    keys = bound.groupBy("id").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).select("id", "n", F.explode("bands").alias("bucket"))
    often = keys.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    cut = Cuts()
    shared = cut(keys.join(often, "bucket"))
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    member = cut(stars(shared.drop("size").join(weight, "id")))
    one = F.struct(F.col("k").isNull().alias("none"), "k", "th")
    wanted = bound.groupBy("id").agg(F.min(one).alias("one")).join(shared.select("id").distinct(), "id")
    sets = cut(full_sets(docs, wanted.select("id", "one.k", "one.th"), text, key))
    found = cut(confirm(member.groupBy("hub", "id").agg(F.first("n").alias("n")), sets))
    first = links_of(found)
    roots = connected_components(first) if first.limit(1).count() else None
    more = cut(links_of(confirm(across(member, found, roots, cut), sets)))
    if more.limit(1).count():
        last, roots = roots, connected_components(first.unionByName(more))
        if last is not None:
            discard(last)
    cut.drop()
    return roots


def minhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept): rows whose shingle sets are
    joined by a chain of links of at least 0.85 share the smallest key of
    them; kept where the key is that one. No other column is kept, so none can
    clash.

    Null text or a text without words: the empty set, linked with nothing, its
    own component. Under five words: the whole sequence is the one shingle. A
    text may be of any length. Null keys: never the smallest unless all are
    null. Repeated rows come out as often as they come in; two texts of one
    key are two rows. Empty table: empty result.
    """
    each = materialize(sketches(docs, text, key))
    roots = link(each, docs, text, key)
    sets = each.filter("n > 0").groupBy("id").agg(F.min("k").alias("low"))
    if roots is None:
        named = sets.select("id", F.col("low").alias("component_id"))
    else:
        grouped = sets.join(roots, sets.id == roots.node, "left").select("id", "low", F.coalesce("root", "id").alias("root"))
        least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
        named = materialize(grouped.join(least, "root").select("id", "component_id"))
        discard(roots)
    out = each.filter("n > 0").select("k", "n", "id").join(named, "id").select("k", "n", "component_id").unionByName(each.filter("n = 0").select("k", "n", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
