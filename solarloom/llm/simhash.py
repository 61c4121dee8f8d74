"""SimHash near-duplicates linked through BK-trees (operator 10).

Fingerprints that differ in at most three of 64 bits agree on one of four
16-bit blocks, so the trees are sharded by block value: each shard is a
BK-tree, children keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius. Shards are dealt by a shuffle rather
than broadcast, because fingerprints grow with the corpus. A shard leaves
behind one star per component, never all pairs, and the stars are joined by
``connected_components``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, numbered, slot, text_buffer
from .components import connected_components

RADIUS = 3
#: Distinct fingerprints of a shard beyond which it is split by further blocks.
HOT_SHARD = 20_000


def fingerprint(text: bytes) -> int:
    """SimHash of one text: bit set where over half of the shingles' XXH64
    (seed 42) have it; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(start[:-2].tolist(), end[2:].tolist())], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, th, fp): the key, the hash of the text and the fingerprint, both
    signed longs. Null text has no words."""
    bounded_batches(docs.sparkSession)
    body = docs[f"`{text}`"]
    source = docs.select(docs[f"`{key}`"].alias("k"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            raw = memoryview(data)
            prints = [fingerprint(bytes(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["k", "th", "fp"])

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, th long, fp long")


class BKForest:
    """BK-trees of many shards, built and searched level by level."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        by = np.argsort(shard, kind="stable")
        self.prints, shard = prints[by], shard[by]
        n = len(by)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        roots = np.flatnonzero(first)
        self.root = np.repeat(roots, np.diff(np.append(roots, n)))
        edges = []
        left, parent = np.flatnonzero(~first), self.root[~first]
        while len(left):
            key = parent * 65 + np.bitwise_count(self.prints[left] ^ self.prints[parent])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            head = np.ones(len(left), bool)
            head[1:] = key[1:] != key[:-1]
            edges.append(np.stack([key[head], left[head]]))
            parent = left[head][np.cumsum(head) - 1][~head]
            left = left[~head]
        found = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        found = found[:, np.argsort(found[0])]
        self.keys, self.child = found

    def search(self, queries: np.ndarray, radius: int):
        """Pairs (query, node) of different nodes within the radius."""
        q, node, hits = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.prints[q] ^ self.prints[node]).astype(np.int64)
            near = (d <= radius) & (node < q)
            hits.append(np.stack([q[near], node[near]]))
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            count = hi - lo
            q = np.repeat(q, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            node = self.child[at]
        return np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)

    def stars(self, radius: int, block: int = 2048) -> np.ndarray:
        """For every node the smallest node of its component."""
        label = np.arange(len(self.prints))
        for a in range(0, len(label), block):
            u, v = self.search(np.arange(a, min(a + block, len(label))), radius)
            while len(u):
                lu, lv = label[u], label[v]
                low = np.minimum(lu, lv)
                np.minimum.at(label, lu, low)
                np.minimum.at(label, lv, low)
                while np.any((jump := label[label]) != label):
                    label = jump
                open_ = label[u] != label[v]
                u, v = u[open_], v[open_]
        return label


def link(prints: DataFrame) -> DataFrame:
    """Star edges (a, b) that join the distinct ``fp`` of ``prints`` within
    the radius into their components."""
    def block(i, bits, shift):
        return F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1).alias("v"))

    shards = prints.select("fp", F.explode(F.array(*[block(i, 16, 16 * i) for i in range(4)])).alias("shard"))
    full = shards.groupBy("shard").count().filter(F.col("count") > HOT_SHARD).select("shard", F.lit(True).alias("hot"))
    shards = shards.join(full, "shard", "left")
    # Of the 48 other bits one of four 12-bit blocks agrees as well.
    rest = F.expr("case shard.i when 0 then shiftrightunsigned(fp, 16) when 3 then fp & 281474976710655"
                  " when 1 then (shiftrightunsigned(fp, 32) << 16) | (fp & 65535)"
                  " else (shiftrightunsigned(fp, 48) << 32) | (fp & 4294967295) end")
    sub = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("rest", 12 * i).bitwiseAND(4095).alias("v")) for i in range(4)])
    none = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("v")))
    shards = shards.withColumn("rest", rest).select("fp", "shard", F.explode(F.when(F.col("hot"), sub).otherwise(none)).alias("sub"))
    rows = prints.count() * 4
    buckets = max(1, math.ceil(rows / 100_000))
    shards = shards.select("fp", F.xxhash64("shard", "sub").alias("shard")).withColumn("bucket", F.expr(f"pmod(shard, {buckets})"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        forest = BKForest(frame["fp"].to_numpy().view(np.uint64), frame["shard"].to_numpy())
        label = forest.stars(RADIUS)
        own = np.flatnonzero(label != np.arange(len(label)))
        fp = forest.prints.view(np.int64)
        return pd.DataFrame({"a": fp[own], "b": fp[label[own]]}).drop_duplicates()

    return shards.groupBy("bucket").applyInPandas(grow, "a long, b long")


def _grouped(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Materialized (k, th, fp) of every row, and (fp, root, component_id) of
    every fingerprint."""
    each = materialize(fingerprints(docs, text, key))
    prints = materialize(each.groupBy("fp").agg(F.min("k").alias("low")))
    roots = connected_components(link(prints.select("fp")))
    grouped = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(grouped.join(least, "root").select("fp", "root", "component_id"))
    discard(prints, roots)
    return each, named


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): rows whose
    fingerprints are joined by a chain of links of at most three differing
    bits share the smallest key of them. No other column is kept, so none can
    clash.

    Null or empty text: fingerprint zero, linked like any other. A text may be
    of any length. Null keys: kept, never the smallest unless all are null.
    Repeated rows come out as often as they come in; two texts of one key are
    two rows. Empty table: empty result.
    """
    each, named = _grouped(docs, text, key)
    return each.join(named, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group, all columns kept: that of the
    smallest key (null keys last), of several texts of that key the one of the
    smallest hash, of several rows of that text the one whose row hash is
    smallest (any of them if that ties too). Two rows of one key whose texts
    are no near-duplicates both stay. Empty table: empty result."""
    each, named = _grouped(docs, text, key)
    one = F.struct(F.col("k").isNull().alias("none"), "k", "th")
    keep = each.groupBy("fp", "k", "th").count().join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(one.alias("one"), "count")).alias("best"))
    keep = keep.select(F.col("best.one.k").alias("k"), F.col("best.one.th").alias("th"), (F.col("best.count") > 1).alias("again"))
    inner, names = numbered(docs)
    body, k = slot(names, text), slot(names, key)
    rows = inner.withColumn("hash", F.xxhash64(F.coalesce(F.col(body), F.lit(""))))
    rows = rows.join(keep, F.col(k).eqNullSafe(F.col("k")) & (F.col("hash") == F.col("th")))
    whole = F.struct(*inner.columns)
    single = rows.filter("not again").select(whole.alias("row"))
    several = rows.filter("again").groupBy("k", "th").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return single.unionByName(several.select("row")).select(*[F.col(f"row.{c}").alias(n) for c, n in zip(inner.columns, names)])
