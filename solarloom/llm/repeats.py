"""Corpus-wide search for repeated windows, shared by the suffix-array (bytes)
and suffix-tree (words) deduplicators.

A window of ``length`` units is dealt by its seed: the k-gram of smallest hash
in it (leftmost on ties). Equal windows have equal seeds at equal offsets, so
they meet in one group, and consecutive windows of one seed travel as one
segment. Identical segments, known by the XXH3 of their bytes within a seed,
are counted with map-side combining before anything is gathered; only seeds that occur twice or more go on, with one
representative of each distinct segment. A seed whose distinct segments exceed
``hot`` is split by the longest prefix there is, the whole window, whose
hashes are only counted: an exact way for groups of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BYTE_CODE, bounded_batches, covered, discard, materialize, numbered, prefix_hash, row_chunks, runs, slot, span_hash, text_buffer, word_hashes, word_spans,
)

PIECE = 1 << 19
INDEX_BITS = 21


@dataclass
class Units:
    """Codes of consecutive units and the bytes in which each lies from its
    start to its end (no starts: a byte each)."""

    codes: np.ndarray
    flat: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    #: Units of ``flat`` before the first code.
    before: int = 0

    def piece(self, a: int, b: int) -> Units:
        return Units(self.codes[a:b], self.flat, self.starts, self.ends, a)

    def contents(self, first: np.ndarray, stop: np.ndarray) -> Iterator[memoryview]:
        """The bytes of each span of units."""
        raw, a, b = memoryview(np.ascontiguousarray(self.flat)), first + self.before, stop + self.before
        if self.starts is not None:
            a, b = self.starts[a], self.ends[b - 1]
        return (raw[x:y] for x, y in zip(a.tolist(), b.tolist()))


class Bytes:
    """Units are the UTF-8 bytes of a text."""

    @staticmethod
    def codes(data, offsets):
        part = data[offsets[0] : offsets[-1]]
        return Units(BYTE_CODE[part], part), offsets - offsets[0]

    @staticmethod
    def contents(text: bytes, spans):
        return [text[a:b] for a, b in spans]


class Words:
    """Units are the words of a text, white space dropped."""

    @staticmethod
    def codes(data, offsets):
        starts, ends, rows = word_spans(data, offsets)
        codes = word_hashes(data, starts, ends)
        # The same words whatever white space stands between them: one space.
        sizes = ends - starts
        first = np.cumsum(sizes + 1) - sizes - 1
        flat = np.full(int((sizes + 1).sum()), 32, np.uint8)
        at = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[at] = data[at + np.repeat(starts - first, sizes)]
        return Units(codes, flat, first, first + sizes), rows

    @staticmethod
    def contents(text: bytes, spans):
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in spans]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(units: Units, rows: np.ndarray, length: int, seed: int):
    """Row, first window, window count and seed hash of the segments of
    consecutive rows of units, and their first unit. The seed hash only brings
    segments together; equality is never judged by it."""
    codes = units.codes
    if len(codes) < length:
        return None
    sums = prefix_hash(codes)
    at = np.arange(len(codes) - seed + 1)
    grams = span_hash(sums, at, at + seed)
    low = np.uint64((1 << INDEX_BITS) - 1)
    lowest = sliding_min((grams & ~low) | at.astype(np.uint64), length - seed + 1)
    place = (lowest & low).astype(np.int64)
    starts = np.arange(len(place))
    row = np.searchsorted(rows, starts, "right") - 1
    whole = starts + length <= rows[row + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    new &= whole
    first = np.flatnonzero(new)
    if not len(first):
        return None
    kept = np.cumsum(whole)
    stop = np.append(kept[first[1:]] - 1, kept[-1])
    count = stop - (kept[first] - 1)
    return row[first], first - rows[row[first]], count, grams[place[first]], first


def _pieces(unit, data, offsets, length) -> Iterator[tuple]:
    """(first row, units, row offsets, unit shift); a text of more than PIECE
    units comes in pieces that overlap by length - 1."""
    for lo, hi in row_chunks(offsets, PIECE):
        units, rows = unit.codes(data, offsets[lo : hi + 1])
        if len(units.codes) <= 2 * PIECE:
            yield lo, units, rows, 0
        else:
            for a in range(0, len(units.codes), PIECE):
                part = units.piece(a, a + PIECE + length - 1)
                yield lo, part, np.array([0, len(part.codes)]), a


def find_repeats(docs: DataFrame, unit, length: int, seed: int, resolve: Callable, text: str = "text", key: str = "doc_id",
                 target: int = 1_000_000, hot: int = 20_000) -> DataFrame:
    """Per row key (``k``, ``th`` = hash of the text) the ranges of window
    starts [from, to) whose window also starts elsewhere in the corpus.

    ``resolve(contents, length)`` gets the distinct segments of whole seed
    groups, of about ``target`` bytes together, and returns a repeated-start
    mask for each. Rows without a repeat are absent. A null text is empty. A
    text of any length is dealt in overlapping pieces. Repeated rows (same key
    and text) are copies of each other: all of their windows repeat, so one of
    them stands for all.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("text"), F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("th"))
    kind = keyed.schema["k"].dataType.simpleString()
    copies = materialize(keyed.groupBy("k", "th").count().filter("count > 1").select(F.col("k").alias("k1"), F.col("th").alias("th1")))
    copied = copies.limit(1).count() > 0
    if copied:
        mine = F.col("k").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("th1"))
        once = keyed.join(copies, mine, "left_semi").groupBy("k", "th").agg(F.first("text").alias("text")).select("k", "text", "th")
        keyed = keyed.join(copies, mine, "left_anti").unionByName(once)

    def deal(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, units, rows, shift in _pieces(unit, data, offsets, length):
                found = segments(units, rows, length, seed)
                if found is not None:
                    row, first, count, gram, start = found
                    content = np.fromiter(map(digest, units.contents(start, start + count + length - 1)), np.uint64, len(start))
                    at = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(2).take(at), pa.array((first + shift).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))],
                        names=["k", "th", "first", "windows", "gram", "content"])

    dealt = materialize(keyed.mapInArrow(deal, f"k {kind}, th long, first int, windows int, gram long, content long"))
    kinds = dealt.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "first", "windows")).alias("one"))
    often = kinds.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).filter("total > 1").drop("total")
    known = materialize(kinds.join(often, "gram").select("gram", "content", "n", "distinct", "one.*"))

    # Content of the representatives that have a different partner.
    asked = known.filter("distinct > 1").groupBy("k", "th").agg(
        F.collect_list(F.struct("gram", "content", "n", "distinct", "first", "windows")).alias("asked"))
    same = keyed.withColumnRenamed("k", "k0").withColumnRenamed("th", "th0")
    fetched = same.join(asked, F.col("k0").eqNullSafe(F.col("k")) & (F.col("th0") == F.col("th"))).select("text", "asked")

    def cut(frames):
        for frame in frames:
            out = []
            for text_, wanted in zip(frame["text"], frame["asked"]):
                spans = [(w["first"], w["first"] + w["windows"] + length - 1) for w in wanted]
                out += [(w["gram"], w["content"], w["n"], w["distinct"], body) for w, body in zip(wanted, unit.contents(text_.encode(), spans))]
            yield pd.DataFrame(out, columns=["gram", "content", "n", "distinct", "body"])

    bodies = fetched.mapInPandas(cut, "gram long, content long, n long, distinct long, body binary")
    size = known.filter("distinct > 1").agg(F.sum(F.col("windows") + length), F.max("distinct")).first()
    units = (size[0] or 0) * (7 if unit is Words else 1)
    buckets = max(1, math.ceil(units / target))
    if (size[1] or 0) > hot:
        bodies = materialize(bodies)
    grouped = bodies.filter(F.col("distinct") <= hot).withColumn("bucket", F.expr(f"pmod(xxhash64(gram), {buckets})"))
    schema = "gram long, content long, f array<int>, t array<int>"

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["gram", "content"])
        masks = resolve(list(frame["body"]), length)
        out = []
        for gram, content, n, mask in zip(frame["gram"], frame["content"], frame["n"], masks):
            if n == 1 and mask.any():
                f, t = runs(mask)
                out.append((gram, content, f.astype(np.int32), t.astype(np.int32)))
        return pd.DataFrame(out, columns=["gram", "content", "f", "t"])

    ranges = known.filter("n > 1").select("gram", "content", F.array(F.lit(0)).alias("f"), F.array(F.col("windows")).alias("t"))
    ranges = ranges.unionByName(grouped.groupBy("bucket").applyInPandas(settle, schema))
    if (size[1] or 0) > hot:
        ranges = ranges.unionByName(_split_hot(bodies.filter(F.col("distinct") > hot), unit, length, schema))
    hits = dealt.join(ranges, ["gram", "content"]).select(
        "k", "th", F.transform("f", lambda x: x + F.col("first")).alias("f"), F.transform("t", lambda x: x + F.col("first")).alias("t"))
    found = hits.groupBy("k", "th").agg(F.flatten(F.collect_list("f")).alias("f"), F.flatten(F.collect_list("t")).alias("t"))
    if copied:
        whole = dealt.join(copies, mine, "left_semi").groupBy("k", "th").agg(F.max(F.col("first") + F.col("windows")).alias("t")).select("k", "th", F.expr("array(0)").alias("f"), F.array("t").alias("t"))
        found = found.join(copies, mine, "left_anti").unionByName(whole)
    found = materialize(found)
    discard(dealt, known, copies)
    if (size[1] or 0) > hot:
        discard(bodies)
    return found


def _split_hot(bodies: DataFrame, unit, length: int, schema: str) -> DataFrame:
    """Windows of hot seeds, counted by the 128-bit XXH3 of their bytes."""

    def windows(frames):
        digest = xxhash.xxh3_128_digest
        for frame in frames:
            for gram, content, n, body in zip(frame["gram"], frame["content"], frame["n"], frame["body"]):
                units, _ = unit.codes(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
                at = np.arange(len(units.codes) - length + 1)
                yield pd.DataFrame({"gram": gram, "content": content, "n": n, "at": at.astype(np.int32), "window": list(map(digest, units.contents(at, at + length)))})

    each = bodies.mapInPandas(windows, "gram long, content long, n long, at int, window binary")
    twice = each.groupBy("gram", "window").agg(F.count("*").alias("starts")).filter("starts > 1").drop("starts")
    return each.filter("n = 1").join(twice, ["gram", "window"]).groupBy("gram", "content").agg(
        F.sort_array(F.collect_list("at")).alias("f")).withColumn("t", F.transform("f", lambda x: x + 1)).select("gram", "content", "f", "t")


def apply_repeats(docs: DataFrame, found: DataFrame, work: Callable, fields: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Join the repeats to all rows and let ``work(text bytes, from, to)``
    give the values of ``fields``; every column of ``docs`` is kept. New
    fields win over columns of the same name, in any case."""
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL(fields)
    inner, names = numbered(docs, added.names)
    body, k, n = slot(names, text), slot(names, key), len(names)
    right = found.select(F.col("k").alias("k1"), F.col("th").alias("th1"), "f", "t")
    joined = inner.withColumn("th", F.xxhash64(F.coalesce(F.col(body), F.lit("")))).join(right, F.col(k).eqNullSafe(F.col("k1")) & (F.col("th") == F.col("th1")), "left")
    joined = joined.select(*inner.columns, "f", "t")
    kept = [StructField(name, f.dataType, f.nullable, f.metadata) for name, f in zip(names, inner.schema.fields)]
    schema, at = StructType(kept + added.fields), int(body[1:])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_buffer(batch.column(at))
            raw = memoryview(data)
            rows = []
            f, t = batch.column(n), batch.column(n + 1)
            for i in range(batch.num_rows):
                said = bytes(raw[offsets[i] : offsets[i + 1]])
                rows.append(work(said, f[i].values.to_numpy() if f[i].is_valid else None, t[i].values.to_numpy() if t[i].is_valid else None))
            new = [pa.array(list(v)) for v in zip(*rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + new, names=schema.names)

    return joined.mapInArrow(run, schema)


def removal_mask(n: int, starts, ends, length: int) -> np.ndarray:
    """Units covered by a window that starts in any range [start, end)."""
    return covered(n, starts, np.asarray(ends) + length - 1)
