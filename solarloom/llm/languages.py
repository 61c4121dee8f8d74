"""Language identification by hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1. A letter trigram is bound from
its letters' vectors, permuted by their place; a text bundles (sums) its
trigrams' vectors, a language bundles its sample texts, and a text gets the
language of the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, row_chunks, text_buffer

DIMENSIONS = 1024
#: Bits of a code point; three of them make the code of a trigram.
POINT = 21
#: Keys of each language that its prototype bundles at most.
SAMPLE = 3_000


def letter_classes() -> np.ndarray:
    """For each code point the letter that it counts as, upper and lower case
    together; 0: no letter, a gap."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


_table: list = []


def letters() -> np.ndarray:
    if not _table:
        _table.append(letter_classes())
    return _table[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random vector of +1 and -1 of each letter (0: of the gap)."""
    words = DIMENSIONS // 64
    at = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(at + np.uint64(0x5851F42D4C957F2D))).astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of the trigrams with these codes: each letter's vector,
    permuted by its place, multiplied."""
    out, low = None, (1 << POINT) - 1
    for place, shift in ((2, 2 * POINT), (1, POINT), (0, 0)):
        points, at = np.unique((codes >> shift) & low, return_inverse=True)
        each = np.roll(letter_vectors(points), place, axis=1)[at]
        out = each if out is None else out * each
    return out.astype(np.float32)


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """(row, code) of the letter trigrams of consecutive rows, runs of other
    characters being one gap; and which rows have a letter."""
    table = letters()
    n = len(offsets) - 1
    part, cuts = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    text = part.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
    rows = heads[cuts]
    row = np.repeat(np.arange(n), np.diff(rows))
    kind = table[points].astype(np.int64)
    has = np.bincount(row, kind > 0, n) > 0
    # Rows are kept apart by a gap on both sides.
    at = np.arange(len(kind)) + 2 * row + 1
    spread = np.zeros(len(kind) + 2 * n + 2, np.int64)
    owner = np.zeros(len(spread), np.int64)
    spread[at], owner[at] = kind, row
    keep = np.ones(len(spread), bool)
    keep[1:] = (spread[1:] > 0) | (spread[:-1] > 0)
    where = np.flatnonzero(keep)
    spread, owner = spread[where], owner[where]
    if len(spread) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    code = (spread[:-2] << 2 * POINT) | (spread[1:-1] << POINT) | spread[2:]
    middle = spread[1:-1] > 0
    return owner[1:-1][middle], code[middle], has


def bundles(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Sum of the trigram vectors of each of ``n`` rows."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    step = 128
    cut = np.searchsorted(row, np.arange(0, n + step, step))
    for b in range(len(cut) - 1):
        mine, who = code[cut[b] : cut[b + 1]], row[cut[b] : cut[b + 1]] - b * step
        if len(mine):
            used, place = np.unique(mine, return_inverse=True)
            rows = min(step, n - b * step)
            counts = np.bincount(who * len(used) + place, minlength=rows * len(used)).reshape(rows, len(used)).astype(np.float32)
            out[b * step : b * step + rows] = counts @ vectors(used)
    return out


def prototypes(docs: DataFrame, text: str, key: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their unit vectors, bundled from at most SAMPLE keys of
    each. What reaches the driver is one vector a language."""
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{lang}`"].alias("lang"), docs[f"`{text}`"].alias("text"))
    rows = rows.filter(F.expr("lang is not null and text is not null and crc32(cast(k as string)) % 5 <> 0"))
    # How small a key's hash is, on a logarithmic scale of steps of 1/64: as
    # many buckets at any number of rows, so that a language's cut comes from a
    # few thousand counts and the texts themselves are only filtered.
    step = F.floor(-F.log((F.expr("shiftrightunsigned(xxhash64(k), 1)") + 1.0) / 2.0**63) * 64)
    rows = rows.withColumn("step", step)
    counts = rows.select("k", "lang", "step").distinct().groupBy("lang", "step").count().toPandas()
    cuts = []
    for name, mine in counts.sort_values("step", ascending=False).groupby("lang"):
        fits = (mine["count"].cumsum() <= SAMPLE).to_numpy().copy()
        fits[0] = True
        cuts.append((name, int(mine["step"].to_numpy()[fits].min())))
    cut = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    chosen = rows.join(F.broadcast(cut), "lang").filter("step >= cut").select("k", "lang", "text").distinct().select("lang", "text")

    def bundle(batches):
        """Sums of this partition's trigram vectors, by language and place."""
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, at = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                row, code, _ = trigrams(data, offsets[lo : hi + 1])
                for i in np.unique(at[lo:hi]):
                    used, n = np.unique(code[at[lo:hi][row] == i], return_counts=True)
                    mine = total.setdefault(names[i], np.zeros(DIMENSIONS, np.int64))
                    for a in range(0, len(used), 8192):
                        mine += (n[a : a + 8192].astype(float) @ vectors(used[a : a + 8192])).astype(np.int64)
        for name in sorted(total):
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(total[name])], names=["lang", "at", "n"])

    sums = chosen.mapInArrow(bundle, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    sums = sums.pivot(index="lang", columns="at", values="n").sort_index()
    sums = sums[(sums != 0).any(axis=1)]
    total = sums.to_numpy(float)
    return list(sums.index), (total / np.maximum(np.linalg.norm(total, axis=1), 1e-9)[:, None]).astype(np.float32)


def identify_language(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Key, held_out, lang_pred and score (the cosine, at least 0) of every
    whole text, of any length; no other column is kept, so none can clash.
    ``und`` with score 0: null text, no letter, or nothing learned. Null keys
    are not held out and never learned from. Repeated rows are predicted each;
    ties go to the first language by name. Empty table: empty result."""
    bounded_batches(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(prototypes(docs, text, key, lang))
    keys = docs[f"`{key}`"]
    source = docs.select(keys.alias("k"), F.coalesce(F.crc32(keys.cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), docs[f"`{text}`"].alias("text"))

    def run(batches):
        names, proto = learned.value
        names_ = [*names, "und"]
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            best, score = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows)
            for lo, hi in row_chunks(offsets):
                row, code, has = trigrams(data, offsets[lo : hi + 1])
                if len(names) and has.any():
                    sums = bundles(row, code, hi - lo)
                    cos = (sums @ proto.T) / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
                    top = cos.argmax(axis=1)
                    best[lo:hi] = np.where(has, top, len(names))
                    score[lo:hi] = np.where(has, np.clip(cos[np.arange(hi - lo), top], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([names_[i] for i in best], pa.string()), pa.array(score)], names=["k", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("k", key)
