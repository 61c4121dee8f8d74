"""Benchmark decontamination with suffix arrays of the training text
(operator 5).

Every task lays its rows out in shards of a bounded size and builds a
word-level suffix array of each; every test suffix of the broadcast benchmark
block is looked up in it by binary search, which gives all places of its
window, and the matches are then extended to their longest over every place of
that window in the block. The benchmark is dealt into blocks of bounded size
that reach the driver one by one; a job looks up CHAIN of them, and a larger
benchmark takes more jobs, so neither the driver nor a broadcast grows with it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, numbered, runs, slot, text_buffer, word_hashes, word_numbers, word_spans

#: A benchmark block's text in bytes. A word takes two bytes with its gap, so
#: a block has less than 2**BITS different ones.
BLOCK = 4_000_000
#: Blocks whose indexes one job broadcasts.
CHAIN = 4
#: Bytes of a part of an item; a longer item comes in parts that overlap.
PART = 500_000
#: Bytes of a shard of training text, about.
SHARD = 1_500_000
#: Suffixes whose first words open no test suffix can't match and are left out.
LEAD = 3
BITS = 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Outside of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
GAP = np.ones(256, bool)
GAP[48:58] = GAP[97:123] = False
GAP[128:] = False


def lowered_words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the lower-cased words of consecutive rows, and each row's
    first word index."""
    part = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends, rows = word_spans(part, offsets - offsets[0], GAP)
    return word_hashes(part, starts, ends), rows


def numbered_words(data: np.ndarray, offsets: np.ndarray):
    """Numbers of the lower-cased words of consecutive rows, the words by
    number, and each row's first word index."""
    part = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends, rows = word_spans(part, offsets - offsets[0], GAP)
    return *word_numbers(part, starts, ends), rows


def pack(symbols: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The ``depth`` symbols from each place as sort keys of three each."""
    keys = []
    for j in range(0, depth, 3):
        key = np.zeros(len(at), np.int64)
        for i in range(j, j + 3):
            key = (key << BITS) | (symbols[at + i] if i < depth else 0)
        keys.append(key)
    return keys


def bound(keys: list[np.ndarray], queries: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of every query among the sorted suffix keys: the first
    place not before it, or with ``after`` the first place past it."""
    n, m = len(keys[0]), len(queries[0])
    lo, hi = np.zeros(m, np.int64), np.full(m, n)
    while np.any(open_ := lo < hi):
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less, tie = np.zeros(m, bool), np.ones(m, bool)
        for k, q in zip(keys, queries):
            at = k[mid]
            less |= tie & (at < q)
            tie &= at == q
        right = open_ & (less | tie if after else less)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def suffix_ranks(words: np.ndarray, most: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``most`` words at least, by prefix
    doubling; equal ones share a rank."""
    n, depth = len(words), 3
    by = np.lexsort(pack(np.append(words, np.zeros(depth, np.int64)), np.arange(n), depth)[::-1])
    key = pack(np.append(words, np.zeros(depth, np.int64)), by, depth)[0]
    rank = np.zeros(n, np.int64)
    rank[by] = np.cumsum(np.append([False], key[1:] != key[:-1]))[:n]
    while depth < most and n and rank.max() < n - 1:
        later = np.zeros(n, np.int64)
        later[: max(0, n - depth)] = rank[depth:] + 1
        by = np.lexsort([later, rank])
        new = np.append([False], (rank[by][1:] != rank[by][:-1]) | (later[by][1:] != later[by][:-1]))[:n]
        rank[by] = np.cumsum(new)
        depth *= 2
    return rank


class Tests:
    """The windows of one benchmark block, ready to be looked up."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = text_buffer(texts)
        words, said, rows = numbered_words(data, offsets)
        self.names = [i for i, _ in items]
        self.vocabulary = {w: i for i, w in enumerate(said.to_pylist(), 1)}
        words = words + 1
        # A gap of zeros after each item keeps suffixes inside it.
        sizes = np.diff(rows)
        start = np.cumsum(sizes + window) - sizes - window
        self.words = np.zeros(int((sizes + window).sum()) + window, np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        self.words[start[own] + np.arange(len(words)) - rows[:-1][own]] = words
        count = np.where(sizes == 0, 0, np.maximum(1, sizes - window + 1))
        item = np.repeat(np.arange(len(sizes)), count)
        at = start[item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(window, sizes[item])
        self.window = window
        self.lead = int(min(LEAD, length.min())) if len(length) else LEAD
        rank = suffix_ranks(self.words, int(sizes.max(initial=0)))
        by = np.lexsort([rank[at], *reversed(pack(self.words, at, window)), length])
        at, item, length = at[by], item[by], length[by]
        keys = pack(self.words, at, window)
        new = np.ones(len(at), bool)
        new[1:] = length[1:] != length[:-1]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        head = np.flatnonzero(new)
        self.at, self.length = at[head], length[head]
        self.item, self.first = item, np.append(head, len(at))
        self.all_at = at
        self.low = [k[head] for k in keys]
        self.high = [k.copy() for k in self.low]
        for j in range(window):
            shift = BITS * (2 - j % 3)
            self.high[j // 3] |= np.where(j >= self.length, (1 << BITS) - 1, 0) << shift
        for j in range(window, 3 * len(keys)):
            self.high[j // 3] |= ((1 << BITS) - 1) << (BITS * (2 - j % 3))
        self.openings = np.unique(pack(self.words, self.at, self.lead)[0]) if len(self.at) else np.zeros(0, np.int64)

    def bisect(self, lo: np.ndarray, hi: np.ndarray, step: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Among the sorted test suffixes [lo, hi), the first whose word at
        ``step`` is not under ``word``."""
        lo, hi = lo.copy(), hi.copy()
        while np.any(open_ := lo < hi):
            mid = np.minimum((lo + hi) >> 1, len(self.all_at) - 1)
            less = open_ & (self.words[np.minimum(self.all_at[mid] + step, len(self.words) - 1)] < word)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def scan(self, numbers: np.ndarray, said: pa.Array, rows: np.ndarray):
        """For consecutive training rows, by numbers and words: mask of hit words, the (row, item)
        pairs, and each row's longest match in words."""
        n, window = len(numbers), self.window
        hit, longest = np.zeros(n, bool), np.zeros(len(rows) - 1, np.int64)
        none = np.zeros(0, np.int64)
        if not n or not len(self.at):
            return hit, (none, none), longest
        own = np.fromiter((self.vocabulary.get(w, 0) for w in said.to_pylist()), np.int64, len(said))
        symbols = np.zeros(n + len(rows) * window + window, np.int64)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        spread = np.arange(n) + row * window
        symbols[spread] = own[numbers]
        opening = pack(symbols, spread, self.lead)[0]
        spot = np.minimum(np.searchsorted(self.openings, opening), len(self.openings) - 1)
        suffixes = np.flatnonzero(self.openings[spot] == opening)
        if not len(suffixes):
            return hit, (none, none), longest
        keys = pack(symbols, spread[suffixes], window)
        order = np.lexsort(keys[::-1])
        array, keys = suffixes[order], [k[order] for k in keys]
        lo, hi = bound(keys, self.low, False), bound(keys, self.high, True)
        count = np.maximum(hi - lo, 0)
        q = np.repeat(np.arange(len(lo)), count)
        if not len(q):
            return hit, (none, none), longest
        at = array[np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + lo[q]]
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + self.length[q], -1)
        hit = np.cumsum(steps[:-1]) > 0
        pair = np.unique(row[at] * np.int64(len(lo)) + q)
        r, q_ = pair // len(lo), pair % len(lo)
        many = self.first[q_ + 1] - self.first[q_]
        who = self.item[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[q_], many)]
        both = np.unique(np.repeat(r, many) * np.int64(len(self.names)) + who)
        # Longest: from each place on, as far as any of the window's items goes.
        # The test suffixes are sorted, so those that go on with the same word
        # are a part of the ones before.
        reach, mine, own = self.length[q].copy(), spread[at], np.arange(len(q))
        first, stop = self.first[q], self.first[q + 1]
        while len(own):
            step = reach[own]
            a = symbols[mine[own] + step]
            first[own] = self.bisect(first[own], stop[own], step, a)
            stop[own] = self.bisect(first[own], stop[own], step, a + 1)
            own = own[(first[own] < stop[own]) & (a > 0)]
            reach[own] += 1
        np.maximum.at(longest, row[at], reach)
        return hit, (both // len(self.names), both % len(self.names)), longest


def _parts(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(i, t): items by id, long ones in parts that share window - 1 words."""
    texts = benchmark.select(F.coalesce(benchmark[f"`{item}`"].cast("string"), F.lit("")).alias("i"), F.coalesce(benchmark[f"`{text}`"], F.lit("")).alias("t"))

    def cut(batches):
        for batch in batches:
            names, texts_ = [], []
            data, offsets = text_buffer(batch.column(1))
            for r, name in enumerate(batch.column(0).to_pylist()):
                a, b = int(offsets[r]), int(offsets[r + 1])
                starts, ends, _ = word_spans(LOWER[data[a:b]], np.array([0, b - a]), GAP)
                lo = 0
                while lo < len(starts):
                    hi = max(int(np.searchsorted(ends, starts[lo] + PART, "right")), lo + window)
                    hi = min(hi, len(starts))
                    names.append(name)
                    texts_.append(data[a + starts[lo] : a + ends[hi - 1]].tobytes().decode())
                    lo = hi - window + 1 if hi < len(starts) else hi
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts_, pa.string())], names=["i", "t"])

    return texts.mapInArrow(cut, "i string, t string").distinct()


def _blocks(parts: DataFrame):
    """The parts in blocks of at most about BLOCK bytes, one at a time."""
    size = parts.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    count = max(1, math.ceil(size / (BLOCK * 0.8))) if size > BLOCK else 1
    for b in range(count):
        yield sorted(tuple(r) for r in parts.filter(F.expr(f"pmod(xxhash64(i, t), {count}) = {b}")).collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = 10,
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit (words in an occurrence of a
    window), n_items, items_sha256, contaminated, longest (words of the longest
    verbatim match, within a part of PART bytes of an item) and spans (the
    places: word ranges [start, stop) of the maximal hit runs); all other columns
    are kept.

    A window is ``window`` consecutive words of an item, or a shorter item as
    a whole. Null text: no words. A text or item may be of any length. Items
    without words have no window, items of a null id share the empty id.
    Repeated rows each get their result; repeated items count once. Extra
    columns of any name are kept, but those named like the added ones are
    replaced. Empty tables give empty or unmarked results.
    """
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, spans array<struct<start: int, stop: int>>")
    spark = docs.sparkSession
    bounded_batches(spark)
    carried = StructType.fromDDL("words long, hit binary, items array<string>, longest long")
    out, names = numbered(docs, added.names)
    at, width = int(slot(names, text)[1:]), len(names)
    schema = StructType(out.schema.fields + carried.fields)

    def scanner(tests, carry):
        """Rows with the columns of ``carried`` at the end, each block adding
        to what the ones before it found."""

        def run(batches):
            for batch in batches:
                data, offsets = text_buffer(batch.column(at))
                lo, n = 0, batch.num_rows
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SHARD, "right")) - 1)
                    numbers, said, rows = numbered_words(data, offsets[lo : hi + 1])
                    hit, (r, who), longest = tests.value.scan(numbers, said, rows)
                    cut = np.searchsorted(r, np.arange(hi - lo + 1))
                    part = batch.slice(lo, hi - lo)
                    old = part.columns[width:]
                    hits, items, most = [], [], []
                    for i in range(hi - lo):
                        mine = hit[rows[i] : rows[i + 1]]
                        bits = np.packbits(mine).tobytes() if mine.any() else b""
                        found = [tests.value.names[w] for w in who[cut[i] : cut[i + 1]]]
                        top = int(longest[i])
                        if carry:
                            before = old[1][i].as_py()
                            bits = bytes(a | b for a, b in zip(bits, before)) if bits and before else bits or before
                            found += old[2][i].as_py()
                            top = max(top, old[3][i].as_py())
                        hits.append(bits)
                        items.append(found)
                        most.append(top)
                    new = [pa.array(np.diff(rows)), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(most, pa.int64())]
                    yield pa.RecordBatch.from_arrays(part.columns[:width] + new, names=schema.names)
                    lo = hi

        return run

    parts = materialize(_parts(benchmark, item, item_text, window))
    state, cut = out, None
    for i, block in enumerate(_blocks(parts)):
        if i and i % CHAIN == 0:
            last, cut = cut, materialize(state)
            state = cut
            if last is not None:
                discard(last)
        state = state.mapInArrow(scanner(spark.sparkContext.broadcast(Tests(block, window)), i > 0), schema)
    discard(parts)
    kept = [StructField(name, f.dataType, f.nullable, f.metadata) for name, f in zip(names, out.schema.fields)]
    final = StructType(kept + added.fields)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def finish(batches):
        for batch in batches:
            words, hits, items, longest = batch.columns[width:]
            masks = [np.unpackbits(np.frombuffer(h, np.uint8)) > 0 for h in hits.to_pylist()]
            places = [[{"start": a, "stop": b} for a, b in zip(*(x.tolist() for x in runs(m)))] for m in masks]
            n_hit = [int(m.sum()) for m in masks]
            ids = [sorted(set(x)) for x in items.to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            new = [words, pa.array(n_hit, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_()), longest, pa.array(places, span)]
            yield pa.RecordBatch.from_arrays(batch.columns[:width] + new, names=final.names)

    return state.mapInArrow(finish, final)
