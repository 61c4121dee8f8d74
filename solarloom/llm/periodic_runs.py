"""Periodic runs of words by Lyndon arrays on ordered alphabets (operator 12).

Every run has a root that is the longest Lyndon word at its place, for one of
the two orders of the alphabet; that word ends at the next smaller suffix. The
array is built from left to right with a stack, comparing suffixes word by
word. Once a comparison has matched up to some place, later comparisons left of
it read their extension from the pair that it mirrors and only go on from that
place, so matched words are not read again. Neither suffix arrays nor hashes
decide anything: words of a document are numbered by their content.

A document is first cut at words that can be in no run: a word of a run of
period q has an equal one within q places, and the run is at least four periods
long, so for each power of two only stretches of words with a neighbour that
near, long enough for such a run, are left.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, covered, numbered, row_chunks, runs as spans_of, slot, text_buffer, word_numbers, word_spans

LEAST, EXPONENT = 6, 4


def next_smaller(words: list[int], found) -> None:
    """``found(i, j, e)`` for every suffix i whose next smaller suffix is j < n:
    the Lyndon array's entry is j - i, and e words from j on equal those from
    i on. ``words`` ends with a mark smaller than all."""
    n = len(words) - 1
    stack = [0] if n else []
    # Words [left, right) equal those ``back`` places before.
    left = right = back = 0
    known: dict[int, int] = {}
    wide = n + 1
    for i in range(1, n):
        here = words[i]
        while stack:
            j = stack[-1]
            there = words[j]
            if there != here:
                if there < here:
                    break
                stack.pop()
                continue
            e = 0
            if i < right:
                i2 = i - back
                j2 = j - back if j >= left else j
                room = right - i
                e = room if i2 == j2 else known.get(j2 * wide + i2, 0)
                go_on = not e or e >= room
                e = min(e, room)
            else:
                go_on = True
            if go_on:
                while words[j + e] == words[i + e]:
                    e += 1
            known[j * wide + i] = e
            if i + e > right:
                left, right, back = i, i + e, i - j
            if words[j + e] < words[i + e]:
                break
            stack.pop()
            found(j, i, e)
        stack.append(i)


def word_runs(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``exponent``
    whole periods, by start and period."""
    out = set()
    for sign in (1, -1):
        text = [sign * w for w in words]
        text.append(min(text, default=0) - 1)
        last: dict[int, int] = {}

        def found(i, j, e):
            p = j - i
            # Of the Lyndon roots of a run the first sees all but less than
            # one period of it to its right.
            if e < (exponent - 2) * p or last.get(p, -1) >= j:
                return
            a = 0
            while i - a > 0 and text[i - a - 1] == text[j - a - 1]:
                a += 1
            last[p] = j + e
            if a + p + e >= max(least, exponent * p):
                out.add((i - a, a + p + e, p))

        next_smaller(text, found)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(numbers: np.ndarray, rows: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs; ``rows``
    are the first words of consecutive documents."""
    n = len(numbers)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    by = np.argsort(numbers * np.int64(len(rows)) + row, kind="stable")
    same = (numbers[by][1:] == numbers[by][:-1]) & (row[by][1:] == row[by][:-1])
    gap = np.where(same, by[1:] - by[:-1], n + 1)
    near = np.full(n, n + 1)
    near[by[:-1]] = gap
    near[by[1:]] = np.minimum(near[by[1:]], gap)
    longest, keep, q = int(np.diff(rows).max(initial=0)), np.zeros(n, bool), 1
    first = np.zeros(n, bool)
    first[rows[:-1][rows[:-1] < n]] = True
    while exponent * (q // 2 + 1) <= longest:  # periods of q // 2 + 1 to q
        fine = near <= q
        if fine.any():
            edge = first | ~fine
            edge[1:] |= ~fine[:-1]
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], n)
            good = fine[starts] & (ends - starts >= max(least, exponent * (q // 2 + 1)))
            keep |= covered(n, starts[good], ends[good])
        q *= 2
    edge = np.ones(n, bool)
    edge[1:] = first[1:] | (keep[1:] != keep[:-1])
    starts = np.flatnonzero(edge) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)[: len(starts)]
    return starts[keep[starts]], ends[keep[starts]]


def rewritten(key, n: int) -> tuple[int, int] | None:
    """(place, period) from where the words of a document are periodic by the
    rule of the contract's planted runs."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def detect_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, exponent: int = EXPONENT, planted: bool = False) -> DataFrame:
    """All columns of ``docs`` with n_words, runs (array of start, length,
    period in words), the longest one's start, length, period and
    exponent_milli, runs_sha256, n_runs, collapsed (the words that are left
    when every run keeps its first period, joined by a space) and
    collapsed_sha256.

    Null or empty text: no words, no run, the hashes of nothing. A text may be
    of any length; the work grows in proportion to it. Of runs of one length
    the one of the smallest start, then period, is the longest. ``planted``
    first makes the tail of some documents periodic by their key (never of a
    null key), which is how the detector is exercised on tables that hold no
    such texts. Repeated rows each get their result. Extra columns of any name
    are kept, but those named like the added ones are replaced. Empty table:
    empty result.
    """
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL("n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
                               "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    bounded_batches(docs.sparkSession)
    inner, names = numbered(docs, added.names)
    schema = StructType([StructField(name, f.dataType, f.nullable, f.metadata) for name, f in zip(names, inner.schema.fields)] + added.fields)
    at, k = int(slot(names, text)[1:]), int(slot(names, key)[1:])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def judged(data, offsets, keys):
        starts, ends, rows = word_spans(data, offsets)
        numbers, words = word_numbers(data, starts, ends)
        if planted:
            for i, key_ in enumerate(keys):
                rule = rewritten(key_, int(rows[i + 1] - rows[i]))
                if rule:
                    a = rows[i] + rule[0]
                    numbers[a : rows[i + 1]] = numbers[a + np.arange(rows[i + 1] - a) % rule[1]]
        a, b = stretches(numbers, rows, least, exponent)
        owner = np.searchsorted(rows, a, "right") - 1
        found: list[list] = [[] for _ in range(len(rows) - 1)]
        for lo, hi, r in zip(a.tolist(), b.tolist(), owner.tolist()):
            shift = lo - int(rows[r])
            found[r] += [(s + shift, n, p) for s, n, p in word_runs(numbers[lo:hi].tolist(), least, exponent)]
        listed = words.to_pylist()
        for r, mine in enumerate(found):
            own = numbers[rows[r] : rows[r + 1]]
            if mine:
                mine.sort(key=lambda x: (x[0], x[2]))
                spans = np.array(mine)
                own = own[~covered(len(own), spans[:, 0] + spans[:, 2], spans[:, 0] + spans[:, 1])]
            collapsed = b" ".join([listed[w] for w in own.tolist()])
            top = min(mine, key=lambda x: (-x[1], x[0], x[2])) if mine else None
            said = "".join(f"{s},{n},{p}\n" for s, n, p in mine)
            yield (int(rows[r + 1] - rows[r]), len(mine), *(top or (None, None, None)), top and 1000 * top[1] // top[2], hashlib.sha256(said.encode()).hexdigest(),
                   hashlib.sha256(collapsed).hexdigest(), [{"start": s, "length": n, "period": p} for s, n, p in mine], collapsed.decode())

    kinds = [pa.int64()] * 6 + [pa.string(), pa.string(), run_type, pa.string()]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for lo, hi in row_chunks(offsets):
                part = batch.slice(lo, hi - lo)
                rows = list(judged(data, offsets[lo : hi + 1], part.column(k).to_pylist()))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=schema.names)

    return inner.mapInArrow(run, schema)
