"""Suffix-array deduplication of bytes (operator 8).

Within a group of segments the Burrows-Wheeler transform is built and common
prefixes are derived by threshold-bounded interval expansion: a breadth-first
backward extension finds the boundaries between neighbouring suffixes by
increasing common-prefix length and stops at the minimum length; boundaries
that no step has reached separate suffixes that share it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import runs
from .repeats import Bytes, apply_repeats, find_repeats, removal_mask

START = 7


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, by prefix
    doubling from packed START-grams; and the packed grams. ``symbols`` are
    under 512 and end with a unique 0."""
    n = len(symbols)
    wide = np.zeros(n + START, np.int64)
    wide[:n] = symbols
    packed = np.zeros(n, np.int64)
    for j in range(START):
        packed = (packed << 9) | wide[j : j + n]
    order = np.argsort(packed, kind="stable")
    step = packed[order]
    new = np.ones(n, bool)
    new[1:] = step[1:] != step[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = lead
    k = START
    while k < depth:
        tied = np.ones(n, bool)
        tied[:-1] = new[:-1] & new[1:]
        tied[-1] = new[-1]
        slots = np.flatnonzero(~tied)
        if not len(slots):
            break
        who = order[slots]
        beyond = who + k
        next_rank = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        pair = (rank[who] << 31) | (next_rank + 1)
        by = np.argsort(pair, kind="stable")
        who, pair = who[by], pair[by]
        order[slots] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[slots] = fresh
        lead = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[who] = lead
        k *= 2
    return order, packed


def expand_intervals(symbols: np.ndarray, order: np.ndarray, packed: np.ndarray, length: int) -> np.ndarray:
    """Mask over ranks: True where the suffix shares under ``length`` symbols
    with its predecessor in ``order``."""
    n = len(symbols)
    bwt = symbols[order - 1]
    lf = np.empty(n, np.int64)
    by = np.argsort(bwt, kind="stable")
    lf[by] = np.arange(n)
    first_symbol = symbols[order]
    reached = np.zeros(n + 1, bool)
    reached[0] = reached[n] = True
    grams = packed[order]
    cut = np.flatnonzero(grams[1:] != grams[:-1]) + 1
    reached[cut] = True
    # Intervals of START-grams whose right neighbour shares all but one symbol.
    lefts = np.concatenate(([0], cut))
    rights = np.concatenate((cut, [n]))
    near = np.zeros(len(lefts), bool)
    near[:-1] = (grams[cut] >> 9) == (grams[cut - 1] >> 9)
    lo, hi = lefts[near], rights[near]
    for _ in range(START, length):
        if not len(lo):
            break
        size = hi - lo
        total = int(size.sum())
        owner = np.repeat(np.arange(len(lo)), size)
        flat = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        flat_ok = bwt[flat] != 0
        owner, target = owner[flat_ok], lf[flat[flat_ok]]
        if not len(target):
            break
        by = np.argsort(owner * n + target)
        owner, target = owner[by], target[by]
        start = np.ones(len(target), bool)
        start[1:] = (owner[1:] != owner[:-1]) | (target[1:] != target[:-1] + 1) | (first_symbol[target[1:]] != first_symbol[target[:-1]])
        begin = np.flatnonzero(start)
        lo = target[begin]
        hi = target[np.append(begin[1:], len(target)) - 1] + 1
        fresh = ~reached[hi]
        lo, hi = lo[fresh], hi[fresh]
        reached[hi] = True
    return reached[:n]


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each string a mask of the starts whose ``length`` bytes also start
    elsewhere in the strings."""
    joined = b"\x00".join(contents) + b"\x00\x00"
    sizes = np.array([len(c) for c in contents])
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    at = np.cumsum(sizes + 1) - sizes - 1
    symbols[at + sizes] = 1
    symbols[-1] = 0
    order, packed = suffix_order(symbols, length)
    apart = expand_intervals(symbols, order, packed, length)
    alone = apart & np.append(apart[1:], True)
    shared = np.zeros(len(symbols), bool)
    shared[order[~alone]] = True
    return [shared[a : a + max(0, s - length + 1)] for a, s in zip(at, sizes)]


def suffix_array_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts
    elsewhere in the corpus, same row included; strings are judged on the
    input. Keeps all columns and adds n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and kept (binary: the remaining bytes).

    Null text: empty (0 bytes, sha of nothing). Texts shorter than ``length``
    stay whole; a text may be of any length. Repeated rows are copies of each
    other. Null keys are kept. An empty table gives an empty result. Extra
    columns of any name are kept, but those named like the added ones are
    replaced.
    """
    found = find_repeats(docs, Bytes, length, 48, repeated_starts, text, key)

    def work(body: bytes, f, t):
        if f is None:
            return len(body), 0, 0, hashlib.sha256(body).hexdigest(), body
        gone = removal_mask(len(body), f, t, length)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        return len(body), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept

    return apply_repeats(docs, found, work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", text, key)
