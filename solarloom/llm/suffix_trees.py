"""Substring deduplication of words by prefix-partitioned suffix trees
(operator 9).

Suffixes are split into memory-sized groups by content: a seed of eight words,
or for groups too large for that the whole window (``repeats``). Within a
group they are split again by leading words, each subtree is laid out as
sorted suffixes with common-prefix depths, and the internal nodes at least one
window deep give the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Words, apply_repeats, find_repeats, removal_mask

SUBTREE = 1 << 18
#: Word numbers of 21 bits that share one sort key.
PACK = 3


def prefix_groups(symbols: np.ndarray, suffixes: np.ndarray, most: int):
    """Groups of suffixes with a common prefix, each prefix made longer until
    its group has at most ``most`` members or is a whole window deep."""
    todo = [(suffixes, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= most or depth >= 32:
            yield group
            continue
        head = symbols[group + depth]
        by = np.argsort(head, kind="stable")
        cut = np.flatnonzero(np.diff(head[by])) + 1
        small, held = [], 0
        for part in np.split(group[by], cut):
            if len(part) > most:
                todo.append((part, depth + 1))
            elif len(part) > 1:
                if held + len(part) > most:
                    yield np.concatenate(small)
                    small, held = [], 0
                small.append(part)
                held += len(part)
        if small:
            yield np.concatenate(small)


def subtree(symbols: np.ndarray, suffixes: np.ndarray, depth: int):
    """The suffixes in tree order and the depth, up to ``depth``, of the node
    that joins each to the one before it."""
    order = suffixes.copy()
    lead = np.zeros(len(order), np.int64)
    slots = np.arange(len(order))
    for j in range(0, depth, PACK):
        who = order[slots]
        pack = np.zeros(len(slots), np.int64)
        for i in range(j, min(j + PACK, depth)):
            pack = (pack << 21) | symbols[who + i]
        by = np.lexsort((pack, lead[slots]))
        who, pack, led = who[by], pack[by], lead[slots][by]
        order[slots] = who
        new = np.ones(len(slots), bool)
        new[1:] = (pack[1:] != pack[:-1]) | (led[1:] != led[:-1])
        lead[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            break
    joint = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for j in range(depth):
        open_ = open_[symbols[order[open_] + j] == symbols[order[open_ - 1] + j]]
        if not len(open_):
            break
        joint[open_] = j + 1
    return order, joint


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each string of words a mask of the word starts whose ``length``
    words also start elsewhere in the strings."""
    ids: dict[bytes, int] = {}
    rows = [[ids.setdefault(w, len(ids) + 1) for w in body.split()] for body in contents]
    sizes = np.array([len(r) for r in rows])
    at = np.cumsum(sizes) - sizes
    symbols = np.concatenate([np.asarray(r, np.int64) for r in rows])
    windows = np.maximum(0, sizes - length + 1)
    starts = np.repeat(at, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    shared = np.zeros(len(symbols), bool)
    for group in prefix_groups(symbols, starts, SUBTREE):
        order, joint = subtree(symbols, group, length)
        deep = joint >= length
        leaf = deep | np.append(deep[1:], False)
        shared[order[leaf]] = True
    return [shared[a : a + w] for a, w in zip(at, windows)]


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 35) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also
    starts elsewhere, same row included; windows are judged on the input.
    Keeps all columns and adds n_words, n_removed, kept_sha256 and kept (the
    kept words joined by one space).

    Null text: no words, kept is empty. Texts of fewer words stay whole.
    A text may be of any length. Repeated rows are copies of each other. Null
    keys are kept. An empty table gives an empty result. Extra columns of any
    name are kept, but those named like the added ones are replaced.
    """
    found = find_repeats(docs, Words, length, 8, repeated_starts, text, key)

    def work(body: bytes, f, t):
        words = body.split()
        n = len(words)
        if f is not None:
            gone = removal_mask(n, f, t, length)
            words = [words[i] for i in np.flatnonzero(~gone)]
        kept = b" ".join(words)
        return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()

    return apply_repeats(docs, found, work, "n_words long, n_removed long, kept_sha256 string, kept string", text, key)
