"""Shared helpers of the text operators: whole-batch array views of texts and
rolling hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import Cuts, discard, materialize, shared_dir  # noqa: F401  (what the operators cut with)

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240501)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Bytes of an Arrow batch on its way into a Python worker.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of texts of at most ``rows`` rows and about BATCH_BYTES,
    so that a worker's memory follows neither the default of ten thousand
    whole texts nor very long ones. Both settings are read when a plan runs,
    so they stay in the session; values that are tighter already are kept."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(name)).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def numbered(docs: DataFrame, added: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """``docs`` without the columns named (in any case) like the ``added``
    ones, its columns renamed to c0, c1, ... so that no name of the user's
    meets one of ours; and their names."""
    taken = {a.lower() for a in added}
    names = [c for c in docs.columns if c.lower() not in taken]
    return docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]), names


def slot(names: list[str], column: str) -> str:
    """The number name of a user's column."""
    low = [n.lower() for n in names]
    if column.lower() not in low:
        raise ValueError(f"no column {column}, or it is named like a result")
    return f"c{low.index(column.lower())}"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of value * base**index; ``span_hash`` subtracts two."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(30)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def row_chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Byte starts and ends of the words of consecutive rows, and each row's
    first word index. ``offsets`` are absolute positions in ``data``."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    if not len(part):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[part]
    first = np.empty(len(part), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(len(part), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = offsets[:-1] - base
    cuts = cuts[cuts < len(part)]
    first[cuts] = True
    last[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    rows = np.searchsorted(starts, offsets - base)
    return starts + base, ends + base, rows


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal exactly where the words are, dense from
    zero, and the words by number."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    base = int(starts[0]) if len(starts) else 0
    inside = np.zeros(int(ends[-1]) - base + 1 if len(ends) else 0, np.int8)
    np.add.at(inside, starts - base, 1)
    np.add.at(inside, ends - base, -1)
    flat = data[base : base + len(inside) - 1][np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(starts) else data[:0]
    offsets = np.concatenate((np.zeros(1, np.int64), stops))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def content_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH3 of each word: no algebra of the letters makes two words collide."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(starts[0])
    sums = prefix_hash(BYTE_CODE[data[base : int(ends[-1])]])
    return span_hash(sums, starts - base, ends - base)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts, ends) -> np.ndarray:
    """Mask of the positions in any of the spans [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(starts, np.int64), 1)
    np.add.at(steps, np.asarray(ends, np.int64), -1)
    return np.cumsum(steps[:-1]) > 0
