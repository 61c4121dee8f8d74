"""Bounded-space online packing of token sequences (operator 7).

Each partition keeps a fixed number of open windows. A document's full windows
leave at once; its rest goes into the open window it fits best. When none
fits, the fullest window is topped up with a cut of the document and emitted.
What partitions leave open is merged in two rounds of groups, so that no task
gets more than a bounded share of the leftovers.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Word forms whose ids a task remembers.
REMEMBERED = 400_000
#: The byte-level pattern's published split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank with white space or nothing after it.
UNSAFE = re.compile(r" (?:\s|\Z)")
_models: dict = {}


class Encoder:
    """Token ids (little-endian uint32 bytes) of whole texts, the same as the
    tokenizer's. A byte-level BPE splits before a single blank that begins a
    word, so the forms between blanks are encoded once and remembered, by the
    same vocabulary in rank form; texts with other white space after a blank,
    or with special tokens, go through the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # The vocabulary writes bytes as printable characters; the alphabet's
        # own order gives the others numbers from 256 on.
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        same = {c: ord(c) for c in letters if ord(c) < 256}
        others = iter(sorted(set(range(256)) - set(same.values())))
        code = same | {c: next(others) for c in letters if ord(c) > 255}
        ranks = {bytes(code[c] for c in t): i for t, i in self.model.get_vocab().items() if t not in self.special}
        self.ranks = tiktoken.Encoding("forms", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.seen: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        forms = text.split(" ")
        forms[1:] = [" " + f for f in forms[1:]]
        try:
            return b"".join([self.seen[f] for f in forms])
        except KeyError:
            return b"".join([self.seen.get(f) or self.form(f) for f in forms])

    def form(self, form: str) -> bytes:
        ids = array("I", self.ranks.encode_ordinary(form)).tobytes()
        if len(self.seen) < REMEMBERED and len(form) < 64:
            self.seen[form] = ids
        return ids


def encoder(path: str) -> Encoder:
    if path not in _models:
        _models.clear()
        _models[path] = Encoder(path)
    return _models[path]


class Packer:
    """The open windows of one partition."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.most, self.next, self.open, self.done = size, windows, base, [], []

    def emit(self, pieces):
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((key, start, n, zlib.crc32(ids), total, self.next, offset, None))
            offset += n
        self.next += 1

    def add(self, key, start, ids, total):
        n, width = len(ids) // 4, self.size * 4
        while n >= self.size:
            self.emit([(key, start, ids[:width], total)])
            ids, start, n = ids[width:], start + self.size, n - self.size
        while n:
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [self.size, []]
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w[0])
            take = min(n, best[0])
            best[1].append((key, start, ids[: take * 4], total))
            best[0] -= take
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1])
            ids, start, n = ids[take * 4 :], start + take, n - take

    def merge(self):
        """The open windows put together, fullest first, into one at most."""
        left = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, self.most = [], 1
        for piece in left:
            self.add(*piece)

    def leave(self):
        for _, pieces in self.open:
            for key, start, ids, total in pieces:
                self.done.append((key, start, len(ids) // 4, zlib.crc32(ids), total, -1, 0, ids))
        self.open = []

    def close(self):
        """The last window: sequences whose sizes are powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        self.open = []
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                key, start, ids, total = pieces.pop(0)
                take = min(room, len(ids) // 4)
                now.append((key, start, ids[: take * 4], total))
                if take * 4 < len(ids):
                    pieces.insert(0, (key, start + take, ids[take * 4 :], total))
                room -= take
            self.emit(now)


def pack_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", size: int = 1024, windows: int = 16, end: int = 0) -> DataFrame:
    """Pieces of all rows' token ids (plus id ``end``) in sequences of at most
    ``size``: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. A text may be of any length.
    Repeated rows are packed each; of windows that fit equally well the oldest
    wins. Keys may be null. No other column is kept, so none can clash. What is
    left of all is cut at powers of two, so nothing is padded. An empty table
    gives no piece.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("text"))
    kind = source.schema["k"].dataType.simpleString()
    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
    schema = f"k {kind}, {PIECE}, ids binary, part long"
    last = np.array([end], "<u4").tobytes()

    def rows(done, part):
        return pd.DataFrame([(*d, part) for d in done], columns=names)

    def fill(batches):
        part = TaskContext.get().partitionId()
        model, packer = encoder(tokenizer), Packer(size, windows, part << 33)
        types = [batches_type, *[pa.int64()] * 6, pa.binary(), pa.int64()]

        def out():
            done, packer.done = packer.done, []
            cols = list(zip(*done)) if done else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip([*cols, [part] * len(done)], types)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                for k, body in zip(few.column(0).to_pylist(), few.column(1).fill_null("").to_pylist()):
                    ids = model.encode(body) + last
                    packer.add(k, 0, ids, len(ids) // 4)
            if len(packer.done):
                yield out()
        packer.merge()
        packer.leave()
        yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    batches_type = to_arrow_type(source.schema["k"].dataType)
    pieces = materialize(source.mapInArrow(fill, schema))

    def merged(base: int, final: bool):
        def run(group_key, frame: pd.DataFrame) -> pd.DataFrame:
            packer = Packer(size, 1, (1 << 62) + (base << 60) + (int(group_key[0]) << 30))
            frame = frame.sort_values(["part", "k", "start"])
            for k, start, ids, total in zip(frame["k"], frame["start"], frame["ids"], frame["doc_tokens"]):
                packer.add(k, start, ids, total)
            packer.close() if final else packer.leave()
            return rows(packer.done, int(group_key[0])).astype({"k": frame["k"].dtype})

        return run

    left = pieces.filter("sequence_id < 0")
    first = materialize(left.groupBy(F.floor(F.col("part") / 64).alias("g")).applyInPandas(merged(0, False), schema))
    second = first.filter("sequence_id < 0").groupBy(F.lit(0).alias("g")).applyInPandas(merged(1, True), schema)
    whole = pieces.filter("sequence_id >= 0").unionByName(first.filter("sequence_id >= 0")).unionByName(second)
    return whole.drop("ids", "part").withColumnRenamed("k", key)
