"""URL rules by a bit-parallel wildcard automaton (operator 6).

Rules are globs over the canonical URL (lower-case host, then path): ``*`` is
any run without a slash, two or more stars any run. All globs are packed into the bits of
a few 64-bit words and simulated together over each URL, Shift-And with one
step per byte, for a whole batch of URLs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, text_buffer

#: The rules of the contract, as host and path prefix.
HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Where no host rule fits, any of these globs blocks; else the page is allowed.
BLOCK_GLOBS = ["*spam*/**", "*cheap-*/**", "**/login*", "**.exe", "**/ads/**"]


class Automaton:
    """Shift-And masks of all globs. State bits stand before each token; a
    star's bit stays set while its run goes on."""

    def __init__(self, globs: list[str]):
        tokens, self.first, self.last = [], [], []
        for glob in globs:
            self.first.append(len(tokens))
            i, raw = 0, glob.encode()
            while i < len(raw):
                if raw[i] == 42:
                    stars = len(raw[i:]) - len(raw[i:].lstrip(b"*"))
                    tokens.append("**" if stars > 1 else "*")
                    i += stars
                else:
                    tokens.append(raw[i])
                    i += 1
            self.last.append(len(tokens))
            tokens.append(None)
        self.words = len(tokens) // 64 + 1
        self.match, self.stay = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        self.pass_ = np.zeros(self.words, np.uint64)
        for i, token in enumerate(tokens):
            bit, word = np.uint64(1 << (i % 64)), i // 64
            if token in ("*", "**"):
                self.pass_[word] |= bit
                self.stay[:, word] |= bit
                if token == "*":
                    self.stay[47, word] &= ~bit
            elif token is not None:
                self.match[token, word] |= bit
        self.start = np.zeros(self.words, np.uint64)
        for i in self.first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))
        self.start = self._skip(self.start[None, :])[0]

    @staticmethod
    def _shift(x: np.ndarray) -> np.ndarray:
        out = x << np.uint64(1)
        out[:, 1:] |= x[:, :-1] >> np.uint64(63)
        return out

    def _skip(self, state: np.ndarray) -> np.ndarray:
        """A star may be empty: its state passes on to the next."""
        return state | self._shift(state & self.pass_)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(string, glob) mask of the globs that match whole strings."""
        n = len(starts)
        order = np.argsort(starts - ends, kind="stable")
        begin, size = starts[order], (ends - starts)[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -i, "left"))
            now, c = state[:live], data[begin[:live] + i]
            state[:live] = self._skip(self._shift(now & self.match[c]) | (now & self.stay[c]))
        out = np.zeros((n, len(self.last)), bool)
        for g, i in enumerate(self.last):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) > 0
        return out


def filter_urls(pages: DataFrame, url: str = "url", host_rules=None, block_globs=None) -> DataFrame:
    """All columns of ``pages`` with host, path, rule (the longest host rule
    that fits, else null) and verdict (that rule's; without one ``block`` where
    a glob matches, else ``allow``).

    Null or malformed url: host and path are empty, no rule. A url may be of
    any length. Repeated rows are judged each; of rules of one length the first
    wins. Extra columns of any name are kept, but those named like the added
    ones are replaced. Empty table: empty result.
    """
    bounded_batches(pages.sparkSession)
    rules = sorted(host_rules or HOST_RULES, key=lambda r: -len(r[0]))
    globs = [g for rule, _ in rules for g in (f"{rule}**", f"*.{rule}**")] + list(BLOCK_GLOBS if block_globs is None else block_globs)
    machine = pages.sparkSession.sparkContext.broadcast(Automaton(globs))
    added = StructType.fromDDL("host string, path string, rule string, verdict string")
    rest = F.expr(f"case when locate('://', `{url}`) > 0 then substring(`{url}`, locate('://', `{url}`) + 3) else '' end")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    taken = {n.lower() for n in added.names}
    source = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken], F.coalesce(lowered, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    schema = StructType(source.schema.fields + added.fields[2:])
    source = source.select("*", F.concat("host", "path"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            found = machine.value.run(data, offsets[:-1], offsets[1:])
            fits = found[:, 0 : 2 * len(rules) : 2] | found[:, 1 : 2 * len(rules) : 2]
            any_, best = fits.any(axis=1), fits.argmax(axis=1)
            blocked = found[:, 2 * len(rules):].any(axis=1)
            rule = [rules[b][0] if a else None for a, b in zip(any_, best)]
            verdict = [rules[b][1] if a else "block" if x else "allow" for a, b, x in zip(any_, best, blocked)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
