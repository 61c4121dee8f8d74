"""Quality rules with an isolation forest on rule statistics (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import SPACE, bounded_batches, discard, materialize, mix, numbered, row_chunks, slot, text_buffer, word_numbers, word_spans

#: The method's own numbers: trees of a forest, rows that each of them draws
#: anew out of all labelled rows, and its depth.
TREES, SUBSAMPLE, DEPTH = 50, 256, 12
#: Share of the labelled good rows that the threshold has to keep.
KEEP = 0.9995
RARE, WORTH = 16, 0.02

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER_UP = np.zeros(256, bool)
LETTER_UP[65:91] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?.,;:-_/=+@^~\"'()[]{}")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
FEATURES = [f"x{i}" for i in range(8)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its (row, value) occurs twice or more, and
    whether an earlier element has it. Values are small numbers."""
    key = row * (value.max(initial=0) + 1) + value
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    later[by[1:]] = same
    return twice, later


def rule_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of consecutive rows, as arrays."""
    n = len(offsets) - 1
    base = int(offsets[0])
    part, cuts = data[base : int(offsets[-1])], offsets - base
    starts, ends, rows = word_spans(part, cuts)
    row = np.repeat(np.arange(n), np.diff(rows))

    def per_row(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[cuts[1:]] - total[cuts[:-1]]

    out = {"n_words": np.diff(rows), "word_chars": per_row(((part & 0xC0) != 0x80) & ~SPACE[part]), "n_symbols": per_row(SYMBOL[part]),
           "upper": per_row(LETTER_UP[part]), "marks": per_row(MARK[part]), "digits": per_row(DIGIT[part])}
    # Lines: cut at \n and at row ends; a line counts if it has a word.
    breaks = np.flatnonzero(part == 10)
    begin = np.unique(np.concatenate((cuts[:-1], breaks + 1)))
    begin = begin[begin < len(part)]
    stop = np.minimum(cuts[np.searchsorted(cuts, begin, "right")], np.append(breaks, len(part))[np.searchsorted(breaks, begin)]) if len(part) else begin
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[worded], stop[worded]
    line_row = np.searchsorted(cuts, begin, "right") - 1
    _, later = repeated(line_row, word_numbers(part, begin, stop)[0])
    out["n_dup_lines"] = np.bincount(line_row, later, n).astype(np.int64)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    numbers, words = word_numbers(part, starts, ends)
    _, again = repeated(row, numbers)
    out["n_again"] = np.bincount(row, again, n).astype(np.int64)
    hit = np.zeros(len(numbers), bool)
    if len(numbers) > 2:
        ok = np.flatnonzero(row[2:] == row[:-2])
        pair = np.unique(numbers[ok] * len(words) + numbers[ok + 1], return_inverse=True)[1]
        gram = pair * len(words) + numbers[ok + 2]
        at = ok[repeated(row[ok], gram)[0]]
        hit[at] = hit[at + 1] = hit[at + 2] = True
    out["n_repeat_words"] = np.bincount(row, hit, n).astype(np.int64)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees of the rule statistics."""
    words, chars = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    return np.stack([
        s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(1, s["n_lines"]), s["n_repeat_words"] / words,
        s["upper"] / chars, s["marks"] / chars, s["digits"] / chars, s["n_again"] / words / np.log(words + 2)], axis=1)


class IsolationForest:
    """Random split trees over SUBSAMPLE rows each, in arrays. ``x`` are rows
    to draw from, or a list with the rows of each tree."""

    def __init__(self, x: np.ndarray | list[np.ndarray], seed: int = 1):
        rng = np.random.default_rng(seed)
        if isinstance(x, list):
            self.size = len(x[0])
            self.trees = [self._grow(rows, rng) for rows in x]
        else:
            self.size = min(SUBSAMPLE, len(x))
            self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(TREES)]

    @staticmethod
    def _average(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x, rng):
        """feature, split, left child (right is the next) and the path length
        that ends in each node: its depth, and for a leaf of several rows the
        average depth of a tree of them."""
        feature, split, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            length[at] = depth + self._average(len(rows))
            wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < DEPTH else []
            if not len(wide):
                continue
            f = rng.choice(wide)
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[at], split[at], left[at] = f, cut, len(feature)
            for half in (rows[rows[:, f] < cut], rows[rows[:, f] >= cut]):
                child = len(feature)
                feature.append(-1), split.append(0.0), left.append(child), length.append(0.0)
                todo.append((child, half, depth + 1))
        return tuple(map(np.array, (feature, split, left, length)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected): higher is more anomalous."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                go = f >= 0
                if not go.any():
                    break
                node = np.where(go, left[node] + (x[every, np.maximum(f, 0)] >= split[node]), node)
            total += length[node]
        return 2 ** (-total / len(self.trees) / max(self._average(self.size), 1e-9))


def _each(batch_column):
    data, offsets = text_buffer(batch_column)
    found = [rule_statistics(data, offsets[lo : hi + 1]) for lo, hi in row_chunks(offsets)]
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else None


def base_failure(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def labelled_features(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """Label ``y``, hash ``id`` and features of all labelled rows that pass the
    base rules, a text of a key once. The texts are read where they lie: only
    their features are shuffled."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("long").alias("y")).filter("y in (0, 1)")
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("text")).filter("k is not null").select("k", F.xxhash64("text").alias("th"), "text")
    schema = StructType([rows.schema["k"], rows.schema["th"]] + StructType.fromDDL(", ".join(f"{c} double" for c in FEATURES)).fields)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = _each(batch.column(2))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c) for c in features(s).T]], names=schema.names).filter(pa.array(~base_failure(s)))

    seen = rows.mapInArrow(run, schema).join(known, "k").select("k", "th", "y", *FEATURES).distinct()
    return seen.select("y", F.xxhash64("k", "th").alias("id"), *FEATURES)


def _matrix(batch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in columns], axis=1)


def draw(seen: DataFrame, good: int, bad: int) -> list[np.ndarray]:
    """The rows of each tree: of all good rows and one bad row in RARE those of
    smallest hash under the tree's salt, so that each tree has a draw of its
    own, whatever the partitions. Tasks send on the rows under a bound that
    leaves a tree too few under once in 10**12."""
    rare = min(bad, max(1, good // RARE))
    size = min(SUBSAMPLE, good + rare)
    n_bad = round(size * rare / (good + rare))
    need, salts = {1: size - n_bad, 0: n_bad}, mix(np.arange(1, TREES + 1, dtype=np.uint64))
    share = {y: (n + 10 * n**0.5 + 20) / max(1, total) for (y, n), total in zip(need.items(), (good, bad))}
    bound = {y: np.uint64(2**64 - 1 if p >= 1 else int(p * 2**64)) for y, p in share.items()}

    def run(batches):
        for batch in batches:
            y, key = batch.column("y").to_numpy(), batch.column("id").to_numpy().view(np.uint64)
            most = np.where(y == 1, bound[1], bound[0])
            for tree, salt in enumerate(salts):
                u = mix(key ^ salt)
                at = np.flatnonzero(u <= most)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree, np.int32)), pa.array((u[at] >> np.uint64(1)).view(np.int64)), *batch.select(["y", *FEATURES]).take(pa.array(at)).columns], names=["tree", "u", "y", *FEATURES])

    drawn = seen.mapInArrow(run, "tree int, u long, y long, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    drawn = drawn.sort_values(["tree", "y", "u", *FEATURES])
    first = drawn[drawn.groupby(["tree", "y"]).cumcount() < drawn["y"].map(need)]
    return [rows[FEATURES].to_numpy() for _, rows in first.groupby("tree")]


def order_statistic(scores: DataFrame, rank: int, forests: int) -> list[float]:
    """The ``rank``-th smallest ``score`` of each ``forest`` (scores from 0 to
    1), exactly: by counts of 4096 bins, of 4096 bins of the one that holds it,
    then of that one's values."""
    at, left, rows = [], [rank] * forests, scores
    for value in (F.floor(F.col("score") * 2**12), F.floor(F.col("score") * 2**24), F.col("score")):
        counts = [{} for _ in range(forests)]
        for r in rows.groupBy("forest", value.alias("v")).count().collect():
            counts[r["forest"]][r["v"]] = r["count"]
        at = []
        for f, mine in enumerate(counts):
            for v in sorted(mine):
                if left[f] <= mine[v]:
                    break
                left[f] -= mine[v]
            at.append(v)
        rows = rows.filter(value == F.get(F.array(*map(F.lit, at)), F.col("forest")))
    return at


def fit(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str):
    """Forests and thresholds from all labelled rows: one forest for each
    statistic and one for all together. They grow on good rows with one bad row
    in RARE, so that bad ones are isolated early; each threshold keeps the
    share KEEP of the good rows, and a forest that catches under the share
    WORTH of the bad ones is left out. Under 8 good or 3 bad rows: no forest,
    only the base rules decide."""
    seen = materialize(labelled_features(docs, labels, text, key, label))
    count = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    good, bad = count.get(1, 0), count.get(0, 0)
    if good < 8 or bad < 3:
        discard(seen)
        return []
    draws = draw(seen, good, bad)
    columns = [[i] for i in range(len(FEATURES))] + [list(range(len(FEATURES)))]
    forests = [IsolationForest([rows[:, c] for rows in draws], i) for i, c in enumerate(columns)]
    shared = seen.sparkSession.sparkContext.broadcast((columns, forests))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(forest.score(x[:, c])) for c, forest in zip(*shared.value)]], names=["y", *names])

    names = [f"s{i}" for i in range(len(columns))]
    scored = materialize(seen.mapInArrow(run, "y long, " + ", ".join(f"{n} double" for n in names)))
    each = scored.select("y", F.posexplode(F.array(*names)).alias("forest", "score"))
    # The lowest cut that keeps the share KEEP of the good rows, moved up to
    # halfway between the last good row kept and the next bad one.
    last = order_statistic(each.filter("y = 1"), max(1, int(np.ceil(KEEP * good))), len(columns))
    over = each.filter((F.col("y") == 0) & (F.col("score") > F.get(F.array(*map(F.lit, last)), F.col("forest")) + 1e-9))
    caught = {r["forest"]: (r["n"], r["next"]) for r in over.groupBy("forest").agg(F.count("*").alias("n"), F.min("score").alias("next")).collect()}
    discard(seen, scored)
    shared.unpersist()
    return [(columns[i], forests[i], (last[i] + caught[i][1]) / 2) for i in sorted(caught) if caught[i][0] >= max(3, WORTH * bad)]


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and anomaly (the largest
    forest score as a share of its threshold, 0 without forests).

    Null or empty text: no words, base fails; a text may be of any length.
    Repeated rows are judged each, null keys too; the forests learn from all
    texts of a labelled key, once from each. Without labels the base
    rules alone decide. Empty table: empty result. Extra columns of any name are kept, but
    those named like the added ones are replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, key, label))
    added = StructType.fromDDL(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double")
    source, names = numbered(docs, added.names)
    schema = StructType([StructField(name, f.dataType, f.nullable, f.metadata) for name, f in zip(names, source.schema.fields)] + added.fields)
    at = int(slot(names, text)[1:])

    def run(batches):
        forests = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _each(batch.column(at))
            failed = base_failure(s)
            x, odd = features(s), np.zeros(batch.num_rows)
            for columns, forest, most in forests:
                odd = np.maximum(odd, forest.score(x[:, columns]) / most)
            new = [pa.array(s[c].astype(np.int64)) for c in BASE] + [pa.array(failed), pa.array(~failed & (odd < 1)), pa.array(odd)]
            yield pa.RecordBatch.from_arrays(batch.columns + new, names=schema.names)

    return source.mapInArrow(run, schema)
