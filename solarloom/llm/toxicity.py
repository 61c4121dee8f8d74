"""Toxicity scores by FTRL-proximal logistic regression over hashed word
n-grams and skip-grams (operator 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, mix, row_chunks, text_buffer
from .contamination import lowered_words

BITS = 22
#: Labelled rows that the model learns from at most.
SAMPLE = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 10.0, 0.5, 4
#: L1 is one of these, the best on FOLDS parts of the learnable rows that the
#: model of the other parts has not seen; with under LEAST_TOXIC toxic rows
#: there is nothing to compare and it is L1.
CHOICES, FOLDS, LEAST_TOXIC = (5.0, 10.0, 20.0, 40.0), 3, 30
#: Rows that a feature has to occur in to be learned.
LEAST_ROWS = 3


def grams(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words, word pairs and pairs with one word between
    of consecutive rows."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    who, what = [row], [hashes]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        pair = mix(hashes[: max(0, len(hashes) - gap)] * np.uint64(salt) + hashes[gap:])
        who.append(row[: max(0, len(row) - gap)][same])
        what.append(pair[same])
    return np.concatenate(who), (np.concatenate(what) >> np.uint64(64 - BITS)).astype(np.int64)


def presence(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique((row << BITS) | feature)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def ftrl(samples: list[tuple[np.ndarray, int]], l1: float = L1) -> np.ndarray:
    """Dense weights (last: the intercept) after EPOCHS passes: per-coordinate
    rates from the squared gradients, L1 that keeps weak coordinates at 0. The
    rarer class weighs more, by the root of the classes' ratio."""
    often = np.zeros(1 << BITS, np.int32)
    for features, _ in samples:
        often[features] += 1
    samples = [(features[often[features] >= LEAST_ROWS], label) for features, label in samples]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        shrunk = np.sign(z[i]) * l1 - z[i]
        return np.where(np.abs(z[i]) <= l1, 0.0, shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    toxic = sum(label for _, label in samples)
    rare = min(4.0, ((len(samples) - toxic) / max(1, toxic)) ** 0.5)

    for _ in range(EPOCHS):
        for features, label in samples:
            i = np.append(features, 1 << BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            g *= rare if label else 1.0
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rate * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def balanced_loss(weights: np.ndarray, samples: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """Sums of the log loss of toxic and of other samples."""
    out = [0.0, 0.0]
    for features, label in samples:
        margin = (weights[features].sum() + weights[-1]) * (1 if label else -1)
        out[0 if label else 1] += float(np.logaddexp(0.0, -margin))
    return out[0], out[1]


def labelled_features(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(k, y, f): of at most SAMPLE rows, those of the labelled keys of
    smallest hash that are not held out and of each key the first text, the
    label and the features. Only features leave the tasks that read texts."""
    keys = labels[f"`{key}`"]
    chosen = labels.filter(labels[f"`{label}`"].isNotNull() & (F.crc32(keys.cast("string")) % 5 != 0)).groupBy(keys.alias("k")).agg(F.max(labels[f"`{label}`"]).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("text")).join(F.broadcast(chosen), "k").distinct()
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("text"))).filter("at = 1").select("k", F.col("y").cast("int").alias("y"), "text")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            found = []
            for lo, hi in row_chunks(offsets):
                row, feature = presence(*grams(*lowered_words(data, offsets[lo : hi + 1])))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                found += [feature[at[i] : at[i + 1]].astype(np.int32) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["k", "y", "f"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, y int, f array<int>")


def _samples(frame: pd.DataFrame) -> list[tuple[np.ndarray, int]]:
    frame = frame.sort_values("k").sample(frac=1, random_state=1)
    return [(np.asarray(f, np.int64), int(y)) for f, y in zip(frame["f"], frame["y"])]


def choose_l1(rows: DataFrame) -> float:
    """The L1 of CHOICES with the least balanced log loss on rows that its
    models did not learn from: a task for each of FOLDS parts, none of which
    holds a held-out row."""
    toxic = rows.agg(F.sum("y")).first()[0] or 0
    if toxic < LEAST_TOXIC:
        return L1
    parts = rows.withColumn("mine", F.expr(f"pmod(xxhash64(k, 11), {FOLDS})")).select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))

    def judge(key, frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame["mine"] == key[0]
        learn, rest = _samples(frame[~mine]), _samples(frame[mine])
        losses = [balanced_loss(ftrl(learn, l1), rest) for l1 in CHOICES]
        toxic = sum(y for _, y in rest)
        return pd.DataFrame([(l1, a, b, toxic, len(rest) - toxic) for l1, (a, b) in zip(CHOICES, losses)], columns=["l1", "a", "b", "toxic", "others"])

    found = parts.groupBy("fold").applyInPandas(judge, "l1 double, a double, b double, toxic long, others long").toPandas().groupby("l1").sum()
    return float((found["a"] / found["toxic"].clip(1) + found["b"] / found["others"].clip(1)).idxmin())


def train(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, l1: float | None = None) -> np.ndarray:
    """Weights learned in one task from the ``labelled_features``, with the L1
    given or chosen. The weights are at most 2**BITS numbers, most of them
    zero, so they can be broadcast."""
    rows = materialize(labelled_features(docs, labels, text, key, label))
    if l1 is None:
        l1 = choose_l1(rows)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        w = ftrl(_samples(frame), l1)
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": i, "w": w[i]})

    found = rows.groupBy(F.lit(0).alias("g")).applyInPandas(learn, "i long, w double").toPandas()
    discard(rows)
    weights = np.zeros((1 << BITS) + 1)
    weights[found["i"].to_numpy(np.int64)] = found["w"].to_numpy(float)
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", l1: float | None = None) -> DataFrame:
    """Key, held_out, score in 0..1 and predicted (score >= 0.5) of every whole
    text, of any length; no other column is kept, so none can clash. Null or
    empty text: the score of the intercept alone. A null key is not held out
    and never learned from; of labels that contradict each other the larger
    holds. Repeated rows are scored each; with no label at all every score is
    0.5. Empty table: empty result."""
    bounded_batches(docs.sparkSession)
    weights = train(docs, labels, text, key, label, l1)
    spark = docs.sparkSession
    at = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((at, weights[at]))
    keys = docs[f"`{key}`"]
    source = docs.select(keys.alias("k"), F.coalesce(F.crc32(keys.cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), docs[f"`{text}`"].alias("text"))

    def run(batches):
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        used = w != 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            logit = np.full(batch.num_rows, float(w[-1]))
            for lo, hi in row_chunks(offsets):
                row, feature = grams(*lowered_words(data, offsets[lo : hi + 1]))
                live = used[feature]
                row, feature = presence(row[live], feature[live])
                logit[lo:hi] += np.bincount(row, w[feature], hi - lo)
            score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["k", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("k", key)
