"""The forests of operator 2 learn from every labelled row, however many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from solarloom.llm import quality
from solarloom.llm.quality import fit, quality_rules


@pytest.fixture(scope="module")
def many(spark):
    """12 560 labelled rows; the bad ones are those of largest key hash."""
    ids = [r.id for r in spark.range(12_560).orderBy(F.xxhash64("id"), "id").collect()]
    rng = np.random.default_rng(5)
    rows = []
    for i, key in enumerate(ids):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 60)]
        if i >= 12_500:
            words[::3] = ["4711!"] * 20
            words[1::3] = [w + "9" for w in words[1::3]]
        rows.append((key, " ".join(words), int(i < 12_500)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8).cache()
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality")


def test_bad_rows_of_large_key_hash_are_learned(many):
    docs, labels = many
    out = quality_rules(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.sum((~F.col("kept") & ~F.col("base_failed")).cast("int")).alias("gone"), F.sum((~F.col("base_failed")).cast("int")).alias("n"))
    got = {r.quality: (r.gone, r.n) for r in out.collect()}
    assert got[0] == (60, 60)
    assert got[1][1] == 12_500 and got[1][0] < 100


def test_thresholds_are_those_of_all_rows(many):
    """By plain sorting of all scores, whatever the partitions."""
    docs, labels = many
    rows = docs.join(labels, "doc_id").collect()
    data, offsets = quality.text_buffer(quality.pa.array([r.text for r in rows]))
    x, y = quality.features(quality.rule_statistics(data, offsets)), np.array([r.quality for r in rows])
    found = fit(docs, labels, "text", "doc_id", "quality")
    assert found
    for columns, forest, cut in found:
        g, b = np.sort(forest.score(x[y == 1][:, columns])), np.sort(forest.score(x[y == 0][:, columns]))
        last = g[int(np.ceil(quality.KEEP * len(g))) - 1]
        assert cut == (last + b[b > last + 1e-9][0]) / 2
    again = fit(docs.repartition(3), labels.repartition(5), "text", "doc_id", "quality")
    assert [(c, t) for c, _, t in again] == [(c, t) for c, _, t in found]


def test_trees_draw_from_all_rows(spark):
    """Each tree has 241 good and 15 bad rows of its own; few rows: all."""
    seen = spark.range(40_000).select((F.col("id") >= 4_000).cast("long").alias("y"), F.xxhash64("id").alias("id"), *[F.col("id").cast("double").alias(c) for c in quality.FEATURES])
    draws = quality.draw(seen, 36_000, 4_000)
    assert len(draws) == quality.TREES
    for rows in draws:
        assert len(rows) == 256 == len(np.unique(rows[:, 0])) and (rows[:, 0] < 4_000).sum() == 15
    drawn = np.concatenate(draws)[:, 0]
    assert len(np.unique(drawn)) > 9_000 and abs(drawn[drawn >= 4_000].mean() - 22_000) < 500
    few = quality.draw(seen.filter("y = 1 and x0 < 4008"), 8, 0)
    assert len(few) == quality.TREES and all(len(rows) == 8 for rows in few)


def test_order_statistic(spark):
    rng = np.random.default_rng(6)
    each = [rng.random(3000), np.round(rng.random(3000), 2), np.full(3000, 0.5), 0.5 + rng.random(3000) * 1e-9]
    frame = spark.createDataFrame([(f, float(s)) for f, scores in enumerate(each) for s in scores], "forest int, score double")
    for rank in (1, 1500, 2999, 3000):
        assert quality.order_statistic(frame, rank, 4) == [np.sort(s)[rank - 1] for s in each]


def test_every_text_of_a_key_is_learned(spark):
    """The second text of a key counts as the first; repeated rows count once."""
    def text(i):
        return " ".join(f"w{i}x{j}" for j in range(60))

    docs = spark.createDataFrame([(i // 2, text(i)) for i in range(20)] + [(0, text(0)), (None, text(3)), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 1), (9, None)], "doc_id long, quality int")
    assert quality.labelled_features(docs, labels, "text", "doc_id", "quality").count() == 18
