"""The chosen L1 against the same comparison by plain loops."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from solarloom.llm import toxicity as T


def test_choice(spark, monkeypatch):
    monkeypatch.setattr(T, "CHOICES", (0.5, 3.0, 60.0))
    rnd = random.Random(3)
    rows = []
    for k in range(260):
        y = int(rnd.random() < 0.3)
        rows.append((k, y, sorted({rnd.randrange(60) for _ in range(6)} | ({100 + rnd.randrange(3)} if y and rnd.random() < 0.9 else set()))))
    df = spark.createDataFrame(rows, "k long, y int, f array<int>")
    part = {r.k: r.m for r in df.select("k", F.expr(f"pmod(xxhash64(k, 11), {T.FOLDS})").alias("m")).collect()}
    losses = {}
    for l1 in T.CHOICES:
        sums = {0: [], 1: []}
        for fold in range(T.FOLDS):
            learn = pd.DataFrame([r for r in rows if part[r[0]] != fold], columns=["k", "y", "f"]).sort_values("k").sample(frac=1, random_state=1)
            w = T.ftrl([(np.array(f), y) for y, f in zip(learn["y"], learn["f"])], l1)
            for k, y, f in rows:
                if part[k] == fold:
                    p = 1 / (1 + math.exp(-(sum(w[i] for i in f) + w[-1])))
                    sums[y].append(-math.log(p if y else 1 - p))
        losses[l1] = sum(sum(v) / len(v) for v in sums.values())
    assert T.choose_l1(df) == min(losses, key=losses.get) != 60.0
    assert T.choose_l1(df.filter("y = 0 or k < 20")) == T.L1
