"""Different words and lines that collide in any polynomial hash modulo a
power of two, and the operators that must tell them apart."""

import numpy as np
import pyarrow as pa
import pytest

from solarloom.llm import repeats
from solarloom.llm.common import content_hashes, text_buffer, word_numbers, word_spans
from solarloom.llm.contamination import decontaminate
from solarloom.llm.quality import rule_statistics
from solarloom.llm.suffix_arrays import suffix_array_dedup
from solarloom.llm.suffix_trees import substring_dedup


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


ONE, OTHER = thue_morse(1024, "ab"), thue_morse(1024, "ba")


def test_word_numbers():
    texts = ["a bb  a", "bb a", None, " \n", f"{ONE} {OTHER}", "x" * 3]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = word_spans(data, offsets)
    numbers, words = word_numbers(data, starts, ends)
    said = [words[int(i)].as_py().decode() for i in numbers]
    assert said == " ".join(t or "" for t in texts).split() and len(set(said)) == len(words)
    assert len(set(content_hashes(words).tolist())) == len(words)
    none = word_numbers(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(none[0]) == len(none[1]) == 0


def test_substrings(spark):
    around = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(i, " ".join(around[:17] + [w] + around[17:])) for i, w in enumerate((ONE, OTHER, OTHER))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()) == [(0, 0), (1, 35), (2, 35)]
    bodies = spark.createDataFrame([(0, ONE), (1, OTHER)], "doc_id long, text string")
    want = {0: ONE, 1: OTHER}
    windows = [want[d][i : i + 600] for d in want for i in range(425)]
    twice = {w for w in windows if windows.count(w) > 1}
    gone = {d: set() for d in want}
    for d in want:
        for i in range(425):
            if want[d][i : i + 600] in twice:
                gone[d] |= set(range(i, i + 600))
    assert {r.doc_id: r.n_removed for r in suffix_array_dedup(bodies, length=600).collect()} == {d: len(g) for d, g in gone.items()}


@pytest.mark.parametrize("hot", [1, 20_000])
def test_hot_seeds(spark, hot):
    from solarloom.llm.suffix_trees import repeated_starts

    around = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(i, " ".join(around[:20] + [w] + around[20:] + [f"z{i}"])) for i, w in enumerate((ONE, OTHER))], "doc_id long, text string")
    assert repeats.find_repeats(docs, repeats.Words, 35, 8, repeated_starts, hot=hot).count() == 0


def test_benchmark(spark):
    item = [f"w{i}" for i in range(9)] + [ONE]
    docs = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[:9] + [OTHER]))], "doc_id long, text string")
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in decontaminate(docs, bench).collect()) == [(0, 10, True), (1, 0, False)]


def test_lines_and_words():
    data, offsets = text_buffer(pa.array([f"{ONE}\n{OTHER}\n{ONE}", f"{ONE} x y {OTHER} x y {ONE} x y", "a\r\na\n a"]))
    s = rule_statistics(data, offsets)
    assert s["n_dup_lines"].tolist() == [1, 0, 0] and s["n_repeat_words"].tolist() == [0, 6, 0]
