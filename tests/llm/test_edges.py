"""Null keys, long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from solarloom.llm import repeats, simhash
from solarloom.llm.contamination import decontaminate
from solarloom.llm.languages import identify_language
from solarloom.llm.packing import pack_tokens
from solarloom.llm.quality import quality_rules
from solarloom.llm.quotations import link_quotations
from solarloom.llm.simhash import simhash_components, simhash_dedup
from solarloom.llm.suffix_arrays import suffix_array_dedup
from solarloom.llm.suffix_trees import substring_dedup
from solarloom.llm.toxicity import score_toxicity
from solarloom.llm.url_rules import Automaton, filter_urls

#: Names that the operators use inside.
NAMES = ["k", "th", "f", "t", "c0", "C1", "k1", "th1", "__k", "__th", "__f", "__to", "hit", "items", "row", "again", "hash", "passages", "parent", "root", "found", "__c", "__h", "lines", "y", "at", "one"]


def wide(spark, rows, schema):
    names = [c.split()[0].lower() for c in schema.split(", ")]
    extra = [n for n in NAMES if n.lower() not in names]
    return spark.createDataFrame([(*r, *extra) for r in rows], schema + "".join(f", `{n}` string" for n in extra)), extra


def test_clashing_names(spark):
    text = " ".join(f"w{i % 37}" for i in range(120))
    docs, extra = wide(spark, [(1, text), (None, text), (3, None), (1, text), (1, "another text")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", text[:60])], "item_id string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (suffix_array_dedup(docs, length=50), substring_dedup(docs), decontaminate(docs, bench), quality_rules(docs, none)):
        rows = out.collect()
        assert len(rows) == 5 and all(r[n] == n for r in rows for n in extra)
    kept = simhash_dedup(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, text), (3, ""), (1, "another text")]) and all(r[n] == n for r in kept for n in extra)
    talk, extra = wide(spark, [(1, 0, "hello"), (1, 1, "> hello\nyes"), (None, None, None)], "conv_id int, turn int, text string")
    assert sorted((r.turn, r.parent_turn) for r in link_quotations(talk).collect() if r.turn is not None) == [(0, None), (1, 0)]
    assert all(r[n] == n for r in link_quotations(talk).collect() for n in extra)
    pages, extra = wide(spark, [(1, "http://a.com/x"), (None, None)], "page_id int, url string")
    assert all(r[n] == n for r in filter_urls(pages).collect() for n in extra)


def test_named_like_a_result(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, KEPT string, N_Removed int")
    out = substring_dedup(docs)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept"] and out.first().kept == "a b"


def test_long_texts_come_in_pieces(spark):
    """Over two pieces of 2**19 words."""
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(1_200_000))
    docs = [(0, long), (1, " ".join(long.split()[700_000:700_050]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {0: (1_200_000, 50), 1: (50, 50)}


@pytest.mark.parametrize("unit", [repeats.Bytes, repeats.Words])
def test_pieces_cover_every_window_once(unit, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    rnd = random.Random(2)
    text = " ".join(rnd.choice("abc") * rnd.randrange(1, 4) for _ in range(900)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    units = len(text) if unit is repeats.Bytes else len(text.split())
    seen = Counter()
    for _, codes, rows, shift in repeats._pieces(unit, data, offsets, 20):
        found = repeats.segments(codes, rows, 20, 5)
        if found is None:  # the last piece may be shorter than a window
            continue
        _, first, count, _, _ = found
        for a, n in zip(first + shift, count):
            seen.update(range(a, a + n))
    assert seen == Counter(range(units - 19))


def test_hot_bytes_are_split_exactly(spark):
    from solarloom.llm.suffix_arrays import repeated_starts

    rnd = random.Random(3)
    base = bytes(rnd.choice(b"abcd") for _ in range(300)).decode()
    rows = [(i, base[i : i + 120] + chr(97 + i % 3) * (i % 5)) for i in range(40)] + [(0, base[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def flat(df):
        return sorted((r.k, r.th, tuple(sorted({x for a, b in zip(r.f, r.t) for x in range(a, b)}))) for r in df.collect())

    assert flat(repeats.find_repeats(docs, repeats.Bytes, 60, 12, repeated_starts, hot=1)) == flat(repeats.find_repeats(docs, repeats.Bytes, 60, 12, repeated_starts))


def test_repeated_rows_are_gathered_once(spark):
    text = " ".join(f"w{i % 50}x{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, text[:300])], "doc_id long, text string")
    from solarloom.llm.suffix_trees import repeated_starts

    found = repeats.find_repeats(docs, repeats.Words, 35, 8, repeated_starts).collect()
    assert all(len(r.f) < 100 for r in found)
    out = substring_dedup(docs).collect()
    assert {r.n_removed for r in out if r.doc_id == 1} == {90} and len(out) == 301 and {r.kept_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}


def test_shards_are_split_without_loss(spark, monkeypatch):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(6)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")

    def groups(edges):
        root = {p: p for p in signed}
        for _ in range(30):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = groups([(a, b) for a, p in zip(signed, prints) for b, q in zip(signed, prints) if (p ^ q).bit_count() <= 3])
    for hot in (20_000, 2):
        monkeypatch.setattr(simhash, "HOT_SHARD", hot)
        assert groups([(r.a, r.b) for r in simhash.link(df).collect()]) == want


def test_ties(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert {r.component_id for r in simhash_components(docs).collect()} == {2}
    assert [tuple(r) for r in simhash_dedup(docs).collect()] == [(2, "a b c d")]
    two = spark.createDataFrame([(1, "aaa bbb", "x"), (2, "aaa bbb", "y"), (3, "aaa bbb", None)], "doc_id long, text string, lang string")
    assert len({r.lang_pred for r in identify_language(two).collect()}) == 1


def test_stars():
    data = [b"", b"a", b"ab", b"a/b", b"aab"]
    at = np.cumsum([0, *map(len, data)])
    got = Automaton(["a***b", "a*b", "***", "*"]).run(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:]).tolist()
    assert got == [[False, False, True, True], [False, False, True, True], [True, True, True, True], [True, False, True, False], [True, True, True, True]]


def test_empty_tables(spark):
    import public_tokenizers

    talk = spark.createDataFrame([], "conv_id int, turn int, text string")
    assert link_quotations(talk).count() == 0
    assert filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert {r.n_hit for r in decontaminate(docs, spark.createDataFrame([], "item_id int, text string")).collect()} == {0}
    assert {r.score for r in score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.5}
    assert pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).filter("doc_id is null").first().length == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from solarloom.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(far)
