"""The text operators against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from solarloom.llm.contamination import decontaminate
from solarloom.llm.languages import identify_language
from solarloom.llm.packing import pack_tokens
from solarloom.llm.quality import quality_rules
from solarloom.llm.quotations import link_quotations
from solarloom.llm.simhash import simhash_components, simhash_dedup
from solarloom.llm.suffix_arrays import repeated_starts, suffix_array_dedup
from solarloom.llm.suffix_trees import substring_dedup
from solarloom.llm.toxicity import score_toxicity
from solarloom.llm.url_rules import Automaton, filter_urls

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


PASSAGE = prose(60)
TEXTS = [None, "", "  \n ", "one", "ü \x00 x", PASSAGE, PASSAGE, prose(40) + " " + PASSAGE, PASSAGE + "\t" + prose(30), "a " * 300, prose(3000), prose(80) + "\n" + PASSAGE[:200]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"{i}", 1, 2) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, f int, k int")


def brute(units, length):
    count = Counter(u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if count[u[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_repeats(spark, docs, kind):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    units = [t if kind == "bytes" else tuple(t.split()) for _, t in rows]
    length = 100 if kind == "bytes" else 35
    got = (suffix_array_dedup if kind == "bytes" else substring_dedup)(docs, length=length)
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, length)):
        kept = [x for x, g in zip(u, gone) if not g]
        want.append((i, len(u), sum(gone), hashlib.sha256(bytes(kept) if kind == "bytes" else b" ".join(kept)).hexdigest()))
    assert sorted((r[0], r["n_bytes" if kind == "bytes" else "n_words"], r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(want)
    assert {"f", "k"} <= set(got.columns)


def test_bwt_intervals():
    for _ in range(20):
        parts = [bytes(random.choice(b"ab") for _ in range(random.randrange(1, 60))) for _ in range(6)]
        for n in (8, 10, 13):
            count = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
            assert [m.tolist() for m in repeated_starts(parts, n)] == [[count[p[i : i + n]] > 1 for i in range(len(p) - n + 1)] for p in parts]


def test_hot_groups_are_split_exactly(spark, docs):
    from solarloom.llm.repeats import Words, find_repeats
    from solarloom.llm.suffix_trees import repeated_starts as trees

    def flat(df):
        return sorted((r.k, sorted({x for a, b in zip(r.f, r.t) for x in range(a, b)})) for r in df.collect())

    assert flat(find_repeats(docs, Words, 35, 8, trees, hot=1)) == flat(find_repeats(docs, Words, 35, 8, trees))


def test_simhash(spark, docs):
    got = sorted(simhash_components(docs).collect(), key=lambda r: r.doc_id)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert len(got) == len(TEXTS) + 1 and prints[0] == prints[1] == prints[2] == 0
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in got} == root
    assert simhash_dedup(docs).count() == len(set(root.values()))


def test_decontaminate(spark, docs, monkeypatch):
    from solarloom.llm import contamination

    items = [("a", " ".join(PASSAGE.split()[5:30])), ("b", "ONE"), ("c", None), ("d", "nothing like it here at all"), ("a2", PASSAGE)]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def run():
        return sorted(map(tuple, decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated", "longest", "items_sha256").collect()))

    whole = run()
    by = {r[0]: r for r in whole}
    assert by[3][1:6] == (1, 1, 1, True, 1) and by[0][1:6] == (0, 0, 0, False, 0)
    assert by[5][1:6] == (60, 60, 2, True, 60) and by[10][4] is False
    monkeypatch.setattr(contamination, "BLOCK", 200)  # several blocks give the same
    assert [r[:5] + r[6:] for r in run()] == [r[:5] + r[6:] for r in whole]


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "a  b \n c\n\n d <|endoftext|> it's  "), (101, " x y 'll "), (102, "déjà \t vu\n z")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").filter("doc_id <> 5").unionByName(extra)
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    got = pack_tokens(rows, path, size=64, windows=2).collect()
    for k, t in text.items():
        ids = np.array(model.encode(t, add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == k)
        at = 0
        for start, n, crc, total in mine:
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + n].tobytes()))
            at += n
        assert at == len(ids)
    size = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size[r.sequence_id]
        size[r.sequence_id] += r.length
    assert all(n <= 64 and n & (n - 1) == 0 for n in size.values())


def test_scores(spark):
    good = ["the house and the garden were quiet " + prose(20) for _ in range(120)]
    bad = ["you idiot moron " + prose(20) for _ in range(120)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in good] + [(t, "xx") for t in bad] + [(None, None), ("", "en"), ("123 !", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(240)], "doc_id long, quality int, toxic int")
    out = score_toxicity(df, labels).collect()
    assert all(0 <= r.score <= 1 for r in out) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    assert sum(r.predicted == int(r.doc_id >= 120) for r in out if r.doc_id < 240) >= 235
    langs = {r.doc_id: r.lang_pred for r in identify_language(df).collect()}
    assert [langs[i] for i in (240, 241, 242)] == ["und"] * 3
    assert sum(langs[i] == ("en" if i < 120 else "xx") for i in range(240)) >= 230


def test_quality(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, none).collect()}
    assert (got[0].n_words, got[0].base_failed, got[9].n_repeat_words, got[9].kept) == (0, True, 300, False)
    assert got[5].kept and got[4].word_chars == 3
    lines = spark.createDataFrame([(1, "a b\n\nc\na b\r\na b\n a b\na b")], "doc_id long, text string")
    assert quality_rules(lines, none).first().n_dup_lines == 2


def test_urls(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/x", "http://a.www.example.com/en/?q", "https://x.net/es/1#f", "ftp://net/fr/", "http://foo.net/x.example.com/en/", "http://com", "http://spam-farm.org/a"]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow"), (None, "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "block")]
    globs = ["a*c", "**z" * 30, "x", "*"]
    texts = [b"abc", b"a/c", b"x", b"", b"zz" * 40]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert Automaton(globs).run(data, at[:-1], at[1:]).tolist() == [[True, False, False, True], [False] * 4, [False, False, True, True], [False, False, False, True], [False, True, False, True]]


def test_quotations(spark):
    rows = [(1, 0, "a", "Hello  World\nsecond line"), (1, 1, "b", "> hello world\nI agree"), (1, 2, "a", ">> hello world\n> i AGREE\nno"), (1, 3, "b", "> unknown\n\nok"), (2, 0, "a", "> hello world\nelsewhere"), (None, 1, "a", None), (1, 1, "b", "> hello world\nI agree")]
    out = link_quotations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    got = {(r.conv_id, r.turn): (r.body, r.n_quotes, r.n_linked, r.levels, r.parent_turn, r.root_turn) for r in out}
    assert len(out) == 7
    assert got[1, 1] == ("I agree", 1, 1, 1, 0, 0) and got[1, 2] == ("no", 2, 2, 2, 1, 0)
    assert got[2, 0][2] == 0 and got[None, 1][0] == "" and got[1, 3][:5] == ("ok", 1, 0, 1, None)


def test_empty_tables(spark):
    import public_tokenizers

    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (suffix_array_dedup(empty), substring_dedup(empty), simhash_components(empty), decontaminate(empty, spark.createDataFrame([], "item_id int, text string")),
                quality_rules(empty, labels), score_toxicity(empty, labels), identify_language(empty), pack_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"))):
        assert out.count() == 0
