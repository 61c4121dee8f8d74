"""Operators without SQL against plain Python: learning, statistics, forests,
vectors, chains of quotations, benchmark matches, and the pipeline by stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from solarloom.llm import contamination, languages, quality, toxicity
from solarloom.llm.common import text_buffer
from solarloom.llm.quotations import link_quotations
from solarloom.llm.simhash import fingerprint

import pyarrow as pa

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_ftrl_is_the_plain_loop():
    rnd = random.Random(1)
    samples = [(np.array(sorted(rnd.sample(range(40), 8))), rnd.random() < 0.4) for _ in range(60)]
    samples = [(np.unique(np.append(f, 50 if y else 51)), int(y)) for f, y in samples]
    got = toxicity.ftrl(samples, 1.5)
    often = Counter(int(i) for f, _ in samples for i in f)
    z, n, top = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        if abs(z[i]) <= 1.5:
            return 0.0
        return (math.copysign(1.5, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    toxic = sum(y for _, y in samples)
    rare = min(4.0, ((len(samples) - toxic) / toxic) ** 0.5)
    for _ in range(toxicity.EPOCHS):
        for f, y in samples:
            mine = [int(i) for i in f if often[int(i)] >= toxicity.LEAST_ROWS] + [top]
            w = {i: weight(i) for i in mine}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (rare if y else 1.0)
            for i in mine:
                rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - rate * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z}
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values())
    assert 0 < np.count_nonzero(got[:-1]) < len(often)


def test_grams_are_words_pairs_and_skip_pairs():
    data, offsets = text_buffer(pa.array(["A b c", "x", None, "a B!c", "b a c"]))
    row, feature = toxicity.grams(*contamination.lowered_words(data, offsets))
    by = [Counter(feature[row == r].tolist()) for r in range(5)]
    assert [sum(c.values()) for c in by] == [6, 1, 0, 6, 6]
    assert by[0] == by[3] and by[0] != by[4] and len(set(by[0]) & set(by[4])) >= 3


def plain_statistics(text):
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def random_texts(rnd, n=60):
    out = ["", " ", "\n\n", "a", "ü é\nü é\n", "a b a b a b", "x\ry\x0bz\x0c#"]
    for _ in range(n):
        out.append("".join(rnd.choice(["a", "b", "ß", "漢", " ", " ", "\n", "\t", "#", "|", "ab ", "a b c "]) for _ in range(rnd.randrange(200))))
    return out


def test_rule_statistics():
    texts = random_texts(random.Random(2)) + ["long " * 200_000]
    data, offsets = text_buffer(pa.array(texts))
    s = quality.rule_statistics(data, offsets)
    assert [tuple(int(s[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [plain_statistics(t) for t in texts]


def test_path_lengths():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 2)), [[9.0, 9.0]], np.zeros((3, 2))])
    forest = quality.IsolationForest(x)

    def path(tree, point):
        feature, split, left, _ = tree
        node = depth = 0
        while feature[node] >= 0:
            node = left[node] + (point[feature[node]] >= split[node])
            depth += 1
        return node, depth

    sizes = []
    for tree in forest.trees:  # how many of all points end in each leaf bounds the leaf's share
        ends = [path(tree, p) for p in x]
        assert all(tree[3][node] >= depth for node, depth in ends)
        sizes.append(ends)
    score = forest.score(x)
    mean = np.array([[tree[3][n] for n, _ in ends] for tree, ends in zip(forest.trees, sizes)]).mean(axis=0)
    n = forest.size
    expected = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    assert np.allclose(score, 2 ** (-mean / expected)) and score.argmax() == 300


def test_language_vectors(spark):
    rnd = random.Random(4)
    words = {"en": ["the", "house", "Garden", "quiet"], "el": ["σπίτι", "Κήπος", "ήσυχο"], "ja": ["漢字", "かな", "仮名"]}
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(12)) + "!", g) for i, g in ((i, ["en", "el", "ja"][i % 3]) for i in range(60))]
    rows += [(100, None, "en"), (101, "12 !", "en"), (102, "\U00010330\U00010331", None), (None, "the house", "el"), (1, rows[1][1], "el")]
    got = {(r.doc_id, r.lang_pred): r.score for r in languages.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def vector(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        out = np.zeros(languages.DIMENSIONS)
        for run in letters.split():
            padded = [0, *map(ord, run), 0]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                va, vb, vc = (languages.letter_vectors(np.array([p]))[0].astype(int) for p in (a, b, c))
                out += np.roll(va, 2) * np.roll(vb, 1) * vc
        return out

    sums = defaultdict(lambda: np.zeros(languages.DIMENSIONS))
    for key, text, lang in {r for r in rows if r[0] is not None and r[1] and r[2]}:
        if zlib.crc32(str(key).encode()) % 5:
            sums[lang] += vector(text)
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for key, text, _ in rows:
        v = vector(text or "")
        if not v.any():
            assert got[key, "und"] == 0.0
            continue
        cos = {g: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for g, s in sums.items()}
        best = max(sorted(cos), key=cos.get)
        assert (key, best) in got and abs(got[key, best] - max(0.0, cos[best])) < 1e-5


def test_chains_of_quotations(spark):
    rnd = random.Random(5)
    rows, said = [], {}
    for c in range(3):
        for t in range(20):
            body = f"note {c} {t} {rnd.randrange(9)}"
            quote = rnd.randrange(t) if t and rnd.random() < 0.7 else None
            text = (f"> {said[c, quote].upper()}\n" if quote is not None else "") + body
            said[c, t] = body
            rows.append((c, t, quote, text, {"parent": 1}.get("parent"), "x", "y"))
    df = spark.createDataFrame(rows, "conv_id int, turn int, quote int, text string, parent int, root string, passages string")
    got = {(r.conv_id, r.turn): r for r in link_quotations(df).collect()}
    for c, t, quote, _, *_ in rows:
        root = t
        while (up := next(q for cc, tt, q, *_ in rows if (cc, tt) == (c, root))) is not None:
            root = up
        r = got[c, t]
        assert (r.parent_turn, r.root_turn, r.body, r.parent, r["root"], r.passages) == (quote, root, said[c, t], 1, "x", "y")


def plain_decontaminate(docs, items, window=10):
    out = {}
    spans = [(i, w[a : a + window]) for i, t in items for w in [ALNUM.findall((t or "").lower())] for a in range(max(1, len(w) - window + 1)) if w]
    for key, text in docs:
        words = ALNUM.findall((text or "").lower())
        hit, found, longest = set(), set(), 0
        for i, g in spans:
            for a in range(len(words) - len(g) + 1):
                if words[a : a + len(g)] == g:
                    hit |= set(range(a, a + len(g)))
                    found.add(i)
        for _, t in items:
            w = ALNUM.findall((t or "").lower())
            for a in range(len(words)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(words) and b + n < len(w) and words[a + n] == w[b + n]:
                        n += 1
                    if n >= min(window, len(w)) and (n >= window or b == 0 and n == len(w)):
                        longest = max(longest, n)
        out[key] = (len(words), len(hit), sorted(found), longest, hit)
    return out


def test_benchmark_matches(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]

    def say(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    shared = say(14)
    items = [(f"i{k}", say(20) if k % 3 else shared + " " + say(k)) for k in range(8)] + [("one", "SOLO"), ("none", "!!"), ("null", None), ("again", shared)]
    docs = [(k, " ".join([say(5), items[k % 8][1][:120], "," + say(3)])) for k in range(20)] + [(20, None), (21, ""), (22, "solo"), (23, shared + " " + say(2))]
    want = plain_decontaminate(docs, items)
    frame = spark.createDataFrame([(k, t, "h", ["i"]) for k, t in docs], "doc_id long, text string, hit string, items array<string>")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block, chain, part in ((4_000_000, 4, 500_000), (300, 2, 500_000), (4_000_000, 4, 60)):
        monkeypatch.setattr(contamination, "BLOCK", block)
        monkeypatch.setattr(contamination, "CHAIN", chain)
        monkeypatch.setattr(contamination, "PART", part)
        for r in contamination.decontaminate(frame, bench).collect():
            n, hit, found, longest, places = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.hit, r["items"]) == (n, len(places), len(found), "h", ["i"])
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert {i for s in r.spans for i in range(s.start, s.stop)} == places
            assert r.longest == longest if part > 60 else r.longest <= longest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of small tables with every kind of trouble."""
    rnd = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]

    def say(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    item, passage = say(40), say(45)
    texts = [say(90) for _ in range(12)]
    texts += [texts[0], texts[0] + " ", texts[1] + " tail", say(30) + " " + passage + " " + say(30), say(40) + " " + passage + " " + say(20), say(30) + " " + item + " " + say(30), None, "", "short", "same word " * 100]
    rows = [(i, t, "en", "src", len(t or ""), "mine") for i, t in enumerate(texts)] + [(3, texts[3], "en", "src", 0, "mine"), (4, say(80), "en", "src", 0, "mine"), (None, say(80), "en", "src", 0, "mine")]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_pipeline_by_stage(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    def step(k):
        nonlocal docs
        before, out = rows(docs), pipeline.STAGES[k][1](spark, docs, corpus)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        return before, rows(docs)

    before, after = step(0)
    fine = [r for r in before for n, _, _, _, again in [plain_statistics(r[1] or "")] if n >= 50 and 100 * again <= 50 * n]
    assert after == sorted(fine, key=repr)  # too few labels for a forest
    before, after = step(1)
    prints = [fingerprint((r[1] or "").encode()) for r in before]
    group = list(range(len(before)))
    for _ in before:
        for i in range(len(before)):
            for j in range(len(before)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    keep = defaultdict(list)
    for r, g in zip(before, group):
        keep[g].append(r)
    assert sorted((min((r[0] is None, r[0] or 0) for r in g)) for g in keep.values()) == sorted((r[0] is None, r[0] or 0) for r in after)
    assert set(after) <= set(before) and len(after) == len(keep) < len(before)
    before, after = step(2)
    words = [SPACE.findall(r[1] or "") for r in before]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(before, words):
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        want.append((r[0], text, *r[2:4], len(text) if gone else r[4], r[5]))
    assert after == sorted(want, key=repr) and any(a != b for a, b in zip(sorted(want, key=repr), before))
    before, after = step(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    found = plain_decontaminate([(i, r[1]) for i, r in enumerate(before)], items)
    assert after == [r for i, r in enumerate(before) if not found[i][1]] and len(after) < len(before)
    pieces = pipeline.STAGES[4][1](spark, docs, corpus).collect()
    whole = pipeline.run(spark, corpus).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r[0] is None, r[0] or 0, len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in after)
    for got in (pieces, whole):
        assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in got if not r.start) == want
        size = Counter()
        for r in got:
            size[r.sequence_id] += r.length
        assert sum(size.values()) == sum(n for *_, n in want) and all(n <= 1024 and n & (n - 1) == 0 for n in size.values())


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
