"""Filter audit, periodic runs and MinHash against plain loops and edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from solarloom.llm import minhash, periodic_runs
from solarloom.llm.common import text_buffer
from solarloom.llm.filter_audit import COUNTS, audit_filters
from solarloom.llm.minhash import minhash_components
from solarloom.llm.periodic_runs import detect_runs, next_smaller, stretches, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """The contract's counts by a plain loop over documents and orders."""
    def fails(i):
        key, text, _ = docs[i]
        body = text or ""
        words = WORD.findall(body)
        copy = key is not None and any(k is not None and k < key and (t or "") == body for k, t, _ in docs)
        conditions = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", body)) > 5 * len(body), bool(re.search(r"[#$%&*|]", body)), copy]
        return {f for f, c in zip("ABCDE", conditions) if c}

    failed = [fails(i) for i in range(len(docs))]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out, removed = {}, {}
    for part in {s or "" for _, _, s in docs}:
        mine = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in failed[i]}
                before = left
                left = left - gone
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in failed[i] for i in mine if i not in before), sum(failed[i] == {f} for i in mine),
                                          sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]], k[1][k[2] - 1]) for k, v in out.items()}


def test_audit(spark):
    rnd = random.Random(4)
    texts = ["", None, "one", "A#"] + [" ".join(rnd.choice(["wörd", "b%", "Cc", "DD", "e"]) if rnd.random() < 0.2 else f"x{rnd.randrange(m)}" for _ in range(n)) for n in (49, 50, 51, 80) for m in (20, 500)]
    docs = [(i, rnd.choice(texts), rnd.choice(["a", "b", None, ""])) for i in range(90)]
    docs += [(None, texts[5], "a"), (None, texts[5], "b"), (None, None, None), docs[3], docs[3], (3, texts[6], "c"), (5, " ".join(f"y{i}" for i in range(20_000)), "a"), (-7, texts[6], "b")]
    labels = [(i % 60, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(80)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, k int, mask string")
    got = {(r.part, r.filter_order, r.step): (*[r[c] for c in COUNTS], r.shapley, r["filter"]) for r in audit_filters(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audited(docs, labels) and len(got) == 4 * 600


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(none, labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, None, None)], none.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120


def runs_by_loops(w, least=6, exponent=4):
    out = []
    for p in range(1, len(w) // exponent + 1):
        s = 0
        while s + p < len(w):
            e = s
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            n = e - s + p
            if n >= max(least, exponent * p) and not any(all(w[x] == w[x + q] for x in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_the_plain_loops():
    rnd = random.Random(3)
    for _ in range(3000):
        k, n = rnd.choice([1, 2, 2, 3, 4]), rnd.randrange(0, 40)
        w = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.5 and n > 6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randrange(3, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert word_runs(w) == runs_by_loops(w)
        assert word_runs(w, 2, 2) == runs_by_loops(w, 2, 2)
        found = [(s + a, m, p) for a, b in zip(*stretches(np.array(w, np.int64), np.array([0, n]))) for s, m, p in word_runs(w[a:b])]
        assert sorted(found, key=lambda r: (r[0], r[2])) == runs_by_loops(w)


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [lambda n: [1] * n, lambda n: [i % 2 for i in range(n)], fibonacci, lambda n: [i.bit_count() % 2 for i in range(n)], lambda n: [(i & -i).bit_length() for i in range(1, n + 1)],
                                   lambda n: [i // int(n**0.5) % 2 for i in range(n)], lambda n: [int(int(i**0.5) ** 2 == i) for i in range(n)], lambda n: list(range(n, 0, -1)), lambda n: [i % 37 * 7 % 11 for i in range(n)]])
def test_lyndon_arrays_read_each_word_a_few_times(words):
    for sign in (1, -1):
        w = [sign * x for x in words(20_000)]
        found, Counted.reads = {}, 0
        next_smaller(Counted(w + [min(w) - 1]), lambda i, j, e: found.__setitem__(i, (j, e)))
        assert Counted.reads < 20 * len(w)
        for i in range(0, 20_000, 997):
            if i in found:
                j, e = found[i]
                assert w[i : i + e] == w[j : j + e] and w[j : j + e + 1] < w[i : i + e + 1]


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    a, g = h // 10 % len(words), h // 10
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 300))) + "\n\t x" * rnd.randrange(9)) for i in range(120)]
    docs += [(None, "a " * 9), (200, None), (201, ""), (202, " \n"), (203, "é é " * 7), docs[4], docs[4], (205, "ab " * 30_000 + "c"), (206, "a " * 6 + "b " * 6), (207, "a a a a a")]
    out = detect_runs(spark.createDataFrame([(*d, "mine", 7) for d in docs], "doc_id long, text string, Runs string, k int"), planted=True)
    assert out.columns == ["doc_id", "text", "k", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    want = []
    for key, text in docs:
        w = planted(key, WORD.findall(text or ""))
        found = runs_by_loops(w) if len(w) < 1000 else [(0, 30_000, 1)]
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        said, kept = "".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((key, len(w), len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert sorted((tuple(r[c] for c in ["doc_id", *out.columns[3:11], "collapsed"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) > 15 and sum(planted(d, WORD.findall(t or "")) != WORD.findall(t or "") for d, t in docs) > 5


def test_runs_of_nothing(spark):
    assert detect_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def joined(docs):
    """(key, set size, smallest key of the component) of each row, all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return sorted(((key, len(sets[i]), low.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(docs)), key=repr)


def copies(rnd, size, group, edits):
    base = [f"w{rnd.randrange(3000)}" for _ in range(size)]
    for _ in range(group):
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
        yield " ".join(w)
    yield " ".join(base).upper()


def answers(out):
    rows = out.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_components(spark):
    rnd = random.Random(6)
    texts = ["", None, " \n", "one", "One", "two words", "one two three four", "a b c d e", "a b c d e f"]
    # Copies one edit from their original and too far from each other; chains.
    for size, group, edits in [(100, 60, 1), (60, 40, 1), (12, 10, 1), (300, 30, 3), (400, 30, 2), (8, 6, 1)]:
        texts += copies(rnd, size, group, edits)
    chain = [f"c{i}" for i in range(80)]
    for i in range(60):
        chain[rnd.randrange(80)] = f"d{i}"
        texts.append(" ".join(chain))
    # A passage that many share, too short to link them.
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [passage + "".join(f" q{i}x{j}" for j in range(10 + i)) for i in range(40)]
    rnd.shuffle(texts)
    docs = list(enumerate(texts)) + [(None, texts[7]), (None, "only here and nowhere else at all"), (3, texts[3]), (3, texts[3]), (5, texts[9]), (-4, texts[20])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, bucket int")
    assert answers(minhash_components(frame)) == joined(docs)


def test_a_hot_group(spark, monkeypatch):
    """Small shares and parts, so that stars and buckets are split."""
    for name, value in (("SHARE", 2000), ("MEMBERS", 5), ("ACROSS", 7), ("OFTEN", 3)):
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(7)
    # Without their original, copies link only where their edits meet.
    texts = [*list(copies(rnd, 90, 90, 1))[:-1], *copies(rnd, 120, 40, 2)]
    docs = list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(50)]
    assert answers(minhash_components(spark.createDataFrame(docs, "doc_id long, text string"))) == joined(docs)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_components(none).count() == 0
    rows = minhash_components(spark.createDataFrame([(1, None), (2, " "), (None, None)], none.schema)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_signatures_estimate_similarity():
    rnd = random.Random(8)
    for size in (40, 400, 2000):
        base = [f"w{i}" for i in range(size + 4)]
        other = base[: size * 9 // 10] + [f"v{rnd.random()}" for _ in range(size // 10 + 4)]
        data, offsets = text_buffer(pa.array([" ".join(base), " ".join(other)]))
        values, cuts = minhash.shingle_sets(data, offsets)
        a, b = (set(values[x:y].tolist()) for x, y in zip(cuts[:-1], cuts[1:]))
        one, two = minhash.signatures(values, cuts)
        assert abs((one == two).mean() - len(a & b) / len(a | b)) < 0.1
        assert set(one.tolist()) <= a and (one != 0).all()
