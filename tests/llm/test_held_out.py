"""Whole tables against independent implementations, and held-out recall."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from solarloom.llm.packing import pack_tokens
from solarloom.llm.quality import quality_rules
from solarloom.llm.simhash import fingerprints, simhash_components

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_bits(text):
    """A fingerprint bit by bit."""
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy(F.length("text")).limit(250).select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, "One"), (-3, "one TWO"), (-4, "É é x"), (-5, "a a a a"), (-6, "\x0b\x0c\x1c b\x85c")], "doc_id long, text string")
    rows = docs.unionByName(extra).cache()
    got = {r.k: r.fp & (2**64 - 1) for r in fingerprints(rows).collect()}
    assert got == {r.doc_id: by_bits(r.text) for r in rows.collect()}
    shown = {r.doc_id: r.fingerprint for r in simhash_components(rows).collect()}
    assert shown == {k: f"{v:016x}" for k, v in got.items()}


def test_pieces_hold_the_tokenizer_s_ids(spark):
    """Every document of a table, cut anywhere, has the ids of ``encode``."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokenizer = Tokenizer.from_file(str(path))
    pieces = {}
    for r in pack_tokens(docs, path).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert pieces.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine, at = sorted(pieces[key], key=lambda r: r.start), 0
        for p in mine:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_forests_reject_low_quality_rows_they_never_saw(spark):
    """Fitted on rows whose crc32 mod 5 is not 0; of the others that pass the
    base rules nearly all bad ones go and nearly all good ones stay."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    part = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").cache()
    out = quality_rules(part, labels.filter(~held)).filter("not base_failed").join(labels.filter(held).select("doc_id", "quality"), "doc_id")
    counts = {(r.quality, r.kept): r.n for r in out.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get((0, False), 0) + counts.get((0, True), 0), counts.get((1, False), 0) + counts.get((1, True), 0)
    print("rejected", counts.get((0, False), 0), "of", bad, "bad; lost", counts.get((1, False), 0), "of", good, "good")
    assert bad > 40 and counts.get((0, False), 0) >= 0.9 * bad
    assert good > 400 and counts.get((1, True), 0) >= 0.99 * good
