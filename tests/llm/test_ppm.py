"""Operator 1 against a trie kept one symbol at a time, and plain word counts."""

import random
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np

from palimpsest.llm import ppm

SCHEMA = "doc_id long, text string, train string, chunk string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)


def corpus():
    rng = random.Random(2)
    parts = ["th", "on", "er", "ing", "ß", "é", "😀", "A", "."]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \n"), (63, "unseen ZZZ qqq"), (5, "again"), (5, "again"), (64, "th " * 3000)]


def test_scores_match_a_plain_trie(spark):
    rows = corpus()
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    trie, counts = ppm.Trie(), Counter()
    for t in train:
        trie.read(t.encode(), score=False)
        counts.update([*ppm.words_of(t.encode()), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*ppm.words_of((t or "").encode()), b""]
        base = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((i, zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, trie.read((t or "").encode(), learn=False)))
    got = sorted(map(tuple, ppm.score_documents(table(spark, rows)).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-5), (a, b)


def test_probabilities_of_a_context_sum_to_one():
    trie = ppm.Trie(3)
    for t in (b"abracadabra", b"abra cad", b"\xc3\xa9\xc3\xa9", b"b"):
        trie.read(t, score=False)
    for past in ([256, 256, 256], [97, 98, 114], [1, 2, 3], [0xC3, 0xA9, 0xC3], [98, 114, 97]):
        assert isclose(sum(10 ** trie.log_probability(past, s) for s in range(257)), 1.0, rel_tol=1e-9)


def test_no_training_rows_null_ids_and_empty_table(spark):
    from pyspark.sql import functions as F

    got = ppm.score_documents(table(spark, [(1, "ab"), (None, None)]), train=F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (2, 0, 0)]
    assert all(isclose(r.score, -log10(257) * (3 if r.n_tokens == 2 else 1), rel_tol=1e-6) for r in got)
    assert ppm.score_documents(table(spark, [])).count() == 0


def test_adaptive_scores_learn_within_a_document(spark):
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(table(spark, [(1, "abab " * 50), (2, "abab "), (3, None)])).collect()}
    assert got[1] > 50 * got[2] and isclose(got[3], -log10(257))


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 54, 5000).astype(np.uint64))
    values = np.arange(len(keys)).astype(np.float32)
    assert (ppm.Lookup(keys, values)(keys[::-1]) == values[::-1]).all()
