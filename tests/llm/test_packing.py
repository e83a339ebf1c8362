"""Operator 9: exact ids, gapless sequences, and plans against lower bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, piece int, length string, rank int").repartition(3)


def awkward():
    rng = random.Random(1)
    odd = "aZ éÉßİı ﬁ Ω 中 😀 1 23 ' 's 'll <|endoftext|> <| </w> _ - . , ! \t     é ŉ ǰ ª º".split(" ")
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(odd) + rng.choice(odd) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    return rows + [(90, None), (91, ""), (92, " "), (93, "word " * 5000), (94, "x" * 6000), (95, "It's we'll DON'T. end."), (95, "It's"), (96, "a\x1cb\x85c　d")]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    texts = [x or "" for _, x in awkward()]
    got = packing.WordEncoder(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_only_distinct_words_become_objects():
    import tracemalloc

    code = packing.WordEncoder(PATH)
    text = " ".join(f"some{'abcdefghij'[i % 10]} words, (again)" for i in range(100_000))
    code.encode([text])
    tracemalloc.start()
    got = code.encode([text, ""])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text) + 3 * len(got[0]), peak / len(text)
    assert np.frombuffer(got[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids and got[1] == b""


def test_ids_are_the_same_whatever_the_cache_holds():
    texts = [x or "" for _, x in awkward()] + ["(one) two, three; \"four\" one. TWO\nthree! <|endoftext|> Four<| don't a\rb"]
    want = packing.WordEncoder(PATH).encode(texts)
    small = packing.WordEncoder(PATH, cache=3)
    assert [x for _ in range(3) for t in texts for x in small.encode([t])] == 3 * want and small.encode([]) == []


def test_pieces_fill_sequences_without_gaps(spark):
    rows = awkward()
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, x in rows:
        want[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    got = packing.pack_documents(table(spark, rows), PATH).collect()
    for i, docs in want.items():
        pieces = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in got if p.doc_id == i)
        assert pieces == sorted((n, a, len(d[a : a + 4096]), zlib.crc32(d[a : a + 4096].tobytes())) for d in docs for n, a in enumerate(range(0, len(d), 4096)))
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 4096
    total = sum(p.length for p in got)
    assert len(sequences) == -(-total // 4096)
    assert packing.pack_documents(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_length_once(seed):
    rng = random.Random(seed)
    top = rng.choice([10, 50, 400])
    lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 600))] + [rng.choice([top, top // 2 or 1])] * rng.randint(0, 50)
    used = defaultdict(int)
    for n, items in packing.plan({x: lengths.count(x) for x in set(lengths)}, top):
        assert sum(x * k for x, k in items) <= top
        for x, k in items:
            used[x] += n * k
    assert used == {x: lengths.count(x) for x in set(lengths)}
    first_fit = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, g in enumerate(first_fit) if g >= x), None)
        if i is None:
            first_fit.append(top - x)
        else:
            first_fit[i] -= x
    assert packing.lengths_fit(lengths, top) <= len(first_fit)


def test_exact_complements_are_found():
    assert packing.plan({6: 3, 4: 3}, 10) == [(3, [(6, 1), (4, 1)])]
    assert packing.plan({5: 2, 3: 2, 2: 2}, 10) == [(1, [(5, 2)]), (1, [(3, 2), (2, 2)])] or packing.lengths_fit([5, 5, 3, 3, 2, 2], 10) == 2
    assert packing.lengths_fit([7, 1, 1, 1], 10) == 1
