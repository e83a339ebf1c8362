"""Operator 3 against all pairs in plain Python."""

import random

import pytest
import xxhash

from palimpsest.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def slow_fingerprint(text, width=4):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (text or "").translate(fold).encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + width]), seed=42).intdigest() for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        low[find(a)] = min(low.get(find(a), i), i)
    return sorted((i, f"{f:016x}", low[find(a)]) for a, ((i, _), f) in enumerate(zip(rows, fps)))


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgÄß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(150, 500))]
        for c in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((1000 - 40 * g + c, " ".join(t).upper() if c % 5 == 0 else " \n".join(t)))
    rows += [(3, None), (4, ""), (5, "one"), (6, "ONE"), (7, "one two three"), (8, " \t"), (9, "a b c d e"), (9, "a b c d e"), (2000, " ".join(rng.choice(words) for _ in range(30000)))]
    return rows


def test_components_match_all_pairs(spark):
    rows = corpus()
    assert sorted(map(tuple, simhash.near_duplicates(table(spark, rows)).collect())) == slow_components(rows)


def test_crowded_cells_are_dealt_in_blocks(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 300:
        fps.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
    far = [rng.getrandbits(64) for _ in range(200)]
    points = [(f - (1 << 64) if f >> 63 else f, 0, n) for n, f in enumerate([*fps, *far])]
    df = spark.createDataFrame(points, "fp long, more long, node long")
    for cell in (16, 4096):
        got = simhash.connected_components(simhash.links(df, cell=cell))
        pairs = {r.node: r.root for r in got.collect()}
        near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        todo, seen = [0], {0}
        while todo:
            a = todo.pop()
            for n, (f, _, _) in enumerate(points):
                if n not in seen and near(points[a][0], f):
                    seen.add(n)
                    todo.append(n)
        assert {n for n, r in pairs.items() if r == 0} == seen - {0}


def test_null_ids_and_empty_table(spark):
    got = simhash.near_duplicates(table(spark, [(None, "p q r s"), (None, "p q r s"), (1, "t u v w x y z")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 1), (True, None), (True, None)]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_one_of_each_class_stays(spark):
    rows = corpus()
    kept = [r.doc_id for r in simhash.keep_one(table(spark, rows), radius=4, width=4, both=None).collect()]
    assert sorted(kept) == sorted({c for _, _, c in slow_components(rows)})


def test_far_copies_go_and_other_texts_stay(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(3000)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(400)]
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(400)] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    kept = [r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()]
    assert {2 * g for g in range(40)} <= set(kept) and len(kept) <= 44


def test_every_choice_of_segments_covers_the_fingerprint():
    for n in (1, 10**5, 10**7, 10**10):
        for radius in (4, 10):
            parts = simhash.segments(simhash.choose_segments(n, radius))
            assert sum(w for _, w in parts) == 64 and len(parts) <= radius


def jaccard_rows(rng, similarities, n=120):
    """Pairs of texts (ids 2g and 2g + 1), each with about the similarity asked for, and the exact one."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, exact = [], {}
    for g, want in enumerate(similarities):
        a = [word() for _ in range(n)]
        b, sets = list(a), []
        while True:
            sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b)]
            now = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            if now <= want:
                break
            b = b[:-1] if rng.random() < 0.8 else [*b, word()]
        exact[g] = now
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    return rows, exact


def test_pairs_at_the_similarity_go_and_those_below_stay(spark):
    rng = random.Random(21)
    rows, exact = jaccard_rows(rng, [rng.uniform(0.65, 0.93) for _ in range(400)])
    kept = {r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()}
    assert {2 * g for g in exact} <= kept
    assert not [g for g in exact if exact[g] < 0.8 and 2 * g + 1 not in kept]  # wrong drops
    above = [g for g in exact if exact[g] >= 0.8]
    assert len(above) > 150 and len([g for g in above if 2 * g + 1 in kept]) <= 0.01 * len(above)


def test_similar_links_match_all_pairs(spark):
    rng = random.Random(4)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(60)]
        sets += [simhash.np.array(sorted({x if rng.random() > 0.04 else rng.getrandbits(64) for x in base}), "<u8") for _ in range(rng.randint(1, 15))]
    sets.append(sets[0][:0])
    find = lambda edges: simhash.components(len(sets), *simhash.np.array(edges).T).tolist()
    s = [set(x.tolist()) for x in sets]
    brute = [(a, b) for a in range(len(s)) for b in range(a) if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    assert find(simhash.similar_links(sets)) == find(brute)


def test_large_sets_of_candidates_are_dealt_in_blocks(spark):
    rng = random.Random(6)
    rows, _ = jaccard_rows(rng, [0.85])
    rows = [(i, f"{rows[i % 2][1]} tail{i}") for i in range(60)]
    docs = table(spark, rows)
    got = [{(r.doc_id, r.root) for r in simhash.similar_classes(docs, 5, (4, 5), block=b).collect()} for b in (7, 1024)]
    assert got[0] == got[1] and len({r for _, r in got[0]}) == 1


def test_unlike_texts_with_null_or_shared_ids_all_stay(spark):
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (None, a + " end"), (2, b), (None, b + " end"), (None, c), (None, c), (None, d), (7, d + " end"), (5, e), (5, c + " end"), (5, text())]
    low = {r.fingerprint: r.component_id for r in simhash.near_duplicates(table(spark, rows), radius=12).collect()}
    assert sorted(low.values()) == [1, 1, 2, 2, 5, 5, 5, 5, 7, 7]
    for more in ({}, {"radius": 12}):
        kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(table(spark, rows), **more).collect())
        assert kept == sorted([(1, a), (2, b), (5, e), (5, c + " end"), (5, rows[-1][1]), (7, d + " end")])
    kept = simhash.keep_one(table(spark, [(None, a), (None, a), (None, b), (None, c)])).collect()
    assert sorted(r.text for r in kept) == sorted([a, b, c])


def test_components_settle_or_say_that_they_do_not(spark):
    path = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in simhash.connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.connected_components(path, rounds=1)
