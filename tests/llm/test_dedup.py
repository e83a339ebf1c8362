"""Operators 2, 8 and 10 against plain Python over small tables with awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, line_dedup, repeats

SCHEMA = "doc_id long, text string, lang string, kept string, chunk string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß😀") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(14)
    rows = [(i, text(rng.randint(1, 60))) for i in range(60)]
    rows += [(100 + i, text(5) + " " + passage + " " + text(5)) for i in range(12)]
    rows += [(200 + i, passage[i : i + 55 + i]) for i in range(20)]
    rows += [(300 + i, other + "\n" + text(3) + "\n" + other.upper() + "\n  " + passage) for i in range(9)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a" * 300), (404, "a" * 120), (405, "xy" * 200), (406, None), (407, "  lead"), (408, "\tlead")]
    rows += [(500 + i, rows[70][1]) for i in range(8)] + [(7, "again " + passage), (7, "again " + passage), (409, "\n\n"), (410, text(20000))]
    return rows


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            w = b[a : a + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    rows = corpus()
    got = repeats.remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows)


def test_repeats_null_id_and_empty_table(spark):
    p = "a passage that is surely longer than fifty bytes, so that it repeats"
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(table(spark, [(None, p), (5, p)])).collect()}
    assert got == {5: 0, None: len(p)}
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_exact_duplicates_match_brute_force(spark):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    seen, want = set(), []
    for i, t in rows:
        g = groups[norm(t)]
        kept = i == min(g) and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        want.append((i, min(g), len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exact_dedup.keep_first(table(spark, rows)).count() == len(groups)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def entries(spark, rows):
    return spark.createDataFrame(rows, "run int, doc_id long, digest string")


def test_five_runs_compact_to_the_smallest_id(spark):
    """Runs keep their own rows until levels of two merge them, through three levels."""
    rows = [(0, 5, "x"), (0, 6, "y"), (1, 2, "x"), (1, 9, "z"), (1, 9, "z"), (2, 8, "x"), (3, 1, "w"), (4, 7, "y"), (4, 0, "v")]
    runs = exact_dedup.flush(entries(spark, rows))
    assert {(r.run, r.digest, r.keep_id, r.group_size) for r in runs.collect()} == {(0, "x", 5, 1), (0, "y", 6, 1), (1, "x", 2, 1), (1, "z", 9, 2), (2, "x", 8, 1), (3, "w", 1, 1), (4, "y", 7, 1), (4, "v", 0, 1)}
    want = {("x", 2, 3), ("y", 6, 2), ("z", 9, 2), ("w", 1, 1), ("v", 0, 1)}
    assert set(map(tuple, exact_dedup.compact(runs, 5, 2).collect())) == want
    words = exact_dedup.filter_words(9)
    passed = exact_dedup.passing(runs, exact_dedup.shared_filter(runs, words), words, keep=True)
    assert {"x", "y"} <= {r.digest for r in passed.collect() if r.passes} and {r.digest for r in passed.collect() if not r.passes} & {"z", "w", "v"}
    index = exact_dedup.build_index(entries(spark, rows).drop("run").repartition(4), 9, memtable=2, fan=2)
    assert sorted(map(tuple, index.collect())) == sorted(want)
    assert {r.digest for r in exact_dedup.may_contain(entries(spark, rows), runs.filter("run = 4"), words).collect()} >= {"y", "v"}


def test_levels_merge_without_another_shuffle(spark):
    runs = spark.createDataFrame([(r, i, f"{i}") for r in range(5) for i in range(20)], "run int, keep_id long, digest string").selectExpr("run", "digest", "keep_id", "1L as group_size")
    out = exact_dedup.compact(runs, 64, 4)
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1


def test_colliding_digests_give_classes_by_text(spark):
    """A digest of one character: texts that share it are told apart, and no row is lost."""
    rows = corpus() + [(7, "again"), (None, "b"), (None, "b"), (None, "c")]
    weak = exact_dedup.exact_duplicates(table(spark, rows), key=lambda sha: F.substring(F.hex(sha), 1, 1))
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_duplicates(table(spark, rows)).collect()))
    assert weak.count() == len(rows)


def test_rows_that_stay_keep_their_columns(spark):
    """Null and shared ids, columns with the operators' own names, empty tables."""
    p, q = "a passage that is surely longer than fifty bytes, so that it repeats", " and some more that no other text has at all"
    schema = "doc_id long, text string, n_chars int, own_sha string, row string, cuts string, cut_id long, chunk int, key string, digest string, stay_id long"
    rows = [(i, t, None, f"own{k}", "row", "cut", k, k, "key", None, 5) for k, (i, t) in enumerate([(5, p), (5, p + q), (None, "x" + p), (None, None), (None, "alone"), (6, "alone"), (6, "other"), (7, None)])]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    cut = {r.cut_id: r for r in repeats.without_repeats(docs).collect()}
    assert [cut[k].text for k in range(8)] == [p, p + q, "x", None, "alone", "alone", "other", None]
    assert all(tuple(cut[k])[3:] == rows[k][3:] and cut[k].n_chars == (None if cut[k].text is None else len(cut[k].text)) for k in cut)
    stay = exact_dedup.keep_first(docs)
    assert stay.columns == docs.columns and sorted(r.cut_id for r in stay.collect()) == [0, 1, 2, 5, 6, 7]
    assert all(tuple(r) == rows[r.cut_id] for r in stay.collect())
    twice = exact_dedup.keep_first(docs.union(docs))
    assert sorted(r.cut_id for r in twice.collect()) == [0, 1, 2, 5, 6, 7]
    for operator in (repeats.without_repeats, exact_dedup.keep_first):
        assert operator(docs.limit(0)).collect() == [] and operator(docs.limit(0)).columns == docs.columns


def test_equal_hashes_of_units_do_not_mix_them(spark, monkeypatch):
    """With hashes of units that often agree, decisions still rest on bytes."""
    rows = corpus()[60:110]
    before = repeats.unit_hashes

    def weak(units):
        h, check = before(units)
        return h % repeats._U(7), check

    monkeypatch.setattr(repeats, "unit_hashes", weak)
    shards, c = 4, None
    import pyarrow as pa

    tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "chunk": pa.array([k] * len(part), pa.int32())}) for k, part in enumerate((rows[::2], rows[1::2]))]
    asked = pa.concat_tables([repeats._ask(shards, "chunk")(t) for t in tables])
    of = lambda t, name, x: t.filter(pa.compute.equal(t[name], x))
    bits = pa.concat_tables([repeats._shared(of(asked, "shard", s)) for s in range(shards)])
    sent = pa.concat_tables([repeats._send(shards, "chunk")(t, of(bits, "chunk", k)) for k, t in enumerate(tables)])
    answers = pa.concat_tables([repeats._sort(of(sent, "shard", s)) for s in range(shards) if of(sent, "shard", s).num_rows])
    got = pa.concat_tables([repeats._report(t, of(answers, "chunk", k)) for k, t in enumerate(tables)]).to_pylist()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute_repeats(rows)


def test_colliding_digests_are_found(spark):
    rows = spark.createDataFrame([("d", "one"), ("d", "two"), ("e", "same"), ("e", "same")], "digest string, norm string")
    assert [r.digest for r in exact_dedup.collisions(rows).collect()] == ["d"]


def brute_lines(rows, min_docs=3, min_chars=20):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\v\f\r").translate(fold)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).update([] if i is None else [i])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    """Documents are counted by their ids; a row without one counts as none."""
    line = "a line of more than twenty characters"
    rows = corpus() + [(600, line), (600, line + "\n" + line), (601, "  " + line.upper()), (None, line + "\nb"), (None, line + " again"), (None, line + " again"), (602, line + " again")]
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(table(spark, rows)).collect()), key=str) == brute_lines(rows)
    rows += [(603, line), (603, line)]
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(table(spark, rows)).collect()), key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("operator", [line_dedup.drop_repeated_lines, exact_dedup.exact_duplicates])
def test_native_plans_have_no_python(spark, operator):
    plan = operator(table(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


MEMORY = """
import re, sys
import numpy as np, pyarrow as pa
from palimpsest.llm import common, packing, repeats

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def many(batches):
    yield from batches
    parts = [bytes(900) for _ in range(200_000)]  # small pieces, each too small to be mapped alone
    pin.append(parts[-1])

pin, before = [], held()
list(common.tidy(many, "packing")(iter([])))
print("left", held() - before)
common.kept("packing")["words"] = {i: b"x" * 1000 for i in range(100_000)}
common.tidy_group(lambda t: t)(None)
print("kept", held() - before)
"""


def test_workers_give_memory_back_to_the_system():
    """In a process of its own, as a Python worker is: what a task had, or kept for its next one, doesn't stay beside another's."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=100)
    left = dict(x.split() for x in out.stdout.splitlines())
    assert float(left["left"]) < 60 and float(left["kept"]) < 60, out


def test_removed_bytes_are_found_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    c = repeats.Chunk(pa.table({"doc_id": [1], "text": [text]}))
    empty = pa.table({n: pa.array([], pa.binary()) for n in ("hashes", "checks", "owners", "early", "valid")})
    tracemalloc.start()
    gone = repeats._gone(c, empty)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(gone) == len(c.buf) and not gone.any() and peak < 8 * len(c.buf)
