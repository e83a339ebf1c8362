"""Near-duplicate classes by SimHash and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``RADIUS`` bits differ by at
most ``RADIUS // segments`` bits in one segment at least, so each fingerprint looks up its
own segment values and the Hamming ball around them in a table of all fingerprints, and
complete distances are verified. Of a pair only the larger segment value looks, so each
side of the ball is enumerated once.

* Equal fingerprints are one row (with the smallest doc_id) before any lookup, so copies
  cost nothing here.
* A table cell with many members is dealt in blocks, and pairs of blocks are cells of their
  own: no task holds an unbounded cell, and no pair is lost.
* Pairs are verified in numpy and never leave their task: a task returns a spanning forest
  of the links that it found, at most one row a fingerprint.

``keep_one`` (for the pipeline) looks for a shingle similarity, which is many bits of a
fingerprint. There fingerprints only propose: sixteen of them, each under its own seed, are
cut in 64 segments, and a pair with an equal segment and 128 bits that aren't far apart is a
candidate. Then every pair within a connected set of candidates is held by its exact shingle
sets, and only pairs that reach the similarity are links. What fingerprints may miss is a
pair with no equal segment: by chance 1 pair in 1,000 at a similarity of 0.8, and fewer above.

Nulls and empty texts have fingerprint zero, linked like any other. Repeated rows are
linked. A null doc_id counts as larger than all others and comes back null. Rows are told
apart by their texts, not by doc_id: unlike texts with one doc_id, or with none, aren't
linked by it, and each stays unless its own class has a smaller row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, components, connected_components, mix, slices, split_hot, text_bytes, tidy, tidy_group, with_text
from .exact_dedup import filter_words, may_contain

RADIUS = 4
SEED = 42
#: Members of a table cell that one task compares with one another.
CELL = 4096
#: For the pipeline: copies share this much of their five-word shingles (a fraction).
SIMILAR = (4, 5)
#: Fingerprints for candidates, by a seed each; segments of each, and bits of a segment.
SEEDS, CUTS, BITS = 16, 4, 14
#: Bits of the first 128 that candidates may differ in. At a similarity of 0.8 about 19 do (deviation 4); 64 do by chance.
CANDIDATE_BITS = 36
#: Shingle sets that one task compares with one another: sets, and shingles of them all.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_NONE = np.iinfo(np.int64).max


def shingles(data: bytes, width: int = 4, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words where there are fewer."""
    words = data.lower().split()
    if not words:
        return np.array([], "<u8")
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    end = end.tolist()
    k = min(width, len(words))
    f = xxhash.xxh64_intdigest
    return np.array([f(joined[a:b], seed) for a, b in zip(start, end[k - 1 :])], "<u8")


def fingerprint(data: bytes, width: int = 4, seed: int = SEED) -> int:
    """64 bits: set where more than half of the shingles' XXH64 have it set."""
    h = shingles(data, width, seed)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, second: bool = False, *more_columns: str) -> DataFrame:
    """(doc_id, fp, more) of every row: 64 bits as a long, and as many again (or 0); and
    the named columns of longs."""

    def f(batches):
        for b in batches:
            texts = [bytes(x) for x in text_bytes(pa.Table.from_batches([b]))]
            fp = np.array([fingerprint(x, width) for x in texts], np.uint64)
            more = np.array([fingerprint(x, width, SEED + 1) if second else 0 for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(more.view(np.int64)), *map(b.column, more_columns)], names=["doc_id", "fp", "more", *more_columns])

    return with_text(docs, *more_columns).mapInArrow(tidy(f), ", ".join(f"{c} long" for c in ("doc_id", "fp", "more", *more_columns)))


def choose_segments(n: int, radius: int) -> int:
    """How many segments: the fewest lookups and comparisons for ``n`` fingerprints. Any
    choice finds all links; each keeps balls of one bit or more."""

    def cost(count: int) -> float:
        return entries_each(count, radius) * (1 + 0.02 * n / 2 ** (64 / count))

    return min(range(2, radius + 1), key=cost)


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _entries(count: int, radius: int):
    """Fingerprints -> table entries (member) and lookups, by cell (segment and value)."""
    parts, reach = segments(count), radius // count

    def f(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.arange(len(fp))
            cells, rows, member = [], [], []
            for s, (shift, width) in enumerate(parts):
                v = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                tag = np.uint64(s << 60)
                cells.append(v | tag)
                rows.append(row)
                member.append(np.ones(len(v), bool))
                for bits in (m for d in range(1, reach + 1) for m in combinations(range(width), d)):
                    other = v ^ np.uint64(sum(1 << x for x in bits))
                    low = np.flatnonzero(other < v)
                    cells.append(other[low] | tag)
                    rows.append(low)
                    member.append(np.zeros(len(low), bool))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells).view(np.int64)), *(b.column(c).take(pa.array(rows)) for c in ("fp", "more", "node")), pa.array(np.concatenate(member))],
                names=["cell", "fp", "more", "node", "member"],
            )

    return f


def _verify(radius: int, both: int):
    """A shard's cells -> a spanning forest of the links between their fingerprints."""

    def f(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        member = table["member"].to_numpy()
        order = np.lexsort((~member, part))
        part, member = part[order], member[order]
        fp = table["fp"].to_numpy()[order].view(np.uint64)
        more = table["more"].to_numpy()[order].view(np.uint64)
        nodes, own = np.unique(table["node"].to_numpy()[order], return_inverse=True)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, len(part)))
        members = np.add.reduceat(member.astype(np.int64), first)
        base, count = np.repeat(first, size), np.repeat(members, size)
        # A member meets the members after it; a lookup meets all members of its cell.
        place = np.arange(len(part)) - base
        skip = np.where(member, place + 1, 0)
        count = np.maximum(count - skip, 0)
        base = base + skip
        parent = np.arange(len(nodes))
        total = np.cumsum(count)
        at, step = 0, 1 << 20
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
            c = count[at:to]
            left = np.repeat(np.arange(at, to), c)
            right = np.repeat(base[at:to] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(len(left))
            apart = np.bitwise_count(fp[left] ^ fp[right])
            near = np.flatnonzero(apart <= radius)
            near = near[apart[near] + np.bitwise_count(more[left[near]] ^ more[right[near]]) <= both]
            if len(near):
                parent = components(len(nodes), own[left[near]], own[right[near]], parent)
            at = to
        linked = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table({"a": nodes[linked], "b": nodes[parent[linked]]})

    return f


_ENTRY = "cell long, fp long, more long, node long, member boolean"


def entries_each(count: int, radius: int) -> float:
    """Table entries and lookups of one fingerprint, on average."""
    width, reach = 64 / count, radius // count
    return count * (1 + sum(comb(round(width), d) for d in range(1, reach + 1)) / 2)


def links(points: DataFrame, radius: int = RADIUS, both: int = 128, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints differ by ``radius`` bits or fewer, and
    by ``both`` with the second ones: enough edges to connect all that are linked.
    points: distinct (fp, more, node)."""
    n = points.count()
    count = choose_segments(n, radius)
    return _meet(points.mapInArrow(tidy(_entries(count, radius)), _ENTRY), int(n * entries_each(count, radius)), radius, both, cell)


def _meet(entries: DataFrame, n: int, radius: int, both: int, cell: int = CELL) -> DataFrame:
    """Edges between the ``n`` entries of all cells, within each cell."""
    crowded = entries.filter("member").groupBy("cell").agg(F.count("*").alias("members")).filter(F.col("members") > cell)
    crowded = crowded.select("cell", F.ceil(F.col("members") / cell).cast("int").alias("blocks"))
    met = entries.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # One block: one cell. More: every pair of blocks is a cell.
    block = F.pmod(F.xxhash64("fp", "more", F.lit("block")), F.col("blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("fp", "more", "node", "member", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("part"))
    shards = int(max(32, n // 200_000))
    return met.withColumn("shard", F.pmod(F.col("part"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(tidy_group(_verify(radius, both)), "a long, b long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _classes(docs: DataFrame, radius: int, width: int, both: int | None) -> DataFrame:
    """Per row: doc_id, key, fp, node (one for each fingerprint) and root (of the node's class)."""
    rows = checkpoint(fingerprints(_keyed(docs), width, both is not None, "key"))
    rows = rows.withColumn("node", F.col("fp") if both is None else F.xxhash64("fp", "more"))
    points = checkpoint(rows.groupBy("fp", "more", "node").agg(F.count("*").alias("members")))
    roots = connected_components(links(points.drop("members"), radius, 128 if both is None else both))
    roots = points.join(roots, "node", "left").select("node", "members", F.coalesce("root", "node").alias("root"))
    return split_hot(rows, checkpoint(roots), "node", "members", rows.count()).drop("members")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 4, both: int | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id (smallest doc_id reachable over links).

    ``both``: the bits that may differ in the fingerprint and a second one together."""
    rows = _classes(docs, radius, width, both)
    rows = checkpoint(rows.select("doc_id", "fp", "root"))
    low = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    rows = split_hot(rows, checkpoint(low), "root", "members", rows.count())
    return rows.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def sketch(h: np.ndarray) -> np.ndarray:
    """Fingerprints of a set of shingles under ``SEEDS`` seeds, from one hash of each."""
    salt = mix(np.arange(1, SEEDS + 1, dtype=np.uint64))
    count = np.zeros(64 * SEEDS, np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(mix(h[at : at + 255, None] + salt).view(np.uint8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.uint8)
    return np.packbits(count * 2 > len(h), bitorder="little").view("<u8")


def _sketches(width: int):
    """Texts -> node (a hash of the set of shingles), its size, 128 bits and the segments' values."""

    def f(batches):
        for b in batches:
            sets = [np.unique(shingles(bytes(x), width)) for x in text_bytes(pa.Table.from_batches([b]))]
            found = np.array([sketch(h) for h in sets], np.uint64).reshape(len(sets), SEEDS)
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64)
            cut = found[:, :, None] >> (np.arange(CUTS, dtype=np.uint64) * np.uint64(64 // CUTS))
            cells = (cut & np.uint64((1 << BITS) - 1)).astype("<u2").reshape(len(sets), SEEDS * CUTS)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), *(pa.array(x.view(np.int64)) for x in (node, found[:, 0].copy(), found[:, 1].copy())), pa.array([len(h) for h in sets], pa.int64()), pa.array([c.tobytes() for c in cells], pa.binary())],
                names=["doc_id", "key", "node", "fp", "more", "size", "cells"],
            )

    return f


def _segment_entries(batches):
    """Nodes -> an entry for each segment's value."""
    tag = np.arange(SEEDS * CUTS, dtype=np.int64) << BITS
    for b in batches:
        cells = np.frombuffer(b"".join(b.column("cells").to_pylist()), "<u2").reshape(b.num_rows, len(tag)) + tag
        row = pa.array(np.repeat(np.arange(b.num_rows), len(tag)))
        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *(b.column(c).take(row) for c in ("fp", "more", "node")), pa.array(np.ones(cells.size, bool))], names=["cell", "fp", "more", "node", "member"])


def _sets(width: int):
    """Texts -> their sets of shingles, as bytes."""

    def f(batches):
        for b in slices(batches, 1000):
            sets = [np.unique(shingles(bytes(x), width)).tobytes() for x in text_bytes(pa.Table.from_batches([b]))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "root", "blocks")), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "root", "blocks", "held"])

    return f


def similar_links(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets' Jaccard similarity is ``similar`` or more."""
    m, (over, under) = len(sets), similar
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if m else np.array([], np.int64)
    owner = np.repeat(np.arange(m), size)
    waiting, out = np.ones(m, bool), []

    def index():
        """Holders of each shingle, of the sets that wait."""
        live = np.flatnonzero(waiting[owner])
        live = live[np.argsort(ids[live], kind="stable")]
        return owner[live], np.concatenate([[0], np.cumsum(np.bincount(ids[live], minlength=int(ids.max(initial=0)) + 1))]), waiting.sum()

    holders, first, held = index()
    for seed in range(m):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        todo = [seed]
        while todo and waiting.any():
            if waiting.sum() * 2 < held:
                holders, first, held = index()
            i = todo.pop()
            own = ids[end[i] - size[i] : end[i]]
            count = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(holders[at], minlength=m)
            near = np.flatnonzero(waiting & (shared * under >= (size + size[i] - shared) * over))
            waiting[near] = False
            todo += near.tolist()
            out += [(i, j) for j in near.tolist()]
    return out


def _compare(similar: tuple[int, int]):
    """A shard's groups of shingle sets -> links between their nodes."""

    def f(table: pa.Table) -> pa.Table:
        part, node = table["part"].to_numpy(), table["node"].to_numpy()
        held, a, b = table["held"], [], []
        order = np.lexsort((node, part))
        new = np.concatenate([[True], part[order][1:] != part[order][:-1]]) if len(order) else np.array([], bool)
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            rows = rows[np.unique(node[rows], return_index=True)[1]]
            found = np.array(similar_links([np.frombuffer(held[int(r)].as_py(), "<u8") for r in rows], similar), np.int64).reshape(-1, 2)
            a.append(node[rows[found[:, 0]]])
            b.append(node[rows[found[:, 1]]])
        none = np.array([], np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return f


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: rows of one doc_id and key have one text."""
    return docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def similar_classes(docs: DataFrame, width: int, similar: tuple[int, int], block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: doc_id, key, node (one for a set of shingles) and root (of the node's class)."""
    rows = checkpoint(with_text(_keyed(docs), "key").mapInArrow(tidy(_sketches(width)), "doc_id long, key long, node long, fp long, more long, size long, cells binary"))
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    points = rows.groupBy("node").agg(F.min(id_).alias("one"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("fp", "more", "size", "cells")))
    entries = points.select("fp", "more", "node", "cells").mapInArrow(tidy(_segment_entries), _ENTRY)
    near = connected_components(_meet(entries, rows.count() * SEEDS * CUTS, 64, CANDIDATE_BITS))
    near = near.union(near.select("root", "root").distinct())
    # A set of candidates is compared in one task if it is small; else dealt in blocks, of which each pair meets.
    near = near.join(points.select("node", "one", "size"), "node")
    of = near.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles), F.lit(1)).cast("int").alias("blocks"))
    near = checkpoint(near.join(of, "root").select("node", "root", "blocks", "size", F.col("one.doc_id").alias("i"), F.col("one.key").alias("digest")))
    weight = near.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    texts = may_contain(with_text(_keyed(docs), "key").withColumnRenamed("key", "digest"), near, filter_words(near.count()))
    texts = texts.withColumnRenamed("digest", "d").join(near, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("d") == F.col("digest")))
    sets = texts.select("node", "root", "blocks", "text").mapInArrow(tidy(_sets(width)), "node long, root long, blocks int, held binary")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    sets = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("node", "held", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"))
    shards = int(max(32, weight >> 20))
    edges = sets.withColumn("shard", F.pmod(F.col("part"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(tidy_group(_compare(similar)), "a long, b long")
    roots = points.select("node", "members").join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return split_hot(rows.select("doc_id", "key", "node"), checkpoint(roots), "node", "members", rows.count()).drop("members")


def _first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each class. rows: doc_id, key, node, root."""
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "key")
    first = rows.groupBy("root", id_.alias("one")).count().groupBy("root").agg(F.min(F.struct("one", "count")).alias("m"))
    stay = checkpoint(first.select(F.col("m.one.doc_id").alias("stay_id"), F.col("m.one.key").alias("stay_key"), F.col("m.count").alias("copies")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_key"))
    out = own.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_key") == F.col("stay_key")), "left_semi")
    if not stay.filter("copies > 1").isEmpty():  # rows of equal doc_id and text
        out = out.dropDuplicates(["own_id", "own_key"])
    return out.select("row.*")


def keep_one(docs: DataFrame, radius: int | None = None, width: int = 5, both: int | None = None, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class one row of the
    smallest doc_id (for the pipeline). Nulls, repeated rows, extra columns and empty tables
    as the module's text has it.

    Classes are connected by pairs whose sets of shingles are ``similar``; with a ``radius``,
    by fingerprints alone, as ``near_duplicates`` has them."""
    if radius is None:
        return _first_of_each(docs, similar_classes(docs, width, similar))
    return _first_of_each(docs, _classes(docs, radius, width, both))
