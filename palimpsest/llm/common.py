"""Pieces that several operators share: checkpoints, chunks of documents, shards."""

from __future__ import annotations

import ctypes
import re
import tempfile
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"

#: Text bytes that one chunk has at least, in a large input. One Python worker holds one chunk at a time.
CHUNK_BYTES = 8 << 20
#: Text bytes behind one message of a chunk to a shard, on average, at least.
MESSAGE_BYTES = 1 << 10


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``. Where none is set a session within one
    process (as in tests) gets a folder of its own; a cluster is refused."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; other columns are left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def n_chunks(docs: DataFrame, least: int = 32, size: int = CHUNK_BYTES, message: int = MESSAGE_BYTES) -> int:
    """How many chunks of documents. A chunk has ``size`` bytes of text, or more where its
    messages to all shards (half as many as chunks) would be of less than ``message`` bytes of
    text: from there on chunks and shards both grow with the square root of the input."""
    total = int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    return max(least, -(-total // max(size, isqrt(total * message // 2))))


def chunked(docs: DataFrame, chunks: int, name: str = "chunk") -> DataFrame:
    """Deal documents to chunks by a hash of doc_id (and of the text, where there is no id):
    copies and hot sources spread evenly."""
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("chunk")), F.lit(chunks)).cast("int"))


def n_shards(chunks: int) -> int:
    return max(16, chunks // 2)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def split_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` joined to ``table`` (one row a ``key``, with the ``count`` of its rows) by key.
    At most ``parts`` keys can have more than a ``parts``-th of all ``total`` rows; they are
    broadcast, so no hot key is dealt to one task, and only the others are shuffled."""
    often = table.filter(F.col(count) > total // parts)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.filter(F.col(count) <= total // parts), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def slices(batches, rows: int):
    """Record batches cut to ``rows`` at most, so that a worker holds few texts as objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ids_of(table: pa.Table) -> np.ndarray:
    """doc_id as int64; a null doc_id counts as larger than all others."""
    return table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(table: pa.Table) -> list[memoryview]:
    """Each text's UTF-8 bytes, without copying."""
    col = table["text"].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return []
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = memoryview(col.buffers()[2] if col.buffers()[2] is not None else b"")
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


#: What tasks of one operator keep in a Python worker for one another, by operator.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A dict that a worker's tasks of one operator share; it is emptied when the worker gets another's."""
    return _KEPT.setdefault(name, {})


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for the next stage, and what
    they had once would count beside all that comes later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def _begin(keeps: str | None) -> None:
    for name, held in _KEPT.items():
        if name != keeps and held:
            held.clear()
            give_back()


def tidy(f, keeps: str | None = None):
    """``f`` over batches, in a worker that drops what other operators kept, and gives memory back at the task's end."""

    def g(batches):
        _begin(keeps)
        yield from f(batches)
        give_back()

    return g


def tidy_group(f):
    """As ``tidy``, of a group's table."""

    def g(table: pa.Table) -> pa.Table:
        _begin(None)
        out = f(table)
        give_back()
        return out

    return g


def tidy_pair(f):
    """As ``tidy``, of the tables of two cogroups."""

    def g(left: pa.Table, right: pa.Table) -> pa.Table:
        _begin(None)
        out = f(left, right)
        give_back()
        return out

    return g


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, over a whole array."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def components(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes over edges a-b, all in numpy."""
    parent = np.arange(n) if parent is None else parent
    while True:
        pa_, pb = parent[a], parent[b]
        odd = pa_ != pb
        if not odd.any():
            return parent
        a, b, pa_, pb = a[odd], b[odd], pa_[odd], pb[odd]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (node, root): the smallest node reachable over edges (a, b), for all but the roots.

    Alternating large-star and small-star steps: each is a grouped minimum (with partial
    aggregation) and one equi-join, so a hub costs no more than its edges. State is
    checkpointed each round; it ends when no edge changes, and raises if that takes more
    than ``rounds`` (where given).
    """
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, done = None, 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last, done = now, done + 1
        if done == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
