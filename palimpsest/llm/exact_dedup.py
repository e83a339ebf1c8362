"""Exact deduplication by a log-structured merge index of text digests (DataFrame only).

* **Memtables.** Entries (id and digest of each row) are dealt to memtables of bounded size,
  by the tasks that wrote them (``MEMTABLE`` entries each, about).
* **Flush.** Each memtable becomes a sorted run: one row a digest, with its smallest id and
  its count. Copies within a task are folded before anything is shuffled.
* **Filters.** Runs have membership bits of their digests. Bits that two or more runs have
  make one filter of bounded size; a digest that it rules out lies in one run alone and skips
  the merges.
* **Compaction.** Level by level ``FAN`` neighbouring runs become one: the smallest id wins,
  counts add up. Runs are dealt by digest once (a digest has one row a run at most), and all
  levels merge where they lie.
* **Byte verification.** Rows whose digest occurs twice or more (told by a filter of those
  digests) are compared in their normalised bytes; rows that differ form classes of their own.

Null texts are empty; an empty text is a text like any other, so all empty rows are one
class. A null id counts only in a group of null ids. Equal (doc_id, text) rows are counted
each, and one of them stays. Extra columns may have any names and nulls: ``exact_duplicates``
ignores them, ``keep_first`` gives them back. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, checkpoint, split_hot

#: Entries of a memtable, about; runs that a merge takes.
MEMTABLE, FAN = 1 << 20, 4
#: Words of 64 bits in a filter: as many as keep one bit in 16 set, between these (8 MB at most).
FILTER_WORDS = (1 << 10, 1 << 19)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha) of every row; 40 bytes a row, so the checkpoint is small."""
    return docs.select("doc_id", text_digest(F.col("text")).alias("sha"))


def memtables(entries: DataFrame, count: int, tasks: int) -> DataFrame:
    """``entries`` with ``run``, the memtable that each goes to: that of the task that reads it
    (of ``tasks``), and where memtables are more than tasks, one of its task's own."""
    each = -(-count // tasks)
    own = F.pmod(F.xxhash64("digest"), F.lit(each)) if each > 1 else F.lit(0)
    return entries.withColumn("run", F.floor((F.spark_partition_id() * each + own) * count / (tasks * each)).cast("int"))


def flush(entries: DataFrame) -> DataFrame:
    """(run, digest, keep_id, group_size): sorted runs of the memtables."""
    runs = entries.groupBy("run", "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return runs.sortWithinPartitions("run", "digest")


def filter_words(rows: int) -> int:
    """Words of a filter for so many digests, a power of two."""
    low, high = FILTER_WORDS
    return min(high, max(low, 1 << (rows // 4).bit_length()))


def _slot(digest: Column, words: int) -> list[Column]:
    h = F.xxhash64(digest)
    return [F.pmod(h, F.lit(words)).alias("word"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int").alias("bit")]


def shared_filter(runs: DataFrame, words: int) -> DataFrame:
    """(word, bits): of the runs' membership bits those that two or more runs have."""
    bits = runs.select("run", *_slot(F.col("digest"), words)).groupBy("word", "bit").agg(F.min("run").alias("a"), F.max("run").alias("b"))
    return bits.filter("a < b").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def passing(rows: DataFrame, bits: DataFrame, words: int, digest: str = "digest", keep: bool = False) -> DataFrame:
    """The rows whose digest a filter (word, bits) doesn't rule out; with ``keep`` all rows,
    and ``passes``. A filter has ``words`` rows at most, so it is broadcast."""
    word, bit = _slot(F.col(digest), words)
    tested = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word", "left" if keep else "inner")
    tested = tested.withColumn("passes", F.coalesce(F.expr("(shiftright(bits, bit) & 1L) = 1L"), F.lit(False))).drop("word", "bit", "bits")
    return tested if keep else tested.filter("passes").drop("passes")


def may_contain(rows: DataFrame, table: DataFrame, words: int, digest: str = "digest") -> DataFrame:
    """The rows whose digest may be one of ``table``'s."""
    bits = table.select(*_slot(F.col("digest"), words)).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return passing(rows, bits, words, digest)


def compact(runs: DataFrame, count: int, fan: int = FAN) -> DataFrame:
    """(digest, keep_id, group_size): ``count`` runs merged level by level into one."""
    merged = runs.repartition("digest")
    while count > 1:
        level = merged.groupBy((F.col("run") / fan).cast("int").alias("run"), "digest")
        merged = level.agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        count = -(-count // fan)
    return merged.select("digest", "keep_id", "group_size")


def build_index(entries: DataFrame, rows: int, memtable: int = MEMTABLE, fan: int = FAN) -> DataFrame:
    """(digest, keep_id, group_size) of entries (doc_id, digest), of which there are ``rows``.

    A small input still has some runs (an eighth of it each), so it goes the same way."""
    count, words = max(8, -(-rows // memtable)), filter_words(rows)
    tasks = 1 + (entries.select(F.spark_partition_id().alias("task")).agg(F.max("task").alias("last")).first()["last"] or 0)
    runs = checkpoint(flush(memtables(entries, count, tasks)))
    tested = passing(runs, shared_filter(runs, words), words, keep=True)
    alone = tested.filter("not passes").select("digest", "keep_id", "group_size")
    return alone.unionByName(compact(tested.filter("passes").drop("passes"), count, fan))


def collisions(hits: DataFrame) -> DataFrame:
    """Digests whose rows differ in bytes. The smallest and largest text of a digest are
    the same exactly if all are; partial aggregation folds a hot group within each task."""
    return hits.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest")


def _classes(docs: DataFrame, key: Callable[[Column], Column], memtable: int) -> DataFrame:
    """Per row: doc_id, sha, keep_id, group_size."""
    docs = docs.select("doc_id", "text")
    entries = checkpoint(digests(docs)).withColumn("digest", key(F.col("sha")))
    rows = entries.count()
    index = checkpoint(build_index(entries.select("doc_id", "digest"), rows, memtable))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"), text_digest(F.col("text")).alias("sha")).withColumn("digest", key(F.col("sha")))
    hits = may_contain(texts, index.filter("group_size > 1"), filter_words(rows))
    odd = checkpoint(collisions(hits))
    if not odd.isEmpty():  # those digests' rows are told apart by a second digest
        again = hits.join(odd, "digest").select("doc_id", "sha", F.concat("sha", F.unhex(F.md5("norm")), F.encode(F.substring("norm", 1, 64), "UTF-8")).alias("digest"))
        entries = checkpoint(entries.join(odd, "digest", "left_anti").select("doc_id", "sha", "digest").unionByName(again))
        index = checkpoint(build_index(entries.select("doc_id", "digest"), rows, memtable))
    return split_hot(entries, index, "digest", "group_size", rows)


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = lambda sha: sha, memtable: int = MEMTABLE) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text).

    ``key`` makes the index's digest of the text's SHA-256 (itself, but in tests). A text is
    shuffled only if its digest occurs twice or more (or the filter can't rule that out), and
    copies are folded before."""
    out = _classes(docs, key, memtable)
    # Of rows with equal id and text one stays.
    out = out.groupBy("doc_id", "keep_id", "group_size", "sha").agg(F.count("*").alias("n"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (for the pipeline): of each class
    one row of the smallest id (which one, where rows of equal id and text differ in other
    columns, isn't said). Nulls, empty tables and clashing names as the module's text has it."""
    stay = _classes(docs, lambda sha: sha, MEMTABLE).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = checkpoint(stay.groupBy(F.col("doc_id").alias("stay_id"), F.col("sha").alias("stay_sha")).agg(F.count("*").alias("copies")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), text_digest(F.col("text")).alias("own_sha"))
    rows = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_sha") == F.col("stay_sha")), "left_semi")
    if not stay.filter("copies > 1").isEmpty():
        rows = rows.dropDuplicates(["own_id", "own_sha"])
    return rows.select("row.*")
