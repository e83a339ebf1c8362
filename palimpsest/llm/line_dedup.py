"""Line deduplication across documents (DataFrame only).

Lines are exploded with their positions, normalised and hashed once; distinct documents are
counted per hash; a line found in at least ``min_docs`` documents goes everywhere but in the
document with the largest id that has it; and documents are put together again by the
positions that are left.

Documents are counted by their ids: rows that share an id are one document (each loses its
own lines, and keeps those of which that id is the largest), and rows without an id count as
none and lose every line that goes. Null and empty texts are one empty line. Keys shorter
than ``min_chars`` never go. Repeated rows give a row each. Extra columns are ignored. An
empty table gives an empty result.

Of a line only 128 bits of hash, its row's key and its position are kept; a line that a third
of all documents hold is one of a bounded number of frequent ones, which are broadcast. A
text is shuffled once, to meet its own positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, split_hot

#: A-Z and a-z for the key's case folding.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits, as two longs: a collision of 64 is to be expected at 10^10 lines."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> list[Column]:
    """What tells a row by its content: rows that agree in it have the same lines."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): each line that is long enough to go."""
    rows = docs.select(*_row_key(), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return rows.withColumn("h", key_hash(F.col("key"))).select("doc_id", "t1", "t2", "pos", "h.h1", "h.h2")


def repeated_lines(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, n_lines, last_id) of line hashes found in ``min_docs`` documents or more."""
    each = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    counts = each.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last_id"), F.sum("n").alias("n_lines"))
    return counts.filter(F.col("docs") >= min_docs).select("h1", "h2", "n_lines", "last_id")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the text that is left)."""
    base = docs.select("doc_id", "text")
    lines = checkpoint(hashed_lines(base, min_chars))
    often = checkpoint(repeated_lines(lines, min_docs)).withColumn("h", F.struct("h1", "h2")).drop("h1", "h2")
    found = split_hot(lines.select("doc_id", "t1", "t2", "pos", F.struct("h1", "h2").alias("h")), often, "h", "n_lines", lines.count())
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("last_id")) | F.col("doc_id").isNull())
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.collect_set("pos").alias("gone"))
    rows = base.select("text", *_row_key())
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")
    rows = rows.select("doc_id", split_lines(F.col("text")).alias("lines"), "gone").withColumn("n", F.size("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")))
    dropped = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_lines"), dropped.cast("bigint").alias("n_dropped"), "kept")
