"""Labelled data in, and results out."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.evaluate import gold_spans


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    """A Python list in a cell; anything else is an empty list."""

    def read(cell):
        try:
            value = ast.literal_eval(cell)
        except (ValueError, SyntaxError, TypeError):
            return []
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else []

    return cells.map(read)


def _cases(rows: DataFrame) -> DataFrame:
    """row_id, text, source, gold. A missing id is the row's number; an empty text is the tokens."""
    for name in ("id", "text", "tokens", "ner_tags", "source"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    # The ids are looked at before numbers are made: only rows without one are numbered.
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("t", _literal("tokens")).withColumn("g", _literal("ner_tags"))
    number = F.row_number().over(Window.orderBy("_n")) if rows.filter("id is null or trim(id) = ''").limit(1).count() else F.lit(0)
    rows = rows.withColumn("row_id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), number.cast("string")))
    rows = rows.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.array_join("t", " ")))
    return rows.select("row_id", "text", "source", gold_spans(F.col("text"), F.col("t"), F.col("g")).alias("gold"))


def read_iob2_csv(spark: SparkSession, path: str) -> DataFrame:
    return _cases(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_iob2_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, where openpyxl is installed; read on the driver."""
    return _cases(spark.createDataFrame(pd.read_excel(path, dtype=str).where(lambda d: d.notna(), None)))


SPAN = "array<struct<start:int,end:int,type:string>>"
DUMP = f"id string, text string, normalized_text string, split string, gold {SPAN}, pred array<struct<start:int,end:int,entity_type:string,family:string,rule:string,score:double>>"
MANIFEST = "runs array<struct<dataset:string,system:string,dump:string,split:string,split_from:string,limit:int,label:string,peers:array<string>>>, out string"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DUMP).json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("runs").alias("r"), "out").select("r.*", "out")


def dataset_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of a data file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """The committer makes the folder's content appear as a whole."""
    rows.write.mode("overwrite").json(path)


def summary(scores: DataFrame) -> str:
    """A few lines of text from a metrics table (a row a label)."""
    rows = scores.orderBy(F.col("label").isNull(), "label").collect()
    return "\n".join(f"{r['label'] or 'all':<20} P {r['precision']:.4f} R {r['recall']:.4f} F1 {r['f1']:.4f} n {r['support']}" for r in rows)
