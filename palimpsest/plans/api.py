"""The engine's two calls over DataFrames, and what it can do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import __version__
from ..functions import fixed as X
from ..functions.lineage import checkpoint
from ..operators import pseudonymize as P
from ..operators.detect import Catalog, default_catalog, detect
from ..operators.render import allowed, check_mode, render
from ..operators.restore import restore
from ..sources.config import Settings

PROMPT = """Texts hold placeholders such as <PII type="PERSON" id="1" />. Each stands for a value
that you don't see. Copy a placeholder letter for letter where you need its value; make no
new ones, don't change their attributes, and never guess what they hide."""


def texts(spark: SparkSession, values: str | list[str]) -> DataFrame:
    """A string or a list of strings as documents, numbered from 0; an empty list is no rows."""
    values = [values] if isinstance(values, str) else list(values)
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def limited(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Documents within the length limit, and (doc_id, reason, n_chars) of those beyond it:
    never a refused text itself."""
    n = F.char_length("text")
    over = docs.filter(n > settings.max_text_chars).select("doc_id", F.lit("text too long").alias("reason"), n.alias("n_chars"))
    return docs.filter(n.isNull() | (n <= settings.max_text_chars)), over


def anonymize(docs: DataFrame, mode: str = "mask", entities: list[str] | None = None, settings: Settings | None = None, catalog: Catalog | None = None, model: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text; session and text_ord for placeholders) -> doc_id, rendered, spans,
    norm, rejected. Placeholder ids are shared within a session; without one, all rows are
    one session in order of doc_id. The mapping is ``placeholders(...)``."""
    settings = settings or Settings()
    check_mode(mode)
    found = detect(docs, catalog, model=model, translit=settings.translit, english=settings.english_numbers, base64=settings.base64)
    found = found.withColumn("spans", allowed(F.col("spans"), entities, list(settings.entities)))
    if mode == "pseudonymize":
        found = checkpoint(with_sessions(found, docs))
        return P.placed(found, P.assign(found)).select("session", "text_ord", "doc_id", "rendered", "spans", "norm", "rejected")
    return render(found, mode, settings.mask_char, settings.mask_count, settings.mask_from_end).select("doc_id", "rendered", "spans", "norm", "rejected")


def with_sessions(found: DataFrame, docs: DataFrame) -> DataFrame:
    if "session" not in docs.columns:
        return found.withColumns({"session": F.lit(0).cast("long"), "text_ord": F.col("doc_id").cast("long")})
    order = "text_ord" if "text_ord" in docs.columns else "doc_id"
    return found.join(docs.select("doc_id", "session", F.col(order).cast("long").alias("text_ord")), "doc_id")


def placeholders(docs: DataFrame, entities: list[str] | None = None, settings: Settings | None = None, catalog: Catalog | None = None, model: DataFrame | None = None) -> DataFrame:
    """(session, tag, entity_type, id, value) for the same call in mode pseudonymize."""
    settings = settings or Settings()
    found = detect(docs, catalog, model=model, translit=settings.translit, english=settings.english_numbers, base64=settings.base64)
    found = checkpoint(with_sessions(found.withColumn("spans", allowed(F.col("spans"), entities, list(settings.entities))), docs))
    return P.mapping(P.assign(found))


def deanonymize(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs (session, doc_id, text) with ``restored`` and ``rejected``: a session whose mapping
    is beyond the ceilings is refused as a whole, with the reason, and nothing is restored."""
    beyond = checkpoint(P.refused(mapping)).select("session", F.col("reason").alias("rejected"))
    out = restore(docs, mapping.join(beyond, "session", "left_anti")).join(beyond, "session", "left")
    return out.withColumn("restored", F.when(F.col("rejected").isNull(), F.col("restored")))


def capabilities(spark: SparkSession, settings: Settings | None = None, catalog: Catalog | None = None) -> DataFrame:
    """One row: version, device, configured types, and those that can't be found here (types
    of the model branch while it is off, and unknown names)."""
    settings, catalog = settings or Settings(), catalog or default_catalog()
    have = [t for t in catalog.entity_types() if not (settings.ner_disabled or not settings.model_name) or t not in X.MODEL_ONLY]
    row = spark.range(1).select(
        F.lit(__version__).alias("version"), F.lit(settings.device or "auto").alias("device"), F.array(*map(F.lit, settings.entities)).alias("configured"), F.array(*map(F.lit, have)).alias("have")
    )
    return row.select("version", "device", "configured", F.array_sort(F.array_except("configured", "have")).alias("unavailable"))
