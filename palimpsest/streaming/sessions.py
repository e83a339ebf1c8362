"""Placeholders over a stream of texts: ids stay as they are from batch to batch.

State is kept per session: counters, keys and their tags. It is dropped after a session has
been silent for a while."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pseudonymize import mentions

OUT = "session string, doc_id long, start int, end int, entity_type string, value string, tag string"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    count, tags = (json.loads(x) for x in state.get) if state.exists else ({}, {})
    rows = pd.concat(list(batches)).sort_values(["text_ord", "start"], kind="stable")
    out = []
    for kind, value in zip(rows["entity_type"], rows["value"]):
        name = f"{kind}::{value}"
        if name not in tags:
            count[kind] = count.get(kind, 0) + 1
            gender = ' gender="unknown"' if kind == "PERSON" else ""
            tags[name] = f'<PII type="{kind}"{gender} id="{count[kind]}" />'
        out.append(tags[name])
    state.update((json.dumps(count), json.dumps(tags)))
    state.setTimeoutDuration(3_600_000)
    yield rows.assign(tag=out, session=str(key[0]))[["session", "doc_id", "start", "end", "entity_type", "value", "tag"]]


def stream_placeholders(found: DataFrame) -> DataFrame:
    """found: streaming (session, text_ord, doc_id, norm, spans). Exact keys only."""
    rows = mentions(found).withColumn("session", F.col("session").cast("string"))
    return rows.groupBy("session").applyInPandasWithState(_step, OUT, "counts string, tags string", "append", GroupStateTimeout.ProcessingTimeTimeout)
