"""Structured Streaming: detection on arriving documents, sessions as keyed state, windows on events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import spans as S
from ..operators.redact import identity
from ..operators.rules import Rule, detect
from ..operators.session import token


def detect_stream(docs: DataFrame, rules: list[Rule] | None = None, **names) -> DataFrame:
    """Entities of a streaming DataFrame of documents; narrow and stateless, so any output mode works."""
    return detect(docs, rules, **names)


def session_placeholders(entities: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Placeholders of streaming entities (session_id, doc_seq, start, label, text), numbered in a session as they arrive.

    The state of a session holds the number of each identity and the last number of each
    label. Rows of one micro-batch are numbered in the order of doc_seq and start. A session that
    has had no rows for `idle_ms` milliseconds expires: its state is dropped and its numbers begin
    again; without it, state is kept for ever.
    """
    keyed = entities.select("session_id", F.col("doc_seq").cast("long"), F.col("start").cast("int"), S.label_key("label").alias("key"), identity(F.col("label"), F.col("text")).alias("ident"), "text")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        idents, numbers, lasts = state.get if state.exists else ([], [], [])
        known = dict(zip(idents, numbers, strict=True))
        last = {k: int(n) for k, _, n in (x.rpartition("=") for x in lasts)}
        rows = pd.concat(list(batches)).sort_values(["doc_seq", "start", "ident"])
        out = []
        for r in rows.itertuples(index=False):
            name = f"{r.key}\x1f{r.ident}"
            if name not in known:
                known[name] = last[r.key] = last.get(r.key, 0) + 1
            out.append((r.session_id, r.doc_seq, r.start, r.key, known[name], r.text))
        state.update((list(known), list(known.values()), [f"{k}={n}" for k, n in last.items()]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "doc_seq", "start", "key", "number", "text"])

    numbered = keyed.groupBy("session_id").applyInPandasWithState(
        run, "session_id string, doc_seq long, start int, key string, number long, text string", "idents array<string>, numbers array<long>, lasts array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    return numbered.withColumn("placeholder", token(F.col("session_id"), F.col("key"), F.col("number")))


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, event_type, n_events, total: tumbling windows, with a watermark on streams."""
    source = events.withWatermark("ts", late) if late else events
    counts = source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    source = events.withWatermark("ts", late) if late else events
    counts = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def upsert_changed(batch: DataFrame, current: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """The state of blocks after a micro-batch: for each key the row with the highest revision; stale ones lose."""
    rows = current.unionByName(batch)
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), revision).alias("r")).select(*key, "r.*")
