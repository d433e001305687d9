"""The status history of documents: one state machine, over a table and over a stream.

Events (doc_id, stage, status, at) are judged in the order of their own time, not of
their arrival. A stage above all earlier ones is ``applied``; the same stage again is
``repeat``, or ``conflict`` if the status differs; a lower stage with a later time is
``backward`` and changes nothing. An event that only arrives late takes its place in
time, so it is told apart from one that goes backward. A document that stays in a stage
before the last for longer than ``stuck_after`` gets a ``stuck`` row at that moment.

The stream keeps events until the watermark has passed them, judges them by timers, a
group of documents at a time, and gives the rows that the table gives for the time up to the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

LAST_STAGE = 2
LATE, STUCK_AFTER = "10 minutes", "30 minutes"
OUT = "doc_id string, stage int, status string, at timestamp, kind string"
#: Groups that the documents of a stream are dealt to: a batch costs calls for each group it touches, and rewrites the group's state.
GROUPS = 1 << 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(status: DataFrame) -> DataFrame:
    return status.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("stage").cast("int").alias("stage"), "status", F.date_trunc("millisecond", F.col("at").cast("timestamp")).alias("at")).filter("doc_id IS NOT NULL AND stage IS NOT NULL AND at IS NOT NULL")


def history(status: DataFrame, late: str = LATE, stuck_after: str = STUCK_AFTER) -> DataFrame:
    """(doc_id, stage, status, at, kind) of a table, up to its last time less ``late``."""
    events = _events(status)
    until = events.agg((F.max("at") - F.expr(f"INTERVAL {late}")).alias("until"))
    events = events.join(F.broadcast(until), F.col("at") <= F.col("until"))
    order = Window.partitionBy("doc_id").orderBy("at", "stage", "status")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max("stage").over(before), F.lit(-1))
    judged = events.withColumn("high", high).withColumn("first_of_stage", F.first("status").over(Window.partitionBy("doc_id", "stage").orderBy("at", "status")))
    kind = F.when(F.col("stage") > F.col("high"), "applied").when(F.col("stage") < F.col("high"), "backward").when(F.col("status").eqNullSafe(F.col("first_of_stage")), "repeat").otherwise("conflict")
    judged = judged.withColumn("kind", kind)
    moves = judged.filter("kind = 'applied'").withColumn("next", F.lead("at").over(order)).withColumn("due", F.col("at") + F.expr(f"INTERVAL {stuck_after}"))
    stuck = moves.filter((F.col("stage") < LAST_STAGE) & (F.col("due") <= F.col("until")) & (F.col("next").isNull() | (F.col("next") > F.col("due"))))
    return judged.select("doc_id", "stage", "status", "at", "kind").unionByName(stuck.select("doc_id", "stage", "status", F.col("due").alias("at"), F.lit("stuck").alias("kind")))


class Machine(StatefulProcessor):
    """The documents of a group: their open events, highest stages and when they are overdue.

    The group's state is one value and one timer, so that the calls to the JVM, of which
    each takes longer than the judging of a document, are counted by groups.
    """

    def __init__(self, stuck_ms: int) -> None:
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # documents: {doc_id: [stage, status, due]}, events: [[doc_id, stage, status, ms]], as JSON
        self.state = handle.getValueState("state", "documents string, events string, timer long")

    def _load(self) -> tuple[dict, list, int | None]:
        """(documents, events, timer)."""
        if (got := self.state.get()) is None:
            return {}, [], None
        documents, events, timer = got
        return json.loads(documents), json.loads(events), timer

    def _save(self, documents: dict, events: list, timer: int | None) -> None:
        """Keeps one timer, the first moment at which there is something to judge."""
        first = min([e[3] for e in events] + [d[2] for d in documents.values() if d[2] is not None], default=None)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        self.state.update((json.dumps(documents), json.dumps(events), timer))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        documents, events, timer = self._load()
        for batch in rows:
            # a group of one document may go by its name
            names = batch["doc_id"].tolist() if "doc_id" in batch else list(key) * len(batch)
            events += [[d, int(s), None if pd.isna(t) else str(t), int(m)] for d, s, t, m in zip(names, batch["stage"].tolist(), batch["status"].tolist(), batch["ms"].tolist(), strict=True)]
        self._save(documents, events, timer)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        documents, events, timer = self._load()
        due_now, later = [e for e in events if e[3] <= until], [e for e in events if e[3] > until]
        timer = None if timer is None or timer <= until else timer
        out = []
        for doc, s, t, at in sorted(due_now, key=lambda e: (e[3], e[1], e[2] is not None, e[2] or "")):
            stage, status, due = documents.get(doc, (-1, None, None))
            if s > stage:
                if due is not None and at > due:
                    out.append((doc, stage, status, due, "stuck"))
                documents[doc] = [s, t, at + self.stuck_ms if s < LAST_STAGE else None]
                out.append((doc, s, t, at, "applied"))
            else:
                out.append((doc, s, t, at, "backward" if s < stage else "repeat" if t == status else "conflict"))
        for doc, state in documents.items():
            stage, status, due = state
            if due is not None and due <= until:
                out.append((doc, stage, status, due, "stuck"))
                state[2] = None
        self._save(documents, later, timer)
        if out:
            docs, stages, statuses, times, kinds = zip(*out, strict=True)
            yield pd.DataFrame({"doc_id": docs, "stage": stages, "status": statuses, "at": pd.to_datetime(times, unit="ms"), "kind": kinds}).astype({"stage": "int32"})

    def close(self) -> None:
        pass


def live_history(status: DataFrame, late: str = LATE, stuck_after: str = STUCK_AFTER, groups: int = GROUPS) -> DataFrame:
    """:func:`history` of a stream, as its watermark moves on; needs the RocksDB state store.

    Documents are judged in ``groups`` by hash, a number that holds as long as a checkpoint.
    """
    spark = status.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start = "TIMESTAMP'2000-01-01'"
    stuck_ms = spark.sql(f"SELECT unix_millis({start} + INTERVAL {stuck_after}) - unix_millis({start}) AS ms").first().ms
    events = _events(status).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    grouped = events.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).groupBy("group")
    return grouped.transformWithStateInPandas(Machine(stuck_ms), OUT, "Append", "EventTime")
