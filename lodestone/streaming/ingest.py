"""Streams: files ingested once by content, maintenance, and a windowed yield (the last beyond the survey)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.conditions import RULES


def ingest(spark: SparkSession, folder: str, known: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """ST01: new files of a folder whose (path, hash) isn't known go to ``sink``; the checkpoint and the known table make a repeat harmless."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    files = files.select("path", F.sha2("content", 256).alias("content_hash"), "content")

    def batch(df: DataFrame, _: int) -> None:
        sink(df.join(known().select("path", "content_hash"), ["path", "content_hash"], "left_anti"))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_yield(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Share of events that aren't errors, by window of event time; events later than ``late`` are dropped by the watermark. Works on streams and tables."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window))
    return g.agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("good")).select(F.col("window.start").alias("start"), "n", "good")


def maintenance(spark: SparkSession, action: Callable[[], None], every: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """ST02: run an action (prune orphans, compact) again and again; ``once`` runs it a single time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    w = ticks.writeStream.foreachBatch(lambda _, __: action())
    return (w.trigger(once=True) if once else w.trigger(processingTime=every)).start()


def progress_to(report: Callable[[str, int, int], None]):
    """ST04: a listener that tells (query, rows of the batch, rows so far) after each batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def __init__(self) -> None:
            self.done: dict[str, int] = {}

        def onQueryStarted(self, event) -> None:  # noqa: N802
            self.done[str(event.id)] = 0

        def onQueryProgress(self, event) -> None:  # noqa: N802
            p = event.progress
            self.done[str(p.id)] = self.done.get(str(p.id), 0) + p.numInputRows
            report(p.name or str(p.id), p.numInputRows, self.done[str(p.id)])

        def onQueryIdle(self, event) -> None:  # noqa: N802
            pass

        def onQueryTerminated(self, event) -> None:  # noqa: N802
            pass

    return Progress()


def sticky_stream(records: DataFrame, part_scope: bool = True, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """ST03: the conditions in force at each test of a stream of records(run, ord, rec_type, text), as "K=V,..."; the state of a run is its condition map.
    Records of a run must arrive in order over batches; within a batch they are put in order. The table version is operators.conditions."""
    import re

    import pandas as pd

    compiled = [(re.compile(pattern), action) for pattern, action in rules]

    def step(key, frames, state):
        cond = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for r in rows.itertuples(index=False):
            if r.rec_type == "DTR" and isinstance(r.text, str):
                m, action = next(((m, a) for rx, a in compiled if (m := rx.match(r.text))), (None, None))
                if action == "clear":
                    key_ = m[1].strip()
                    cond = {} if key_ in ("", "*") else {k: v for k, v in cond.items() if k != key_}
                elif action == "set":
                    for pair in m[1].split(","):
                        k, eq, v = pair.partition("=")
                        if eq and k.strip():
                            cond[k.strip()] = v.strip()
            elif r.rec_type == "PRR" and part_scope:
                cond = {}
            elif r.rec_type in ("PTR", "FTR", "MPR"):
                out.append((key[0], r.ord, ",".join(f"{k}={v}" for k, v in sorted(cond.items()))))
        state.update((list(cond), list(cond.values())))
        yield pd.DataFrame(out, columns=["run", "ord", "cond"])

    return records.groupBy("run").applyInPandasWithState(step, "run long, ord long, cond string", "k array<string>, v array<string>", "append", "NoTimeout")
