"""Structured Streaming forms: request/response rendezvous, metric averages, counting windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """An append-only JSONL log as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def rendezvous(requests: DataFrame, responses: DataFrame, timeout: str = "10 minutes", low: float = -1.5, high: float = 1.0) -> DataFrame:
    """Scores joined to their requests by (step, group, item), clamped; either side waits for `timeout`.

    Both sides have a timestamp `at`; state older than the watermark is dropped."""
    r = requests.withWatermark("at", timeout).alias("r")
    s = responses.withWatermark("at", timeout).alias("s")
    same = F.expr(f"r.step = s.step and r.grp = s.grp and r.item = s.item and s.at >= r.at and s.at <= r.at + interval {timeout}")
    joined = r.join(s, same)
    return joined.select("r.step", "r.grp", "r.item", F.greatest(F.lit(low), F.least(F.lit(high), F.col("s.score"))).alias("score"))


def running_average(log: DataFrame, keep: float = 0.95) -> DataFrame:
    """(run, step, loss, ema): an exponential average for each run, continued from batch to batch.

    Events of a batch are taken in order of their step; events at or under the last step seen are late and
    give no row."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, loss in zip(rows["step"], rows["loss"]):
            if step <= last or loss != loss:
                continue
            value = loss if value is None else keep * value + (1 - keep) * loss
            last = int(step)
            out.append((key[0], last, loss, value))
        if value is not None:
            state.update((last, float(value)))
        yield pd.DataFrame(out, columns=["run", "step", "loss", "ema"])

    return log.groupBy("run").applyInPandasWithState(fold, "run string, step long, loss double, ema double", "last long, value double", "append", GroupStateTimeout.NoTimeout)


def counting_windows(events: DataFrame, size: int) -> DataFrame:
    """(key, window, n, rate): each full window of `size` events of a key, in order of `seq`, then reset."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, hits = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for ok in rows["ok"]:
            n, hits = n + 1, hits + int(bool(ok))
            if n == size:
                out.append((key[0], window, n, hits / n))
                window, n, hits = window + 1, 0, 0
        state.update((window, n, hits))
        yield pd.DataFrame(out, columns=["key", "window", "n", "rate"])

    return events.groupBy("key").applyInPandasWithState(fold, "key string, window long, n long, rate double", "window long, n long, hits long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drive a stream over all it has to a Parquet folder, exactly once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
