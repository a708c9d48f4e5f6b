"""The training monitor as a stream: an extension of the batch form in operators.training.

Labelled texts arrive as files, each with its run and step. Steps are aggregated per micro-batch and folded
into the run's state: the first step's usable rate, and strikes in a row. ``early_stop`` takes steps in order within
a run, each whole within a micro-batch, as the monitor writes them; ``early_stop_by_time`` takes them in parts and
in any order, sums them up, and lets the watermark close them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run string, step int, usable_rate double, strike boolean, stop boolean"
STATE = "base double, strikes int, stopped boolean, last int"


def read_log(spark: SparkSession, path: str, schema: str = "run string, step int, usable_rate double") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def early_stop(log: DataFrame, drop: float = 0.10) -> DataFrame:
    """Rows of OUTPUT for a stream (run, step, usable_rate); stop is true once a run, at its second strike in a row."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, strikes, stopped, last = state.get if state.exists else (None, 0, False, -1)
        out = []
        for r in pd.concat(list(parts)).sort_values("step").itertuples():
            if r.step <= last:
                continue
            last = int(r.step)
            if base is None:
                base = float(r.usable_rate)
                out.append((key[0], last, r.usable_rate, False, False))
                continue
            strike = bool(r.usable_rate < base - drop)
            strikes = strikes + 1 if strike else 0
            stop = strikes >= 2 and not stopped
            stopped = stopped or stop
            out.append((key[0], last, r.usable_rate, strike, stop))
        state.update((base, strikes, stopped, last))
        yield pd.DataFrame(out, columns=["run", "step", "usable_rate", "strike", "stop"])

    return log.groupBy("run").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


# --- steps in parts, in any order -------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLD = "base double, last long, strikes int, stopped boolean"
VERDICTS = "run string, step long, usable_rate double, strike boolean, stop boolean"


class Strikes(StatefulProcessor):
    """Of each run, in the state store, the first step's rate and the strikes in a row."""

    def __init__(self, drop: float) -> None:
        self.drop = drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", FOLD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, last, strikes, stopped = self.fold.get() if self.fold.exists() else (None, None, 0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("step").itertuples():
            rate, step = float(r.usable_rate), int(r.step)
            strike = base is not None and rate < base - self.drop
            base, last = rate if base is None else base, step
            strikes = strikes + 1 if strike else 0
            stop = strikes >= 2 and not stopped
            stopped = stopped or stop
            out.append((key[0], step, rate, strike, stop))
        self.fold.update((base, last, strikes, stopped))
        yield pd.DataFrame(out, columns=["run", "step", "usable_rate", "strike", "stop"])

    def close(self) -> None:
        pass


def closed_steps(texts: DataFrame, delay: str, length: str = "1 day") -> DataFrame:
    """run, step, usable_rate of a stream (run, at, usable), once the watermark has passed a step's end.

    A step is a stretch of time, numbered from the epoch; its texts may come in any number of micro-batches, and late by
    up to the delay. Only sums and counts of open steps are kept.
    """
    step = F.window("at", length)
    sums = texts.withWatermark("at", delay).groupBy("run", step.alias("w")).agg(F.avg(F.col("usable").cast("double")).alias("usable_rate"))
    size = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return sums.select("run", F.floor(F.unix_seconds("w.start") / size).alias("step"), "usable_rate")


def early_stop_by_time(texts: DataFrame, delay: str, length: str = "1 day", drop: float = 0.10) -> DataFrame:
    """Rows of VERDICTS for a stream (run, at, usable) whose steps come in parts and in any order within the delay.

    Steps close in the order of their time, so a run's state takes them in that order. Needs the RocksDB state store.
    """
    own = closed_steps(texts, delay, length).groupBy("run")
    return own.transformWithStateInPandas(statefulProcessor=Strikes(drop), outputStructType=VERDICTS, outputMode="Append", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, timeout: int = 600) -> DataFrame:
    """All that the stream's source holds now, written to a table, which is read back; goes on where the checkpoint left off."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} seconds")
    return spark.read.schema(stream.schema).parquet(path)
