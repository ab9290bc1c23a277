"""Change feeds: incremental file pickup, change and alert streams, upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trolley.operators.prices import latest
from trolley.operators.shared import ship


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, each read once."""
    return spark.readStream.schema(schema).parquet(path)


def unique(stream: DataFrame, key: str, at: str, delay: str = "2 hours") -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


#: Days without an event after which a key's state goes; its next event counts as a first one.
SILENT_DAYS = 90


class _Feed(StatefulProcessor):
    """The last event of a key (time, its ties, value, whether an alert is armed) and a timer that ends a silent key.

    Events count in the order of time and ties; one before the last is ignored. A key that was silent for longer starts anew,
    whether or not its timer has run: so what comes out does not depend on how events fall into batches.
    """

    def __init__(self, keys: list[str], at: str, order: list[str], value: str, kind: str, below, rearm, silent_days: int):
        self.keys, self.at, self.order, self.value, self.kind = keys, at, order, value, kind
        self.below, self.rearm, self.silent = below, rearm, silent_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ties = "".join(f", tie{k} string" for k in range(len(self.order)))
        self.last = handle.getValueState("last", f"at long{ties}, value string, armed boolean")

    def _emits(self, before, value, armed: bool) -> tuple[bool, bool]:
        if self.below is None:
            return before is None or before != str(value), armed
        if armed and value < self.below:
            return True, False
        return False, armed or value >= self.rearm

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).dropna(subset=[self.at, self.value]).sort_values([self.at, *self.order], kind="stable", ignore_index=True)
        state = self.last.get()
        last = None if state is None else (int(state[0]), *[_ordered(x) for x in state[1:-2]])
        before, armed = (None, True) if state is None else (state[-2], bool(state[-1]))
        micros = frame[self.at].astype("datetime64[us]").astype("int64")
        keep = []
        for k, (at, value) in enumerate(zip(micros, frame[self.value], strict=True)):
            place = (int(at), *[_ordered(frame[c].iloc[k]) for c in self.order])
            if last is not None and place < last:
                continue
            if last is not None and place[0] - last[0] > self.silent:
                before, armed = None, True
            emit, armed = self._emits(before, value, armed)
            last, before = place, str(value)
            if emit:
                keep.append(k)
        if last is not None:
            self.last.update((last[0], *[x if isinstance(x, str) else repr(x) for x in last[1:]], before, armed))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last[0] + self.silent) // 1000 + 1)
        yield frame.iloc[keep][[*self.keys, self.at, *self.order, self.value]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(x):
    """A tie as a value that sorts: numbers as numbers, whether they come from a row or from the state."""
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def _stateful(stream: DataFrame, keys: list[str], at: str, order: list[str], value: str, below, rearm, silent_days: int, delay: str) -> DataFrame:
    spark = ship(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(*keys, F.col(at).cast("timestamp").alias(at), *order, value).withWatermark(at, delay)
    feed = _Feed(keys, at, order, value, dict(stream.dtypes)[value], below, rearm, silent_days)
    return rows.groupBy(*keys).transformWithStateInPandas(feed, outputStructType=rows.schema, outputMode="Append", timeMode="eventTime")


def changes(stream: DataFrame, keys: list[str], at: str, value: str, order: list[str] = (), silent_days: int = SILENT_DAYS, delay: str = "2 hours") -> DataFrame:
    """keys, at, order, value where the value differs from the key's last one, or the key was silent for longer; values keep their type."""
    return _stateful(stream, list(keys), at, list(order), value, None, None, silent_days, delay)


def alerts(stream: DataFrame, keys: list[str], at: str, value: str, below, rearm=None, order: list[str] = (), silent_days: int = SILENT_DAYS, delay: str = "2 hours") -> DataFrame:
    """keys, at, order, value each time the value falls below the threshold, once until it has reached `rearm` (the threshold, if not given) again."""
    return _stateful(stream, list(keys), at, list(order), value, below, below if rearm is None else rearm, silent_days, delay)


def apply_deltas(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list, every: int = 24):
    """Keep a table under its deltas: a micro-batch writes itself only; every so many are merged into a new base.

    A batch that is run again overwrites its own folder, so nothing is applied twice. `current` reads the table.
    """

    def merge(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if (n + 1) % every == 0:
            spark = batch.sparkSession
            base = _merged(spark, path, keys, order, n)
            base.write.mode("overwrite").parquet(f"{path}/base={n + 1}")
            for name, k in _parts(spark, path):
                if k <= n - every or (name == "batch" and k <= n):
                    _folder(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={k}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The finished folders of a table under its deltas: (base or batch, number)."""
    fs, at = _folder(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    names = [x.getPath().getName() for x in fs.listStatus(at(path))]
    return sorted((a, int(n)) for a, _, n in (x.partition("=") for x in names) if a in ("base", "batch") and fs.exists(at(f"{path}/{a}={n}/_SUCCESS")))


def _merged(spark: SparkSession, path: str, keys: list[str], order: list, last: int) -> DataFrame:
    """The newest base under the batches from it up to `last`: of rows with equal keys the first in order."""
    parts = _parts(spark, path)
    start = max([n for a, n in parts if a == "base" and n <= last], default=None)
    names = [f"{path}/{a}={n}" for a, n in parts if (a, n) == ("base", start) or (a == "batch" and (start or 0) <= n <= last)]
    return latest(spark.read.parquet(*names), keys, order)


def current(spark: SparkSession, path: str, keys: list[str], order: list) -> DataFrame:
    """The table as it stands: its newest base and the batches since."""
    return _merged(spark, path, keys, order, 1 << 62)
