"""Keyed state of a stream: how long each key has been silent, kept by the state store between runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..cluster import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The groups that keys are dealt to by hash; part of the state's layout, so a checkpoint keeps the number it began with.
BUCKETS = 4096


class Silence(StatefulProcessor):
    """Emits (key, order, run) for every row: the number of zero rows in a row up to it, 0 for one that is not zero.

    A group is a bucket of keys, as a call costs as much as hundreds of rows. State is one number for each key in a run, by the
    key's text; with ttl_ms a key that has had no row for so long begins anew."""

    def __init__(self, key: str, order: str, ttl_ms: int | None):
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", StructType([StructField("key", StringType())]), StructType([StructField("run", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("at", kind="stable")
        code, names = pd.factorize(rows["name"])
        by_key = np.argsort(code, kind="stable")
        rows, code = rows.iloc[by_key], code[by_key]
        zero, place = rows["zero"].fillna(False).to_numpy(dtype=bool), np.arange(len(rows))
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        held = np.array([(self.runs.getValue((name,)) or (0,))[0] for name in names], dtype=np.int64)
        # a run counts from the key's last row that was not zero; the first one goes on from the state
        last = np.maximum.accumulate(np.where(zero, -1, place))
        run = np.where(last >= begins[code], place - last, place - begins[code] + 1 + held[code])
        for name, old, new in zip(names, held.tolist(), run[np.append(begins[1:], len(run)) - 1].tolist(), strict=True):
            if new and (new != old or self.ttl_ms):
                self.runs.updateValue((name,), (new,))
            elif old and not new:
                self.runs.removeKey((name,))
        yield pd.DataFrame({self.key: rows["key"].to_numpy(), self.order: rows["at"].to_numpy(), "run": run})

    def close(self) -> None:
        pass


def silent_runs(stream: DataFrame, key: str, order: str, zero: str, ttl_ms: int | None = None) -> DataFrame:
    """key, order, run of a stream whose batches arrive in order; rows are put in order within a batch.

    A batch's rows of one bucket of keys are held at once, so bound batches by maxFilesPerTrigger. The state store is RocksDB, in
    the query's checkpoint: a query that is started again goes on with the runs that it had. A null zero is not zero."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    text = f"coalesce('=' || CAST(`{key}` AS STRING), '')"
    rows = stream.selectExpr(f"`{key}` AS key", f"`{order}` AS at", f"({zero}) AS zero", f"{text} AS name", f"CAST(pmod(xxhash64({text}), {BUCKETS}) AS INT) AS bucket")
    out = f"`{key}` {types[key]}, `{order}` {types[order]}, run long"
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("bucket").transformWithStateInPandas(Silence(key, order, ttl_ms), out, "Append", mode)
