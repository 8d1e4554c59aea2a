"""Streaming disposal gate (X1): the insert trigger as keyed streaming state.

Per instance the state holds one number, the first EventID of its Sold events. Instances are dealt
by hash into BUCKETS keys, whose state is two arrays (the instances sold, their first sales); each
micro-batch hands the processor one bucket's new rows, so that Python is called and the state read
and written once per bucket instead of once per instance. A Disposed row is admitted if its
EventID (the insertion order the trigger sees, T8) comes after its instance's first sale,
vectorised in pandas. An event without instance matches no sale. No row is admitted wrongly whatever
the order of files; a refusal is final, so a Disposed row that arrives in an earlier
micro-batch than its earlier sale stays refused. The set-based form (``batched.py``)
holds such rows back; use it where files come out of order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas

OUTPUT = T.StructType([
    T.StructField("EventID", T.LongType()),
    T.StructField("InstanceID", T.LongType()),
    T.StructField("EventType", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
])
#: Keys of the state. Fixed, for a restarted stream finds its instances again by it.
BUCKETS = 2048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DisposalGate(StatefulProcessor):
    """Keyed by a bucket of instances; state: per instance the first EventID of a stored Sold event.

    Everything the class needs is bound as class attributes, and the class is
    pickled by value (see ``disposal_gate_stream``), so Python workers run it
    without importing this package.
    """

    SOLD = schemas.SOLD.lower()
    DISPOSED = schemas.DISPOSED.lower()
    MESSAGE = schemas.MSG_UNSOLD_DISPOSAL

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sold = handle.getValueState("sold", "instances binary, firsts binary")    # int64 arrays as bytes

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        kind = batch["EventType"].str.lower()
        is_sold = (kind == self.SOLD).fillna(False).to_numpy(bool)
        is_disposed = (kind == self.DISPOSED).fillna(False).to_numpy(bool)
        event = batch["EventID"].astype("Int64")
        dated = event.notna().to_numpy(bool)
        event = event.fillna(0).to_numpy("int64")
        instance = batch["InstanceID"].astype("Int64")
        known = instance.notna().to_numpy(bool)
        instance = instance.fillna(0).to_numpy("int64")
        current = self.sold.get()            # one state-store call; None when absent
        sold, sales = (np.frombuffer(x, "<i8") for x in (current or (b"", b"")))
        new = is_sold & dated & known
        firsts = pd.Series(np.concatenate([sales, event[new]]), np.concatenate([sold, instance[new]])).groupby(level=0).min()
        instances, firsts = firsts.index.to_numpy("<i8"), firsts.to_numpy("<i8")
        at = np.searchsorted(instances, instance)
        found = np.zeros(len(batch), bool)
        first = np.zeros(len(batch), "int64")
        inside = known & (at < len(firsts))
        found[inside] = instances[at[inside]] == instance[inside]
        first[found] = firsts[at[found]]
        ok = ~is_disposed | (found & dated & (event > first))
        reason = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        reason[~ok] = self.MESSAGE
        if not (np.array_equal(instances, sold) and np.array_equal(firsts, sales)):
            self.sold.update((instances.tobytes(), firsts.tobytes()))      # written only when it changes
        yield pd.DataFrame({
            "EventID": batch["EventID"].astype("Int64"),
            "InstanceID": batch["InstanceID"].astype("Int64"),
            "EventType": batch["EventType"],
            "status": np.where(ok, "accepted", "rejected"),
            "reason": reason,
        })

    def close(self) -> None:
        pass


def disposal_gate_stream(events: DataFrame) -> DataFrame:
    """Streaming form of G1 over lifecycle events (EventID, EventType, EventDate, InstanceID)."""
    import sys

    from pyspark import cloudpickle

    # ship the processor's code with it: workers need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # rows without instance are apart: in pandas a null beside them would turn ids into floats
    bucket = F.when(F.col("InstanceID").isNull(), -1).otherwise(F.pmod(F.xxhash64("InstanceID"), F.lit(BUCKETS)).cast("int"))
    return events.select("EventID", "InstanceID", "EventType", bucket.alias("bucket")).groupBy("bucket") \
        .transformWithStateInPandas(statefulProcessor=DisposalGate(), outputStructType=OUTPUT,
                                    outputMode="Append", timeMode="None")
