"""Defaults of stored columns: times of change, and ids that rise with time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.plans.checkpoints import checkpoint

#: Fixed: bits of a snowflake id after its milliseconds.
CENTRE_BITS, WORKER_BITS, SEQUENCE_BITS = 5, 5, 12
PER_MS = 1 << SEQUENCE_BITS
#: Milliseconds of the first id's time, 2010-11-04T01:42:54.657Z.
EPOCH_MS = 1288834974657


def updated_at(given: Column, now: Column) -> Column:
    """The given time of change, else now."""
    return F.coalesce(given, now)


def created_at(given: Column, is_insert: Column, now: Column) -> Column:
    """The given time of creation; for a row that is inserted without one, now."""
    return F.when(is_insert, F.coalesce(given, now)).otherwise(given)


def snowflake(ms: Column, sequence: Column, centre: int = 1, worker: int = 1, epoch_ms: int = EPOCH_MS) -> Column:
    """An id of a millisecond and a number within it, which must be under 4096."""
    fits = F.when((sequence < 0) | (sequence >= PER_MS), F.raise_error(F.lit("more ids than a millisecond has")).cast("long")).otherwise(sequence.cast("long"))
    head = F.shiftleft((ms - epoch_ms).cast("long"), CENTRE_BITS + WORKER_BITS + SEQUENCE_BITS)
    return head.bitwiseOR(F.lit((centre << WORKER_BITS | worker) << SEQUENCE_BITS).cast("long")).bitwiseOR(fits)


def numbered(rows: DataFrame, ms: str, by: list[str], out: str = "number") -> DataFrame:
    """rows with a snowflake id each, for the time in column `ms` (milliseconds, not null): ids rise with (ms, by) and are never equal.

    A millisecond has `PER_MS` numbers; what comes after them goes on in the next one. So the slot of a row is one more than the
    one before, or its own time's first slot if that is later: a running maximum, which is carried from partition to
    partition of a global sort by one number each. Rows whose keys are equal are numbered in any order.
    """
    placed = rows.orderBy(ms, *by)
    kept = [c for c in rows.columns if c != out]
    fields = T.StructType([*(rows.schema[c] for c in kept), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_run", T.LongType())])

    def run(it):
        part, at, top = TaskContext.get().partitionId(), 0, -(1 << 62)
        for b in it:
            if not b.num_rows:
                continue
            here = at + np.arange(b.num_rows)
            first = b.column(ms).cast(pa.int64()).to_numpy() * PER_MS - here
            best = np.maximum(np.maximum.accumulate(first), top)
            at, top = at + b.num_rows, int(best[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(here), pa.array(best)], fields.names)

    known = checkpoint(placed.mapInArrow(run, fields))
    parts = sorted(known.groupBy("_part").agg(F.count("*"), F.max("_run")).collect())
    carried, carry = [], -(1 << 62)
    for part, n, top in parts:
        carried.append((part, carry))
        carry = max(carry, top) + n
    # One row for each partition.
    both = known.join(F.broadcast(rows.sparkSession.createDataFrame(carried, "_part int, _carry long")), "_part")
    slot = F.col("_at") + F.greatest("_carry", "_run")
    return both.withColumn("_slot", slot).select(*kept, snowflake(F.expr(f"_slot div {PER_MS}"), F.pmod("_slot", F.lit(PER_MS))).alias(out))
