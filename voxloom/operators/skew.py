"""Per-key results when a few keys hold most rows.

Rows are range partitioned by (key, secondary order): Spark samples quantiles of
the composite, so a heavy key is cut over as many partitions as its share asks for
and no task gets a whole hot key. Each partition reduces its sorted run to one
partial state for each key that it touches, with the secondary values at its two
ends; a last small aggregation stitches these states, subtracting what two
neighbours counted both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways in which the rows of one (key, secondary) pair may be cut further.
SALTS = 16


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(change)) - 1


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null equals null."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.empty(0, bool)


def _joined(held: pa.RecordBatch | None, states: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The states that are complete, and the last one, which may go on; ``held`` comes before and may go on in the first."""
    if held is not None:
        a, b = held.to_pylist()[0], states.slice(0, 1).to_pylist()[0]
        if all(x == y for x, y in list(zip(a.values(), b.values(), strict=True))[:width]):
            times = [t for t in (a["lo"], b["lo"], a["hi"], b["hi"]) if t is not None]
            again = a["who_last"] is not None and a["who_last"] == b["who_first"]
            both = a | {k: a[k] + b[k] for k in ("n", "c")} | {"s": None if a["s"] is None and b["s"] is None else (a["s"] or 0) + (b["s"] or 0)}
            both |= {"lo": min(times, default=None), "hi": max(times, default=None), "d": a["d"] + b["d"] - again, "who_last": b["who_last"]}
            head = pa.RecordBatch.from_pylist([both], schema=states.schema)
            states = pa.Table.from_batches([head, states.slice(1)]).combine_chunks().to_batches()[0]
        else:
            states = pa.Table.from_batches([held, states]).combine_chunks().to_batches()[0]
    return states.slice(0, states.num_rows - 1), states.slice(states.num_rows - 1)


def skewed_key_profile(
    rows: DataFrame,
    keys: list[str],
    *,
    distinct_col: str,
    time_col: str,
    mean_col: str,
    partitions: int | None = None,
) -> DataFrame:
    """``keys`` with ``mentions``, ``n_distinct``, ``first_at``, ``last_at``, ``mean_value``.

    Null keys form a group of their own; null ``distinct_col`` values are not
    counted, null times and values are left out of their results, a key without
    any has null there. Times compare as instants (strings with offsets), and come
    out as UTC timestamps. The mean is exact to 9 decimals. An empty input gives no rows;
    other columns are not read.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = rows.select(
        *keys,
        F.col(distinct_col).cast("string").alias("__who"),
        F.col(time_col).try_cast("timestamp").alias("__at"),
        (F.col(mean_col).cast("double") * 1e9).try_cast("decimal(28,0)").alias("__v"),
    )
    # The salt is part of the order, not of the key: equal pairs stay neighbours yet can be cut.
    salted = needed.withColumn("__salt", F.pmod(F.xxhash64("__at", "__v"), F.lit(SALTS)))
    order = [*keys, "__who", "__salt"]
    # RangePartitioning on these columns satisfies the grouping below: no second exchange of rows.
    reduced = (
        salted.repartitionByRange(n, *order)
        .groupBy(*order)
        .agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("lo"), F.max("__at").alias("hi"), F.sum("__v").alias("s"), F.count("__v").alias("c"))
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .drop("__salt")
    )
    width = len(keys)
    kinds = [f.dataType.simpleString() for f in reduced.schema.fields[:width]]

    names = [*keys, "part", "n", "c", "lo", "hi", "s", "d", "who_first", "who_last"]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state for each key of a partition; the run that is open at the end of a batch is carried into the next."""
        held: pa.RecordBatch | None = None
        for b in batches:
            if b.num_rows:
                done, held = _joined(held, reduced_batch(b), width)
                if done.num_rows:
                    yield done
        if held is not None:
            yield held

    def reduced_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        """One state for each run of a key in a batch."""
        change = np.logical_or.reduce([_differs(b.column(i)) for i in range(width)])
        starts, ends = _runs(change)
        who = b.column(width)
        known = pc.is_valid(who).to_numpy(zero_copy_only=False)
        first = ((change | _differs(who)) & known).astype(np.int64)
        col = lambda name: b.column(b.schema.get_field_index(name))
        ints = lambda name: np.add.reduceat(col(name).to_numpy(), starts)
        run = np.repeat(np.arange(len(starts)), ends - starts + 1)
        grouped = pa.table({"run": run, "lo": col("lo"), "hi": col("hi"), "s": col("s")}).group_by("run", use_threads=False)
        grouped = grouped.aggregate([("lo", "min"), ("hi", "max"), ("s", "sum")]).sort_by("run")
        at, last = pa.array(starts), pa.array(ends)
        return pa.RecordBatch.from_arrays(
            [
                *(b.column(i).take(at) for i in range(width)),
                col("part").take(at),
                pa.array(ints("n")),
                pa.array(ints("c")),
                grouped["lo_min"].combine_chunks(),
                grouped["hi_max"].combine_chunks(),
                grouped["s_sum"].combine_chunks().cast(pa.decimal128(38, 0)),
                pa.array(np.add.reduceat(first, starts)),
                who.take(at),
                who.take(last),
            ],
            names,
        )

    head = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True))
    partial = reduced.mapInArrow(states, f"{head}, part int, n long, c long, lo timestamp, hi timestamp, s decimal(38,0), d long, who_first string, who_last string")
    # Stitching: of neighbours in order, the second counted the first's last value once more.
    run = F.struct("part", "d", "who_first", "who_last")
    gathered = partial.groupBy(*keys).agg(
        F.sum("n").alias("mentions"),
        F.sum("c").alias("c"),
        F.sum("s").alias("s"),
        F.min("lo").alias("first_at"),
        F.max("hi").alias("last_at"),
        F.array_sort(F.collect_list(run)).alias("runs"),
    )
    stitched = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("last")),
        lambda a, r: F.struct((a["d"] + r["d"] - F.when(a["last"] == r["who_first"], 1).otherwise(0)).alias("d"), r["who_last"].alias("last")),
        lambda a: a["d"],
    )
    mean = F.col("s").cast("double") / F.lit(1e9) / F.col("c")
    return gathered.select(*keys, "mentions", stitched.alias("n_distinct"), "first_at", "last_at", F.when(F.col("c") > 0, mean).alias("mean_value"))


def heavy_keys(profile: DataFrame, total: int, *, share: float = 0.01) -> DataFrame:
    """Of a profile, the keys with more than ``share`` of ``total`` rows."""
    return profile.filter(F.col("mentions") > F.lit(total) * F.lit(share))
