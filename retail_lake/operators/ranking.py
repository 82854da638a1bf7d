"""Keep-latest, global row numbers, NTILE and ranks without one-task windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.session import freeze

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def keep_latest(
    df: DataFrame,
    keys: Sequence[str],
    latest: str | None = None,
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the one with the greatest ``latest``, NULL counting as oldest.

    An aggregate instead of a row_number window, so that the copies of a frequent key are
    reduced before the shuffle and never sorted in one task. Ties go to the greatest
    ``ties`` columns, by default all the others, which leaves only equal rows tied.
    """
    rest = [c for c in df.columns if c not in keys]
    order = ([latest] if latest else []) + [c for c in (ties or rest) if c != latest]
    if set(order) == set(rest):
        best = F.max(F.struct(*order))
    else:
        best = F.max_by(F.struct(*rest), F.struct(*order))
    kept = df.groupBy(*keys).agg(best.alias("_best"))
    return kept.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str = "row_pos", total: str | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the order, which must have no ties.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted
    by the sizes of the partitions before. The sorted rows are frozen first: sizes and
    rows must come from the same partitioning. ``total`` names a column for the row count.
    """
    tagged = freeze(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    part = F.shiftright("_tag", _ROW_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per shuffle partition, so one window task and a broadcast are fine
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_size").over(Window.partitionBy()).alias(total)] if total else []),
    )
    local = F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_offset", "_tag")
    )


def exact_ntiles(df: DataFrame, k: int, key: str, plan: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Add NTILE(k) over all rows for each entry of ``plan``: name -> (measure, descending).

    Nulls come last and ``key``, which is unique, orders equal measures; the first ``n mod k`` buckets
    hold one row more. Only (measure, key) of all entries is sorted, in one pass. The first rows of the
    buckets two to k, one row of constants, then tell the bucket of any row by comparison.
    """
    held = freeze(df)
    names = list(plan)
    kinds = {name: held.schema[plan[name][0]].dataType for name in names}

    def entry(name: str) -> Column:
        measures = [
            (F.col(plan[other][0]) if other == name else F.lit(None).cast(kinds[other])).alias(f"m{i}")
            for i, other in enumerate(names)
        ]
        return F.struct(F.lit(names.index(name)).alias("which"), *measures, F.col(key).alias("key"))

    narrow = held.select(F.explode(F.array(*map(entry, names))).alias("e")).select("e.*")
    order = [F.col("which").asc()]
    for i, name in enumerate(names):
        order.append(F.col(f"m{i}").desc_nulls_last() if plan[name][1] else F.col(f"m{i}").asc_nulls_last())
    placed = global_row_number(narrow, [*order, F.col("key").asc_nulls_last()], "at", "total")
    n = F.floor(F.col("total") / F.lit(len(names)))
    size, longer = F.floor(n / F.lit(k)), n % F.lit(k)
    cuts = []
    for i in range(len(names)):
        for j in range(1, k):
            first = n * i + size * j + F.least(F.lit(j).cast("long"), longer)
            here = (F.col("which") == i) & (F.col("at") == first)
            cuts.append(F.max(F.when(here, F.struct(F.col(f"m{i}").alias("m"), "key"))).alias(f"cut{i}_{j}"))
    if not cuts:
        return held.withColumns({name: F.lit(1) for name in names})
    firsts = placed.agg(*cuts)
    scored = held.withColumn("_firsts", firsts.select(F.struct("*")).scalar())
    for i, name in enumerate(names):
        passed = [_not_before(plan[name], key, F.col("_firsts")[f"cut{i}_{j}"]) for j in range(1, k)]
        scored = scored.withColumn(name, reduce(Column.__add__, passed, F.lit(1)))
    return scored.drop("_firsts")


def _not_before(by: tuple[str, bool], key: str, cut: Column) -> Column:
    """1 if the row is at or after the cut in the order; 0 if before it, or if there is no cut."""
    measure, descending = by
    m, c = F.col(measure), cut["m"]
    beyond = m < c if descending else m > c
    after = (m.isNull() & c.isNotNull()) | F.coalesce(beyond, F.lit(False))
    tied = F.col(key).isNull() | F.coalesce(F.col(key) >= cut["key"], F.lit(False))
    return F.when(cut.isNotNull() & (after | (m.eqNullSafe(c) & tied)), 1).otherwise(0)


_RUNS = ("_part", "_no", "_tie", "_dense", "_start", "_first")


def ranks(
    df: DataFrame,
    partition: str,
    measure: str,
    key: str,
    descending: bool = True,
    dense: bool = True,
    percent: bool = True,
) -> DataFrame:
    """Add row_number, rank and, if asked for, dense_rank and percent_rank within ``partition``.

    ``key`` is unique and orders equal measures. One range sort deals the rows; each task numbers its
    own rows and the runs of equal measures among them, and hands on its first and last row with these
    numbers. What a run or group that began in an earlier task carries over is worked out from these
    summaries, one row per task, so neither a group nor a run of ties is ever in one task or joined on.
    Only percent_rank needs the size of each group, which is one more aggregate and join on the group.
    """
    by_value = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    order = [F.col(partition).asc(), by_value, F.col(key).asc()]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.LongType()) for name in _RUNS]])
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = freeze(ordered.mapInArrow(_number_runs(partition, measure), schema))

    ends = runs.groupBy("_part").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_dense").alias("runs"),
        F.min_by(F.struct(F.col(partition).alias("g"), F.col(measure).alias("m")), "_no").alias("head"),
        F.max_by(
            F.struct(F.col(partition).alias("g"), F.col(measure).alias("m"), "_tie", "_start", "_first"), "_no"
        ).alias("tail"),
    )
    tasks = Window.orderBy("_part")  # one row per shuffle partition, so one window task is fine
    before = tasks.rowsBetween(Window.unboundedPreceding, -1)
    upto = tasks.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lag("tail").over(tasks)
    same_group = F.lag("n").over(tasks).isNotNull() & last["g"].eqNullSafe(F.col("head.g"))
    known = ends.select(
        "*", same_group.alias("same_g"), (same_group & last["m"].eqNullSafe(F.col("head.m"))).alias("same_m")
    ).select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        (F.coalesce(F.sum("runs").over(before), F.lit(0)) - F.sum(F.col("same_m").cast("long")).over(upto)).alias("dense"),
    )
    own_run = F.when(~((F.col("tail._tie") == 0) & F.col("same_m")), F.col("offset") + F.col("tail._tie"))
    own_group = F.when(
        ~((F.col("tail._start") == 0) & F.col("same_g")),
        F.struct(
            (F.col("offset") + F.col("tail._start")).alias("at"), (F.col("dense") + F.col("tail._first")).alias("dense")
        ),
    )
    carried = known.select(
        F.col("_part").alias("_task"),
        "offset",
        F.col("dense").alias("runs_before"),
        F.when(F.col("same_m"), F.last(own_run, ignorenulls=True).over(before)).alias("run"),
        F.when(F.col("same_g"), F.last(own_group, ignorenulls=True).over(before)).alias("group"),
    ).alias("c")

    def of_run(local: str, start: Column, carry: Column) -> Column:
        """Where something began: in this task, or, if it holds the task's first row, where it is carried from."""
        return F.when((F.col(local) == 0) & carry.isNotNull(), carry).otherwise(start)

    out = runs.join(F.broadcast(carried), F.col("_part") == F.col("_task"))
    tie = of_run("_tie", F.col("c.offset") + F.col("_tie"), F.col("c.run"))
    start = of_run("_start", F.col("c.offset") + F.col("_start"), F.col("c.group.at"))
    first = of_run("_start", F.col("c.runs_before") + F.col("_first"), F.col("c.group.dense"))
    rank = tie - start + 1
    out = out.select(
        *[F.col(c) for c in df.columns],
        (F.col("c.offset") + F.col("_no") - start + 1).alias("row_number"),
        rank.alias("rank"),
        *([(F.col("c.runs_before") + F.col("_dense") - first + 1).alias("dense_rank")] if dense else []),
    )
    if not percent:
        return out
    sizes = runs.groupBy(F.col(partition).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.col("rank") - 1).cast("double") / (F.col("_n") - 1).cast("double")
    return (
        out.join(sizes, F.col(partition).eqNullSafe(F.col("_g")))
        .withColumn("percent_rank", F.when(F.col("_n") > 1, share).otherwise(0.0))
        .drop("_g", "_n")
    )


def _number_runs(partition: str, measure: str) -> Callable:
    """Add to sorted rows of a task: its number, the row's, that of the first row of its run of equal
    (partition, measure), the number of its run, the first row of its partition and the run there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, tie, dense, start, first = 0, 0, 0, 0, 0
        group = value = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index(partition))
            values = batch.column(batch.schema.get_field_index(measure))
            new_group = _changes(groups, group if seen else None)
            new_run = new_group | _changes(values, value if seen else None)
            no = seen + np.arange(batch.num_rows)
            runs = dense + np.cumsum(new_run)
            ties = np.maximum.accumulate(np.where(new_run, no, tie))
            starts = np.maximum.accumulate(np.where(new_group, no, start))
            firsts = np.maximum.accumulate(np.where(new_group, runs, first))
            added = [pa.array(np.full(len(no), part, dtype=np.int64)), *map(pa.array, (no, ties, runs, starts, firsts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *_RUNS])
            seen, tie, dense, start, first = seen + len(no), ties[-1], runs[-1], starts[-1], firsts[-1]
            group, value = groups.slice(len(no) - 1), values.slice(len(no) - 1)

    return run


def _changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal, and so are NaNs."""
    head = column.slice(0, 1) if before is None else before
    here = pa.concat_arrays([head, column])
    a, b = here.slice(1), here.slice(0, len(column))
    both = pc.and_(a.is_null(), b.is_null())
    if pa.types.is_floating(column.type):
        both = pc.or_(both, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    differs = pc.and_not(pc.fill_null(pc.not_equal(a, b), True), both).to_numpy(zero_copy_only=False).astype(bool)
    if before is None:
        differs[0] = True
    return differs


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sort and cut; the order must end in a unique key so that the cut is fixed."""
    return df.orderBy(*order).limit(k)
