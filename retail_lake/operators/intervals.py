"""Joins and sums between dated facts and dimensions valid over an interval of days.

``interval_join`` and ``interval_joins`` give the joined rows. The other functions answer aggregate questions
without making them: facts are reduced to one row per day first, and intervals to the days
on which they start and end, so both sides are bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.session import freeze


def _usable(dim: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that can match at all: known keys and bounds, not reversed."""
    known = F.col(start) <= F.col(end)
    for key in by:
        known &= F.col(key).isNotNull()
    return dim.filter(known)


def _held_days(fact: DataFrame, day: str) -> Column:
    """The first and last day of the facts, so that open-ended periods make no rows beyond them."""
    return fact.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()


def _clipped(dim: DataFrame, held: Column, start: str, end: str) -> DataFrame:
    """Intervals with their part of the held days, ``_from`` and ``_to``; others are left out."""
    return dim.withColumns(
        {"_from": F.greatest(F.col(start), held["first"]), "_to": F.least(F.col(end), held["last"])}
    ).filter(held["first"].isNotNull() & (F.col("_from") <= F.col("_to")))


def _days_of(clipped: DataFrame) -> DataFrame:
    """A row per interval and covered day, ``_day``."""
    return clipped.withColumn("_day", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


#: Blocks of days: a block of a level is eight of the level below, one of level 0 a day.
_BITS = 3
#: Levels that any calendar of the date type needs: 8 to the 8th days are more than 9,999 years.
_LEVELS = 8


def _top_level(held: Column) -> Column:
    """The highest level with a block that can lie inside the held days."""
    length = F.coalesce(F.datediff(held["last"], held["first"]), F.lit(0)) + 1
    return sum(((length >= 1 << _BITS * level).cast("int") for level in range(2, _LEVELS)), (length >= 1 << _BITS).cast("int"))


def _blocks_of(first: Column, last: Column) -> Column:
    """The numbers of the fewest aligned blocks that together are the days from ``first`` to ``last``.

    At each level those that no block of the next covers: at most seven on either side.
    """

    def inside(level: int) -> tuple[Column, Column]:
        size = 1 << _BITS * level
        return F.shiftright(first + (size - 1), _BITS * level), F.shiftright(last + 1, _BITS * level)

    def run(level: int, low: Column, high: Column) -> Column:
        base = F.lit(level << 32)
        return F.when(low < high, F.sequence(base + low, base + high - 1)).otherwise(F.array().cast("array<long>"))

    found = []
    for level in range(_LEVELS):
        low, high = inside(level)
        above, beyond = inside(level + 1)
        above, beyond = above * (1 << _BITS), beyond * (1 << _BITS)
        covered = above < beyond
        found.append(run(level, low, F.when(covered, above).otherwise(high)))
        found.append(run(level, F.when(covered, beyond).otherwise(high), high))
    return F.concat(*found)


def _blocks_over(place: Column, top: Column) -> Column:
    """The numbers of the blocks of all levels up to ``top`` that hold a day."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.lit(level) <= top, F.lit(level << 32) + F.shiftright(place, _BITS * level))
                for level in range(_LEVELS)
            ]
        )
    )


def _join_by_blocks(
    fact: DataFrame, usable: DataFrame, by: Sequence[str], point: str, start: str, end: str, how: str
) -> DataFrame:
    """The block form of ``interval_join``; ``usable`` has its keys under ``_by_`` names."""
    held = _held_days(fact, point)
    first = F.datediff(F.greatest(F.col(start), held["first"]), held["first"])
    last = F.datediff(F.least(F.col(end), held["last"]), held["first"])
    blocks = (
        usable.filter(held["first"].isNotNull() & (first <= last))
        .withColumn("_own", F.explode(_blocks_of(first, last)))
    )
    place = F.datediff(F.col(point), held["first"])
    spread = fact.withColumn("_block", F.explode(_blocks_over(place, _top_level(held))))
    match = F.col("_block") == F.col("_own")
    for key in by:
        match &= F.col(key) == F.col(f"_by_{key}")
    gone = ["_block", "_own", *[f"_by_{key}" for key in by]]
    met = spread.join(blocks, match).drop(*gone)
    if how == "inner":
        return met
    covered = active_days(
        usable.withColumns({"_from": F.greatest(F.col(start), held["first"]), "_to": F.least(F.col(end), held["last"])}),
        [f"_by_{key}" for key in by], "_from", "_to",
    )
    on_day = F.col(point) == F.col("day")
    for key in by:
        on_day &= F.col(key) == F.col(f"_by_{key}")
    alone = fact.join(covered, on_day, "left_anti")
    return alone if how == "left_anti" else met.unionByName(alone, allowMissingColumns=True)


def interval_join(
    fact: DataFrame,
    dim: DataFrame,
    by: Sequence[str],
    point: str,
    start: str,
    end: str,
    how: str = "left",
    strategy: str = "days",
    salts: int = 1,
    salt_on: str | None = None,
) -> DataFrame:
    """Join every fact to the intervals of its group that contain its day.

    The columns of ``dim`` must not repeat those of ``fact``, save the ``by`` keys.
    ``days`` gives an interval one row per covered day on which there can be facts and joins on (keys, day): every pair
    that meets is a result, and the facts of a large group are spread over its days. Spark
    broadcasts the days if they are small and splits partitions that are too large. With
    ``salts`` > 1 the facts of one day are spread further by a hash of ``salt_on``. ``range``
    joins on the keys and tests the bounds of each pair; it is for few and very long intervals.
    ``blocks`` gives an interval one row per aligned block of 1, 8, 64, ... days that it is made of, at
    most 14 a level, and a fact one row per level: for many long intervals, where ``days`` makes a row
    per day. A pair still meets once. Facts that meet none are told by the days that any interval covers.
    """
    usable = _usable(dim, by, start, end)
    renamed = usable.select(
        *[F.col(k).alias(f"_by_{k}") for k in by], *[c for c in dim.columns if c not in by]
    )
    match = F.lit(True)
    for key in by:
        match &= F.col(key) == F.col(f"_by_{key}")
    if strategy == "range":
        match &= F.col(point).between(F.col(start), F.col(end))
        return fact.join(renamed, match, how).drop(*[f"_by_{k}" for k in by])
    if strategy == "blocks":
        return _join_by_blocks(fact, renamed, by, point, start, end, how)
    days = _days_of(_clipped(renamed, _held_days(fact, point), start, end))
    match &= F.col(point) == F.col("_day")
    if salts > 1:
        fact = fact.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
        days = days.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match &= F.col("_salt") == F.col("_copy")
    return fact.join(days, match, how).drop("_day", "_salt", "_copy", *[f"_by_{k}" for k in by])


#: Tasks per core of ``interval_joins``, so that cores end at about the same time.
_TASKS = 8


def interval_joins(
    fact: DataFrame,
    dims: Sequence[tuple[DataFrame, str, str]],
    by: Sequence[str],
    point: str,
    salt_on: str,
) -> DataFrame:
    """Left joins as by ``interval_join`` with several dimensions, each given with its start and end.

    A fact has a row per choice of one interval of each dimension, so the facts' bytes, by which Spark sizes tasks,
    say little of the work. The rows of a group and day follow from counts, without making them: facts are dealt
    once for all joins, to more tasks than cores, and what a group and day has beyond a small share of all rows goes
    to further tasks, with copies of its intervals. Facts without a key or day meet nothing and go anywhere.
    """
    spark = fact.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS * spark.sparkContext.defaultParallelism)
    keys = [f"_by_{key}" for key in by]
    named = [F.col(key).alias(name) for key, name in zip(by, keys, strict=True)]
    known = F.col(point).isNotNull()
    for key in by:
        known &= F.col(key).isNotNull()
    counted = fact.filter(known).groupBy(*named, F.col(point).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    counted = freeze(counted)  # at most a row per group and day
    held = _held_days(counted, "_day")
    usable = [
        (_usable(dim, by, start, end).select(*named, *[c for c in dim.columns if c not in by]), start, end)
        for dim, start, end in dims
    ]
    weighed = counted.withColumn("_rows", F.col("_rows").cast("double"))
    for dim, start, end in usable:
        opened = active_days(_clipped(dim.select(*keys, start, end), held, start, end), keys, "_from", "_to")
        weighed = weighed.join(opened.withColumnRenamed("day", "_day"), [*keys, "_day"], "left").select(
            *keys, "_day", (F.col("_rows") * F.coalesce("active", F.lit(1))).alias("_rows")
        )
    weighed = freeze(weighed)
    share = weighed.agg(F.sum("_rows") / (4 * tasks)).scalar()
    large = weighed.select(
        *[F.col(key).alias(f"_of{key}") for key in keys], F.col("_day").alias("_of_day"),
        F.ceil(F.col("_rows") / share).cast("int").alias("_parts"),
    ).filter("_parts > 1")  # fewer than four per task

    def parts(rows: DataFrame, names: Sequence[str], day: str) -> DataFrame:
        same = F.col(day) == F.col("_of_day")
        for name, key in zip(names, keys, strict=True):
            same &= F.col(name) == F.col(f"_of{key}")
        return rows.join(F.broadcast(large), same, "left").drop("_of_day", *[f"_of{key}" for key in keys])

    spread = F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(tasks)
    out = parts(fact, by, point).withColumn("_salt", F.pmod(F.xxhash64(salt_on), spread).cast("int")).drop("_parts")
    out = out.repartition(tasks, *by, point, "_salt")
    for dim, start, end in usable:
        days = parts(_days_of(_clipped(dim, held, start, end)), keys, "_day")
        days = days.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        match = (F.col(point) == F.col("_day")) & (F.col("_salt") == F.col("_copy"))
        for key, name in zip(by, keys, strict=True):
            match &= F.col(key) == F.col(name)
        out = out.join(days, match, "left").drop("_day", "_copy", "_parts", *keys)
    return out.drop("_salt")


def daily_totals(
    fact: DataFrame,
    by: Sequence[str] = ("region",),
    day: str = "transaction_date",
    value: str = "amount",
) -> DataFrame:
    """Per group and day: rows, non-NULL values and their sum."""
    return fact.groupBy(*by, F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.sum(value).alias("total")
    )


def active_days(
    dim: DataFrame,
    by: Sequence[str] = ("region",),
    start: str = "start_date",
    end: str = "end_date",
    measures: Mapping[str, Column] | None = None,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Days on which a group has at least one open interval, with how many are open.

    Each interval adds its measures on its first day and takes them back the day after its
    last; a running sum over the days of change gives what is open in between. Columns:
    ``groups``, ``by``, ``day``, ``active`` and one per measure. The ``by`` keys are those
    facts are matched on, so intervals without one are left out; ``groups`` only split the
    result and may be NULL.
    """
    measures = {"active": F.lit(1).cast("long"), **(measures or {})}
    names = list(measures)
    matched, by = by, [*groups, *by]
    usable = _usable(dim, matched, start, end).select(
        *by, F.col(start).alias("_s"), F.col(end).alias("_e"), *[m.alias(n) for n, m in measures.items()]
    )
    opened = F.struct(F.col("_s").alias("day"), *[F.col(n) for n in names])
    closed = F.struct(F.date_add("_e", 1).alias("day"), *[(-F.col(n)).alias(n) for n in names])
    changes = (
        usable.select(*by, F.explode(F.array(opened, closed)).alias("_c"))
        .groupBy(*by, F.col("_c.day").alias("_from"))
        .agg(*[F.sum(f"_c.{n}").alias(n) for n in names])
    )
    so_far = Window.partitionBy(*by).orderBy("_from")
    running = so_far.rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.select(
            *by,
            "_from",
            F.date_sub(F.lead("_from").over(so_far), 1).alias("_to"),
            *[F.sum(n).over(running).alias(n) for n in names],
        )
        .filter(F.col("active") > 0)
        .withColumn("day", F.explode(F.sequence("_from", "_to")))
        .select(*by, "day", *names)
    )


def interval_sums(
    dim: DataFrame,
    daily: DataFrame,
    by: str,
    start: str,
    end: str,
    measures: Mapping[str, str],
) -> DataFrame:
    """Add to every interval the sum of each daily measure over its days.

    ``measures`` maps daily columns to new names. A prefix sum per group, kept as one array
    over its calendar days, makes each sum a difference of two entries, whatever the length
    of the interval. Intervals without any day in the data get zeros. The prefixes hold one
    entry per group and calendar day. Pass frozen daily totals: by their true size Spark can
    broadcast the prefixes instead of shuffling the intervals by group.
    """
    names = list(measures)
    per_group = Window.partitionBy(by).orderBy("day")
    known = daily.filter(F.col(by).isNotNull() & F.col("day").isNotNull())
    cumulated = known.select(
        by,
        "day",
        F.date_sub(F.lead("day").over(per_group), 1).alias("_to"),
        *[
            F.sum(F.coalesce(F.col(n), F.lit(0)))
            .over(per_group.rowsBetween(Window.unboundedPreceding, 0))
            .alias(n)
            for n in names
        ],
    )
    # days without facts repeat the sum reached before them
    dense = cumulated.withColumn(
        "_day", F.explode(F.sequence("day", F.coalesce("_to", "day")))
    )
    entry = F.struct(F.col("_day"), *names)
    prefix = (
        dense.groupBy(F.col(by).alias("_group"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_sums"), F.min("_day").alias("_first"))
    )
    low = F.greatest(F.datediff(F.col(start), F.col("_first")), F.lit(0))
    high = F.least(F.datediff(F.col(end), F.col("_first")), F.size("_sums") - 1)
    joined = (
        dim.join(prefix, F.col(by) == F.col("_group"), "left")
        .withColumn("_low", low)
        .withColumn("_high", high)
    )
    hit = (F.col(start) <= F.col(end)) & (F.col("_low") <= F.col("_high"))

    # element_at counts from 1: entry _high + 1 minus the entry before _low
    def span(name: str) -> Column:
        upto_high = F.element_at("_sums", F.when(hit, F.col("_high") + 1))[name]
        before_low = F.element_at("_sums", F.when(hit & (F.col("_low") > 0), F.col("_low")))[name]
        return F.coalesce(upto_high - F.coalesce(before_low, F.lit(0)), F.lit(0))

    return joined.select(*dim.columns, *[span(n).alias(new) for n, new in measures.items()])


def distinct_in_intervals(
    purchases: DataFrame,
    dim: DataFrame,
    by: str,
    day: str,
    who: str,
    start: str,
    end: str,
    name: str,
) -> DataFrame:
    """Add to every interval the number of distinct ``who`` with a fact in its days.

    Someone counts once per interval, on the first day inside it: the day whose previous day of theirs
    lies before the start. So this counts the pairs (day, previous day) with the day in the interval
    and the previous day before it. Facts are reduced to such counts per group, added up per block of
    days (of 1, 8, 64, ... days) and previous day. An interval is a few blocks, and in each it reads the
    running sum over the previous days up to its start. Rows are at most levels x days x days of the
    calendar for the facts and a few dozen per distinct interval; intervals and facts are not joined.
    """
    known = F.col(by).isNotNull() & F.col(day).isNotNull() & F.col(who).isNotNull()
    held = _held_days(purchases, day)
    visits = purchases.filter(known).select(F.col(by).alias("_g"), F.col(who).alias("_who"), F.col(day).alias("_d")).distinct()
    own = Window.partitionBy("_g", "_who").orderBy("_d")  # of one person: bounded by the calendar
    cells = (
        visits.withColumn("_prev", F.lag("_d").over(own))
        .groupBy("_g", "_d", "_prev")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    place = F.datediff("_d", held["first"])
    sums = (
        cells.select(
            "_g",
            F.explode(_blocks_over(place, _top_level(held))).alias("_block"),
            F.coalesce(F.datediff("_prev", held["first"]), F.lit(-1)).alias("_at"),
            "_n",
        )
        .groupBy("_g", "_block", "_at")
        .agg(F.sum("_n").alias("_n"))
    )
    dim = dim.withColumns(
        {
            "_first_held": F.when(F.col(start).isNotNull(), F.greatest(F.col(start), held["first"])),
            "_end_held": F.when(F.col(end).isNotNull(), F.least(F.col(end), held["last"])),
        }
    )
    names = [c for c in dim.columns if c not in ("_first_held", "_end_held")]
    spans = (
        _usable(dim, [by], "_first_held", "_end_held")
        .filter(held["first"].isNotNull())
        .select(F.col(by).alias("_g"), F.col("_first_held").alias("_from"), F.col("_end_held").alias("_to"))
        .distinct()
    )
    asked = spans.withColumn(
        "_block", F.explode(_blocks_of(F.datediff("_from", held["first"]), F.datediff("_to", held["first"])))
    )
    # a question stands before the counts of its own day, since only earlier previous days are meant
    lines = asked.select(
        "_g", "_block", F.datediff("_from", held["first"]).alias("_at"), F.lit(0).cast("long").alias("_n"), "_from", "_to"
    ).unionByName(sums, allowMissingColumns=True)
    upto = (
        Window.partitionBy("_g", "_block")  # at most a line per day, and the questions
        .orderBy("_at", F.col("_from").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    counts = (
        lines.withColumn("_sum", F.sum("_n").over(upto))
        .filter(F.col("_from").isNotNull())
        .groupBy(F.col("_g").alias("_sg"), F.col("_from").alias("_sf"), F.col("_to").alias("_st"))
        .agg(F.sum("_sum").alias(name))
    )
    same = (F.col(by) == F.col("_sg")) & (F.col("_first_held") == F.col("_sf")) & (F.col("_end_held") == F.col("_st"))
    return dim.join(counts, same, "left").select(*names, F.coalesce(F.col(name), F.lit(0)).alias(name))
