"""Helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_n(df: DataFrame, keys: Keys, n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """First `n` rows per key under a total order.

    Written as `row_number() <= n`, for which Spark trims every key to n rows
    on the map side before the shuffle, so a hot key costs n rows per input
    partition and not all of its rows.
    """
    position = rank or "_position"
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*names(keys)).orderBy(*order)))
    kept = ranked.filter(F.col(position) <= n)
    return kept if rank else kept.drop(position)


def pick_first(df: DataFrame, keys: Keys, *order: Column) -> DataFrame:
    """One row per key: the first under the order (`DISTINCT ON`)."""
    return top_n(df, keys, 1, *order)


#: Rows that a task gets of a table dealt out by its number of rows.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out by `keys`, to about one task for every `TASK_ROWS` of its
    `rows`, so that what a task sorts or hashes doesn't grow with the table.
    AQE joins shuffle partitions to no more than there are cores."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


#: Rows that a task gets where each of them costs fractions of a millisecond.
COSTLY_ROWS = 5_000


def spread(df: DataFrame, rows: int, each: int = COSTLY_ROWS) -> DataFrame:
    """`df` dealt out evenly, `each` of its `rows` to a task, for what is costly
    a row. A scan has no more tasks than the files have row groups, and these
    hold up to a million narrow rows."""
    tasks = -(-rows // each)
    return df.repartition(tasks) if tasks > 1 else df


def moment(df: DataFrame, column: str, value) -> Column:
    """`value` as a literal of the column's own time type, so that the
    comparison stays on the raw column and reaches the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def fresh(df: DataFrame, as_of, days: int, column: str = "collected_at") -> DataFrame:
    """Rows seen less than `days` days before `as_of`."""
    limit = moment(df, column, as_of) - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(column) > limit)


def in_period(df: DataFrame, as_of, days: int, back: int = 0, column: str = "created_at") -> Column:
    """Whole-day window of `days` days that ends with the day of `as_of`;
    `back=1` is the window of the same length before it."""
    today = F.date_trunc("day", moment(df, column, as_of)).cast(df.schema[column].dataType)
    start = today - F.make_dt_interval(F.lit(days * (back + 1) - 1))
    stop = today - F.make_dt_interval(F.lit(days * back - 1))
    return (F.col(column) >= start) & (F.col(column) < stop)


def blank_to_null(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(column), F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses
    it. Plain nesting would copy the expression to every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(values: dict) -> Column:
    """A small constant dict as a map literal (folded at plan time)."""
    flat: list[Column] = []
    for key, value in values.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def positions(df: DataFrame, key: str, column: str = "position", slices: int | None = None, rows: int = 100_000) -> DataFrame:
    """Zero-based position of every row in the order of a unique numeric key.

    A global `row_number()` would pull all rows into one task. Here the key
    range is cut at approximate quantiles into `slices`, else as many as give
    about `rows` rows each;
    rows are numbered inside their slice and shifted by the number of rows in
    the slices before it. The cut points are fixed numbers before any row is
    dealt, so every branch and every rerun deals alike.
    """
    slices = slices or max(1, min(4096, -(-df.count() // rows)))
    share = [i / slices for i in range(1, slices)]
    cuts = (df.agg(F.percentile_approx(F.col(key), share, slices * 4)).first()[0] or []) if share else []
    fixed = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    sliced = df.withColumn("_slice", F.size(F.filter(fixed, lambda c: c < F.col(key))))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.groupBy("_slice").count().select(  # at most `slices` rows
        "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(key))
    return (
        sliced.withColumn("_inside", inside)
        .join(F.broadcast(shift), "_slice")
        .withColumn(column, F.col("_shift") + F.col("_inside") - 1)
        .drop("_slice", "_shift", "_inside")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that must outlive an executor: the one the cluster
    names in `spark.checkpoint.dir`. A session on one machine without one (a
    test) gets a temporary folder; a cluster without one is refused, as its
    executors could not read each other's files."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back, so that
    later steps start from data and not from its plan, also after an executor
    is lost, and read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
