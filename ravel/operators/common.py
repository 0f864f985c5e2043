"""Shared building blocks: time-window filter, optional filters, exact top-N
per group with hot-key splitting, exact global positions without a
single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: what is
    costly and read several times is computed once, lineage is cut, and lost
    executors take nothing with them. The shuffle files of the writing are
    removed when it ends, not when the driver's garbage is collected; should
    any be read again, its stage runs again."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def as_of_lit(df: DataFrame, col: str, as_of: str) -> Column:
    """``as_of`` typed like ``df[col]`` (timestamp or timestamp_ntz)."""
    return F.lit(as_of).cast(df.schema[col].dataType)


def trailing_window(df: DataFrame, col: str, as_of: str, days: int) -> DataFrame:
    """``as_of - days < col <= as_of``, the reference's ``NOW() - n days``
    with a fixed ``as_of`` (D14), later than which nothing has happened yet.
    Pushed to the Parquet scan."""
    hi = as_of_lit(df, col, as_of)
    return df.where(F.col(col) > hi - F.make_dt_interval(days=F.lit(int(days)))).where(F.col(col) <= hi)


def optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.where(F.col(col) == F.lit(value))


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add expensive columns (regex flags, parsed JSON) evaluated once per row.

    Catalyst pushes a filter on a derived column below the projection that
    defines it by inlining the expression, which evaluates it twice (in the
    filter and again in the projection). Producing the columns from a
    one-row ``inline`` generator keeps such filters above them."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(packed))


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
                    rank_col: str = "rn") -> DataFrame:
    """Exact top-``n`` rows per group, ordered by ``order_cols`` (a total order).

    Spark cuts ``row_number() <= n`` before the shuffle as well (a partial
    window group limit), so each task sends at most ``n`` rows of a hot group
    and no salt is needed."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def global_position(df: DataFrame, key: Column, tie: list[Column], prefix_len: int = 3,
                    pos_col: str = "pos", total_col: str | None = None) -> DataFrame:
    """1-based position of every row in the total order (key, *tie).

    ``key`` must be a hex string (e.g. an md5): rows are counted per key
    prefix (16**prefix_len groups, a small table whose running sums give each
    group's offset), then numbered inside their group only — no window over
    the whole input in one task. ``total_col`` adds the row count, taken
    from the same small table (no extra pass over the input). The input is
    read twice, so it is stored first: whatever made it is computed once."""
    df = stored(df.withColumn("_k", key), "positions").withColumn("_g", F.substring("_k", 1, prefix_len))
    counts = df.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_total"))
    # at most 16**prefix_len rows: a proven broadcast bound
    df = df.join(F.broadcast(offsets), "_g")
    w = Window.partitionBy("_g").orderBy(F.col("_k"), *tie)
    out = df.withColumn(pos_col, F.col("_off") + F.row_number().over(w))
    if total_col:
        out = out.withColumnRenamed("_total", total_col)
    return out.drop("_k", "_g", "_off", "_total")
