"""Global order, running sums and quantiles without a task that holds a whole group.

Rows are range-partitioned by key and order and written once, with their number within the
partition; what lies before a partition follows from one small row for each key and partition.  A hot key fills many
partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _sorted(df: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(k) for k in keys], *order]
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return materialize(rows).withColumn("_part", F.shiftright("_at", 33))


def _with_parts(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add what lies before a row's part of its key: ``_n``, ``_first`` (number of the part's first row), ``total`` and sums."""
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_own"), F.min("_at").alias("_first"), *[F.sum(c).alias(f"_own_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_n"), F.sum("_own").over(Window.partitionBy(*keys)).alias("total"),
        *[F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    on = reduce(Column.__and__, [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]])
    return rows.join(parts, on).drop("_p", *[f"_key{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Add ``place`` from 0 in the given order, within each key, and ``total``, the key's rows."""
    keys = keys or []
    out = _with_parts(_sorted(df, order, keys), keys, {})
    return out.withColumn("place", F.col("_n") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_n", "_first")


def running(df: DataFrame, sums: dict[str, Column], order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Add running sums, each row's own value included."""
    keys = keys or []
    out = _with_parts(_sorted(df, order, keys), keys, sums)
    w = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(w) for n, c in sums.items()})
    return out.drop("_at", "_part", "_n", "_first", "total", *[f"_before_{n}" for n in sums])


#: A value that fills many places is found by cells of places, of which a key has so many.
CELLS = 4_096


def quantiles(df: DataFrame, x: str, levels: list[float], keys: list[str] | None = None, to: str = "quantiles") -> DataFrame:
    """Exact quantiles of each key's values that aren't null, linear between neighbours, as an array by level.

    Equal values are counted before anything is ordered, so a value that fills half of the rows is one row.
    """
    keys = keys or []
    same = lambda other: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)], F.lit(True))
    counts = df.select(*keys, F.col(x).cast("double").alias("_x")).filter("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_own"))
    placed = running(counts, {"_upto": F.col("_own")}, [F.col("_x")], keys)
    totals = placed.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.sum("_own").alias("_total"))
    width = F.greatest(F.ceil(F.col("_total") / CELLS), F.lit(1))
    cell = lambda place: F.floor(place / F.col("_width")).cast("long")
    wide = totals.withColumn("_width", width)
    rows = placed.join(F.broadcast(wide) if not keys else wide, same("_t") if keys else F.lit(True))
    rows = rows.select(*keys, "_x", "_upto", (F.col("_upto") - F.col("_own")).alias("_from"), F.explode(F.sequence(cell(F.col("_upto") - F.col("_own")), cell(F.col("_upto") - 1))).alias("_cell"))
    at = F.transform(F.array(*[F.lit(float(v)) for v in levels]), lambda v, i: F.struct(i.alias("i"), (v * (F.col("_total") - 1)).alias("h")))
    asked = wide.select(*[F.col(f"_t{i}").alias(f"_k{i}") for i in range(len(keys))], "_width", F.explode(at).alias("l"))
    asked = asked.select(*[f"_k{i}" for i in range(len(keys))], "_width", F.col("l.i").alias("_i"), F.col("l.h").alias("_h"), F.explode(F.array_distinct(F.array(F.floor("l.h"), F.ceil("l.h")))).alias("_want"))
    asked = asked.withColumn("_asked", cell(F.col("_want")))
    on = (F.col("_cell") == F.col("_asked")) & (F.col("_from") <= F.col("_want")) & (F.col("_want") < F.col("_upto")) & same("_k")
    found = rows.join(asked, on).groupBy(*keys, "_i", "_h").agg(F.min(F.struct("_want", "_x")).alias("a"), F.max(F.struct("_want", "_x")).alias("b"))
    value = F.col("a._x") + (F.col("_h") - F.col("a._want")) * (F.col("b._x") - F.col("a._x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", value.alias("v"))))
    return found.groupBy(*keys).agg(F.transform(ordered, lambda q: q["v"]).alias(to))
