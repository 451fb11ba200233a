"""Running sums, ranks and neighbours in an order, without one task per order.

Rows are dealt into buckets that follow the order: stretches of the axis, or ranges of a number cut
at its quantiles.  Windows run within buckets; what lies before or behind comes from one row per
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range bucket, about.
TOGETHER = 200_000
#: Ranges a table is cut into, at most: their borders are a list in the plan.
RANGES = 2_000


def range_bucket(rows: DataFrame, by: str, descending: bool = False) -> Column:
    """Bucket number of ``by``: ranges of about ``TOGETHER`` rows, in the order asked for.

    The borders are quantiles, found by one aggregate and then fixed, so that reruns of a task agree;
    they decide how rows are spread and no result.  Equal values share a bucket; nulls come first.
    """
    ranges = min(RANGES, -(-rows.count() // TOGETHER))
    if ranges <= 1:
        return F.lit(0)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(by).cast("double"), shares, 100 * ranges).alias("x")).first().x or []))
    listed = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    place = F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.size(F.filter(listed, lambda c: c < F.col(by).cast("double"))))
    return -place if descending else place


def key_of(*columns) -> Column:
    """One key of several columns.  Equal nulls inside a struct are equal, so null keys stay a group of their
    own, and a window and a join on the same column need one shuffle."""
    return F.struct(*columns)


def sums_before(rows: DataFrame, keys: list[str], bucket: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds for each row the sums over the rows of its keys before it; 0 for the first."""
    dealt = rows.withColumn("_bucket", bucket).withColumn("_key", key_of(*keys, "_bucket"))
    own = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select(*rows.columns, "_key", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_in_{n}") for n, v in sums.items()])
    totals = dealt.groupBy("_key").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    along = Window.partitionBy(*([F.col(f"_key.{k}") for k in keys] or [F.lit(0)])).orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", *[F.coalesce(F.sum(f"_t_{n}").over(along), F.lit(0)).alias(f"_b_{n}") for n in sums])
    joined = inside.join(offsets, "_key")
    return joined.select(*rows.columns, *[(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def with_neighbours(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], back: dict[str, str], ahead: dict[str, str]) -> DataFrame:
    """Adds values of the row before (``back``: new name to column) and of the row behind (``ahead``).

    ``order`` is ascending.  Null where there is no such row.
    """
    dealt = rows.withColumn("_bucket", bucket).withColumn("_key", key_of(*keys, "_bucket"))
    inside = Window.partitionBy("_key").orderBy(*order)
    local = dealt.select(
        *rows.columns, "_key", F.row_number().over(inside).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("_key")).alias("_n"),
        *[F.lag(c).over(inside).alias(f"_l_{n}") for n, c in back.items()], *[F.lead(c).over(inside).alias(f"_l_{n}") for n, c in ahead.items()],
    )
    place = F.struct(*order)
    edges = dealt.groupBy("_key").agg(
        *[F.max_by(c, place).alias(f"_e_{n}") for n, c in back.items()], *[F.min_by(c, place).alias(f"_e_{n}") for n, c in ahead.items()]
    )
    along = Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy("_key._bucket")
    edges = edges.select(
        "_key", *[F.lag(f"_e_{n}").over(along).alias(f"_x_{n}") for n in back], *[F.lead(f"_e_{n}").over(along).alias(f"_x_{n}") for n in ahead]
    )
    joined = local.join(edges, "_key")
    first, last = F.col("_i") == 1, F.col("_i") == F.col("_n")
    found = [F.when(first, F.col(f"_x_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in back]
    found += [F.when(last, F.col(f"_x_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in ahead]
    return joined.select(*rows.columns, *found)
