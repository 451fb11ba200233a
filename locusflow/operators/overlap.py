"""Interval joins: the shared primitive of region algebra and tracks.

A range predicate alone would plan a nested loop, and a join on the chromosome alone would put a
chromosome into one task.  Regions are therefore dealt into bins of the axis and joined on
(chrom, bin); the range test is a residual.  Both sides stay ordinary DataFrames, so Catalyst
still picks broadcast or shuffle from their statistics and AQE splits crowded bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a bin.  A power of two near the length of common regions (exons): smaller bins copy long
#: regions more often, larger ones compare more pairs.
BIN = 256


def bin_size(*region_sets: DataFrame) -> int:
    """A bin for regions of unlike lengths: the power of two at or above their mean length, 64 at least.

    Whatever the lengths, the bins then hold at most three times as many rows as there are regions.  One
    aggregate over start and end; for exons and the like the default does without it.
    """
    count = bases = 0
    for regions in region_sets:
        found = regions.where("start <= end").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("b")).first()
        count, bases = count + found.n, bases + (found.b or 0)
    return 1 << max(6, (max(1, bases // max(1, count)) - 1).bit_length())


def _floor(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def _binned(regions: DataFrame, size: int) -> DataFrame:
    bins = F.sequence(_floor(F.col("start"), size), _floor(F.col("end"), size))
    return regions.where("start <= end").withColumn("_bin", F.explode(bins))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def points_in(points: DataFrame, regions: DataFrame, position: str = "pos", keys: tuple[str, ...] = (), size: int = BIN) -> DataFrame:
    """Every (point, region) with start <= position <= end on the same chromosome.

    Region columns get the prefix ``r_``.  ``keys`` are further columns of both that must agree
    (strand, element name); equal names beyond chrom are then joined as well.
    """
    left = points.withColumn("_bin", _floor(F.col(position), size))
    right = prefixed(_binned(regions, size), "r_")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("r__bin"))
    for key in keys:
        on &= F.col(key) == F.col("r_" + key)
    within = F.col(position).between(F.col("r_start"), F.col("r_end"))
    return left.join(right, on & within).drop("_bin", "r__bin")


def points_in_elements(points: DataFrame, regions: DataFrame, position: str = "pos", element: str = "element", size: int = BIN) -> DataFrame:
    """Points in the regions of their own element: joined on (chrom, bin, name).

    The bin keeps an element of many regions from meeting all its points in all of them.
    """
    left = points.withColumn("_bin", _floor(F.col(position), size))
    right = prefixed(_binned(regions, size), "r_")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("r__bin")) & (F.col(element) == F.col("r_name"))
    return left.join(right, on & F.col(position).between(F.col("r_start"), F.col("r_end"))).drop("_bin", "r__bin")


def overlapping(a: DataFrame, b: DataFrame, stranded: bool = False, size: int = BIN, how: str = "inner") -> DataFrame:
    """Every overlapping pair once; columns of ``b`` get the prefix ``b_``.

    Adds l_overlap and the clipped o_start, o_end.  A pair is kept in the bin of the later start
    only, which is exact without a distinct.  ``how`` may be left_semi or left_anti, which give
    rows of ``a``.
    """
    left, right = _binned(a, size), prefixed(_binned(b, size), "b_")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("b__bin"))
    on &= (F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end"))
    if stranded:
        on &= F.col("strand") == F.col("b_strand")
    if how == "inner":
        on &= F.col("_bin") == _floor(F.greatest("start", "b_start"), size)
        out = left.join(right, on).drop("_bin", "b__bin")
        out = out.withColumn("o_start", F.greatest("start", "b_start")).withColumn("o_end", F.least("end", "b_end"))
        return out.withColumn("l_overlap", F.col("o_end") - F.col("o_start") + 1)
    raise ValueError(f"how must be inner here, not {how}; see hit_by and not_hit_by")


def hit_by(a: DataFrame, b: DataFrame, stranded: bool = False, size: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap any row of ``b``, as often as they occur in ``a``."""
    return _existence(a, b, stranded, size, True)


def not_hit_by(a: DataFrame, b: DataFrame, stranded: bool = False, size: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap no row of ``b``; ill-formed regions (start > end) overlap nothing."""
    return _existence(a, b, stranded, size, False)


def _existence(a: DataFrame, b: DataFrame, stranded: bool, size: int, hit: bool) -> DataFrame:
    # Each region is asked about once per distinct coordinate, so that its bins cannot multiply rows.
    keys = ["chrom", "start", "end", *(["strand"] if stranded else [])]
    asked = a.select(*keys).distinct()
    found = overlapping(asked, b, stranded, size).select(*keys).distinct()
    matched = prefixed(found, "_f_")
    on = F.lit(True)
    for key in keys:
        on &= F.col(key) == F.col("_f_" + key)
    return a.join(matched, on, "left_semi" if hit else "left_anti")


def first_overlap(a: DataFrame, b: DataFrame, row_id: str, stranded: bool = False) -> DataFrame:
    """For each row of ``a`` its overlap with the first row of ``b`` by (start, end, name).

    Of the rows of ``b`` that end at or behind a start, the first one overlaps the region, or none does.  So
    each start asks for a least row over the ends from it on, within stretches and from one row per stretch
    behind, and no pairs are made.
    """
    from . import regions

    keys = ["chrom", *(["strand"] if stranded else [])]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    order = ["start", "end", "name", *[c for c in b.columns if c not in ("start", "end", "name")]]
    ends = b.where("start <= end").where(known).groupBy(*keys, F.col("end").alias("_at")).agg(F.min(F.struct(*order)).alias("_x"))
    asked = a.where("start <= end").where(known).select(*keys, F.col("start").alias("_at"), F.struct(*a.columns).alias("_a"))
    both = ends.withColumn("_a", F.lit(None).cast(asked.schema["_a"].dataType)).unionByName(asked.withColumn("_x", F.lit(None).cast(ends.schema["_x"].dataType)))
    both = both.withColumn("_stretch", F.floor(F.col("_at") / regions.STRETCH))
    # Ends come before starts at the same base: both are inclusive.
    on = Window.partitionBy(*keys, "_stretch").orderBy(F.desc("_at"), F.col("_a").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    tops = ends.withColumn("_stretch", F.floor(F.col("_at") / regions.STRETCH)).groupBy(*keys, "_stretch").agg(F.min("_x").alias("_y"))
    behind = asked.select(*keys, F.floor(F.col("_at") / regions.STRETCH).alias("_stretch")).distinct().join(tops, [*keys, "_stretch"], "full_outer")
    behind = behind.withColumn("_y", F.min("_y").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)))
    found = both.withColumn("_x", F.min("_x").over(on)).where("_a IS NOT NULL").join(behind, [*keys, "_stretch"])
    found = found.select("_a", F.least("_x", "_y").alias("_x")).where("_x.start <= _a.end")
    pairs = found.select(*[F.col("_a")[c].alias(c) for c in a.columns], *[F.col("_x")[c].alias(f"b_{c}") for c in b.columns])
    pairs = pairs.withColumn("o_start", F.greatest("start", "b_start")).withColumn("o_end", F.least("end", "b_end"))
    pairs = pairs.withColumn("l_overlap", F.col("o_end") - F.col("o_start") + 1)
    rest = [c for c in pairs.columns if c != row_id]
    order = F.struct("b_start", "b_end", "b_name", *[c for c in rest if c not in ("b_start", "b_end", "b_name")])
    best = pairs.groupBy(row_id).agg(F.min(order).alias("x"))
    return best.select(*[F.col(row_id) if c == row_id else F.col("x")[c].alias(c) for c in pairs.columns])


def same_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of equal name; columns of ``b`` get the prefix ``b_``."""
    return a.join(prefixed(b, "b_"), F.col("name") == F.col("b_name"))


def same_place(a: DataFrame, b: DataFrame, by_name: bool = False) -> DataFrame:
    """Pairs of equal chromosome, start and end, optionally with names that hold one another."""
    from ..functions.text import names_match

    right = prefixed(b, "b_")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))
    if by_name:
        on &= names_match(F.col("name"), F.col("b_name"))
    return a.join(right, on)
