"""Region algebra: merging, subtraction, flanks, distances, coverage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_order
from .ordering import key_of, range_bucket, sums_before, with_neighbours
from .overlap import BIN, bin_size, hit_by, overlapping


def length() -> Column:
    return F.col("end") - F.col("start") + 1


#: Bases of a stretch that one window partition sorts; a chromosome is many stretches.
STRETCH = 1 << 16


def stretch(position: str = "start") -> Column:
    return F.floor(F.col(position) / F.lit(STRETCH)).cast("long")


def _islands(rows: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.withColumn("_reach", F.max("end").over(before))
    fresh = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)
    runs = runs.withColumn("_island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_merged").alias("n_merged"))
        .drop("_island")
    )


def merge(regions: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Islands: a region joins the one before if start <= running end + ``gap``.

    One row per island with its keys, start, end and n_merged.  Pass ``("chrom", "strand")`` to
    merge strands apart, ``("chrom", "name")`` per element.

    Stretches of the axis are merged in parallel.  Islands that an earlier stretch reaches are then one
    row per stretch, as they belong together, and of the others only a stretch's last can reach on: at
    most two rows per stretch meet in a window per key, all other islands are finished.
    """
    rows = regions.where("start <= end").withColumn("_stretch", stretch())
    rows = rows.select(key_of(*keys, "_stretch").alias("_key"), "start", "end", F.lit(1).cast("long").alias("n_merged"))
    local = _islands(rows, gap, ["_key"])
    along = Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy("_key._stretch")
    bounds = local.groupBy("_key").agg(F.max("end").alias("_top"), F.min("start").alias("_low"))
    bounds = bounds.select(
        "_key", F.max("_top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"), F.lead("_low").over(along).alias("_next")
    )
    reached = F.coalesce(F.col("start") <= F.col("_reach") + gap, F.lit(False))
    reaching = F.coalesce(F.col("end") + gap >= F.col("_next"), F.lit(False))
    placed = local.join(bounds, "_key").select("_key", "start", "end", "n_merged", reached.alias("_reached"), reaching.alias("_reaching"))
    own = [F.col(f"_key.{k}").alias(k) for k in keys]
    done = placed.where("NOT _reached AND NOT _reaching").select(*own, "start", "end", "n_merged")
    open_ = placed.where("_reached OR _reaching").groupBy("_key", "_reached").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_merged").alias("n_merged")
    )
    return done.unionByName(_islands(open_.select(*own, "start", "end", "n_merged"), gap, list(keys)).select(*keys, "start", "end", "n_merged"))


def merge_all(region_sets: list[DataFrame], gap: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Union of several sets, merged."""
    whole = region_sets[0].select(*keys, "start", "end")
    for other in region_sets[1:]:
        whole = whole.unionByName(other.select(*keys, "start", "end"))
    return merge(whole, gap, keys)


def subtract(a: DataFrame, b: DataFrame, row_id: str, size: int = BIN) -> DataFrame:
    """Parts of each region of ``a`` that no region of ``b`` covers; other columns of ``a`` are kept.

    ``b`` is merged first, so the pieces are the gaps between consecutive covers of a row.
    """
    cuts = overlapping(a, merge(b), size=size)
    kept = [c for c in a.columns if c not in ("start", "end")]
    whole = a.select(*kept, "start", "end", F.lit(None).cast("long").alias("c_start"), F.lit(None).cast("long").alias("c_end"))
    covers = cuts.select(*kept, "start", "end", F.col("o_start").alias("c_start"), F.col("o_end").alias("c_end"))
    # The row itself closes the list: behind the last cover comes the gap up to its end.
    order = Window.partitionBy(row_id).orderBy(F.col("c_start").asc_nulls_last())
    rows = covers.unionByName(whole.where("start <= end"))
    rows = rows.withColumn("_from", F.coalesce(F.lag("c_end").over(order) + 1, F.col("start")))
    rows = rows.withColumn("_to", F.coalesce(F.col("c_start") - 1, F.col("end")))
    return rows.where("_from <= _to").select(*kept, F.col("_from").alias("start"), F.col("_to").alias("end"))


def subtract_pair(start: Column, end: Column, b_start: Column, b_end: Column) -> Column:
    """What is left of one region outside another: an array of none, one or two (start, end)."""
    left = F.struct(start.alias("start"), F.least(end, b_start - 1).alias("end"))
    right = F.struct(F.greatest(start, b_end + 1).alias("start"), end.alias("end"))
    return F.filter(F.array(left, right), lambda x: x["start"] <= x["end"])


def introns(genes: DataFrame, exons: DataFrame, row_id: str, size: int | None = None) -> DataFrame:
    """Genes less all exons; genes are long, so their lengths decide the bin."""
    return subtract(genes, exons, row_id, size or bin_size(genes, exons))


def running_bounds(regions: DataFrame) -> DataFrame:
    """Adds running_end (greatest end so far) and rest_start (least start from here on), in sorted order.

    Windows run within stretches; what lies in other stretches comes from one row per stretch.
    """
    inside = Window.partitionBy("chrom", "_stretch").orderBy("start", "end", F.length("name"), "name")
    cut = regions.withColumn("_stretch", stretch())
    over = Window.partitionBy("chrom").orderBy("_stretch")
    ends = cut.groupBy("chrom", "_stretch").agg(F.max("end").alias("_top"))
    ends = ends.select("chrom", "_stretch", F.max("_top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    # Starts are sorted, so the least start from a row on is its own; a window over what follows would read
    # the rest of the stretch again for every row.
    local = cut.withColumns({"running_end": F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rest_start": F.col("start")})
    return local.join(ends, ["chrom", "_stretch"]).withColumn("running_end", F.greatest("running_end", "_before")).drop("_stretch", "_before")


def super_hulls(children: DataFrame, parents: DataFrame, size: int | None = None) -> DataFrame:
    """Hull of the children inside each (merged) parent; children elsewhere on a chromosome without parents pass.

    ``crossing`` counts children that stick out of their parent; callers that need none can check it.
    """
    merged = merge(parents).withColumn("name", F.lit("."))
    pairs = overlapping(merged.select("chrom", "start", "end", "name"), children, size=size or bin_size(children, parents))
    out = (F.col("b_start") < F.col("start")) | (F.col("b_end") > F.col("end"))
    hulls = pairs.groupBy("chrom", "start", "end").agg(
        F.min("b_start").alias("h_start"), F.max("b_end").alias("h_end"), F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("crossing")
    )
    hulls = hulls.select("chrom", F.col("h_start").alias("start"), F.col("h_end").alias("end"), "n", "crossing")
    lone = children.join(parents.select("chrom").distinct(), "chrom", "left_anti")
    return hulls.unionByName(lone.select("chrom", "start", "end", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("crossing")))


# ---------------------------------------------------------------- filters and projections


def on_chrom(regions: DataFrame, chrom: str) -> DataFrame:
    return regions.where(F.col("chrom") == chrom)


def on_strand(regions: DataFrame, strand: str) -> DataFrame:
    return regions.where(F.col("strand") == strand)


def longer_than(regions: DataFrame, bases: int) -> DataFrame:
    return regions.where(F.col("end") - F.col("start") > bases)


def shorter_than(regions: DataFrame, bases: int) -> DataFrame:
    return regions.where(F.col("end") - F.col("start") < bases)


def ending_before(regions: DataFrame, position: int) -> DataFrame:
    return regions.where(F.col("end") < position)


def sorted_places(regions: DataFrame, keys: tuple[str, ...] = ("chrom", "strand")) -> DataFrame:
    """Adds ``place``, from 1: the row's place by start, end and natural order of names among rows of its keys."""
    order = [F.col("start"), F.col("end"), *natural_order("name")]
    found = sums_before(regions, list(keys), stretch(), order, {"place": F.lit(1)})
    return found.withColumn("place", (F.col("place") + 1).cast("long"))


def ill_formed(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("start") > F.col("end"))


def mids(regions: DataFrame, width: int) -> DataFrame:
    """The middle plus and minus half of ``width``; starts below 1 become 1."""
    middle, half = F.floor((F.col("start") + F.col("end")) / 2), width // 2
    return regions.withColumns({"start": F.greatest(F.lit(1), middle - half).cast("long"), "end": (middle + half).cast("long")})


def end_flanks(regions: DataFrame, bases: int | None = None, fraction: float | None = None) -> DataFrame:
    """Both ends extended: one row per side (``5p``, ``3p`` by strand), of ``bases`` or a fraction of the length."""
    size = F.lit(bases) if fraction is None else F.floor(length() * F.lit(fraction))
    left = F.struct(
        F.when(F.col("strand") == "-", F.lit("3p")).otherwise(F.lit("5p")).alias("side"),
        F.greatest(F.lit(1), F.col("start") - size).cast("long").alias("f_start"),
        (F.col("start") - 1).cast("long").alias("f_end"),
    )
    right = F.struct(
        F.when(F.col("strand") == "-", F.lit("5p")).otherwise(F.lit("3p")).alias("side"),
        (F.col("end") + 1).cast("long").alias("f_start"),
        (F.col("end") + size).cast("long").alias("f_end"),
    )
    kept = [c for c in regions.columns if c not in ("start", "end")]
    flat = regions.select(*kept, F.explode(F.array(left, right)).alias("f"))
    return flat.select(*kept, "f.side", F.col("f.f_start").alias("start"), F.col("f.f_end").alias("end")).where("start <= end")


def extend(regions: DataFrame, bases: int, five_prime: bool = True, three_prime: bool = True) -> DataFrame:
    """Regions extended on the chosen ends by strand; ``bases`` <= 0 means each region's own length."""
    size = F.lit(bases) if bases > 0 else length()
    minus = F.col("strand") == "-"
    left = F.when(minus, F.lit(three_prime)).otherwise(F.lit(five_prime))
    right = F.when(minus, F.lit(five_prime)).otherwise(F.lit(three_prime))
    start = F.when(left, F.greatest(F.lit(1), F.col("start") - size)).otherwise(F.col("start"))
    end = F.when(right, F.col("end") + size).otherwise(F.col("end"))
    return regions.withColumns({"start": start.cast("long"), "end": end.cast("long")})


def left_flanks(regions: DataFrame, bases: int) -> DataFrame:
    """Ends at the region's first base, which is shared."""
    return regions.withColumns({"start": F.greatest(F.lit(1), F.col("start") - bases).cast("long"), "end": F.col("start")})


def right_flanks(regions: DataFrame, bases: int) -> DataFrame:
    return regions.withColumns({"start": F.col("end"), "end": (F.col("end") + bases).cast("long")})


def promoters(genes: DataFrame, sizes: DataFrame, margin: int) -> DataFrame:
    """TSS plus and minus ``margin``, clamped to [1, chromosome length - 10]."""
    tss = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    joined = genes.withColumn("tss", tss).join(sizes.select("chrom", F.col("length").alias("_length")), "chrom")
    return joined.withColumns(
        {"start": F.greatest(F.lit(1), F.col("tss") - margin).cast("long"), "end": F.least(F.col("_length") - 10, F.col("tss") + margin).cast("long")}
    ).drop("_length")


def genome_position(index: Column, start: Column, end: Column, strand: Column) -> Column:
    """Genome position of the 1-based index in a region's own sequence."""
    return F.when(strand == "-", end - index + 1).otherwise(start + index - 1)


def sequence_index(position: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end - position + 1).otherwise(position - start + 1)


def translate_coord(position: Column, source_base: int, target_base: int) -> Column:
    return position - source_base + target_base


# ---------------------------------------------------------------- coverage and statistics


def coverage(regions: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Summed lengths; overlaps count twice, reversed regions not at all."""
    return regions.where("start <= end").groupBy(*keys).agg(F.sum(length()).alias("covered"), F.count(F.lit(1)).alias("n_regions"))


def nucleotide_overlap(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """2 cov(intersection) / (cov a + cov b) over merged sets: one row."""
    one, two = merge(a), merge(b)
    both = overlapping(one.withColumn("name", F.lit(".")), two, size=size).agg(F.coalesce(F.sum("l_overlap"), F.lit(0)).alias("shared"))
    total = one.agg(F.sum(length()).alias("cov_a")).crossJoin(two.agg(F.sum(length()).alias("cov_b")))  # one row each
    return total.crossJoin(both).select("cov_a", "cov_b", "shared", (2 * F.col("shared") / (F.col("cov_a") + F.col("cov_b"))).alias("overlap"))


def touched_overlap(a: DataFrame, b: DataFrame, row_id: str, b_id: str, size: int = BIN) -> DataFrame:
    """Shared bases over the bases of the regions that touch: one row per chromosome."""
    pairs = overlapping(a, b, size=size)
    shared = pairs.groupBy("chrom").agg(F.sum("l_overlap").alias("shared"))
    own = pairs.select("chrom", row_id, "start", "end").distinct().groupBy("chrom").agg(F.sum(length()).alias("touched_a"))
    other = pairs.select("chrom", "b_" + b_id, "b_start", "b_end").distinct()
    other = other.groupBy("chrom").agg(F.sum(F.col("b_end") - F.col("b_start") + 1).alias("touched_b"))
    return shared.join(own, "chrom").join(other, "chrom")


def hit_fraction(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Share of the regions of ``a`` hit by ``b``: one row per chromosome."""
    hits = hit_by(a, b, size=size).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_hit"))
    total = a.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    return total.join(hits, "chrom", "left").select("chrom", "n", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"))


def overlap_histogram(a: DataFrame, b: DataFrame, row_id: str, steps: int = 10, size: int = BIN) -> DataFrame:
    """Histogram of each region's greatest overlap fraction; regions without any fall into bin 0."""
    best = overlapping(a, b, size=size).groupBy(row_id).agg(F.max("l_overlap").alias("best"))
    joined = a.where("start <= end").join(best, row_id, "left")
    bins = F.floor(F.coalesce("best", F.lit(0)) * steps / length()).cast("long")
    return joined.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def association_counts(peaks: DataFrame, profile: str, gap: int = 0, size: int = BIN) -> DataFrame:
    """How many aggregate (merged) peaks two profiles share: rows (p, q, n) with p <= q.

    A peak lists its profiles once; the pairs of a peak are bounded by the number of profiles.
    """
    whole = merge(peaks, gap).withColumn("name", F.lit(".")).withColumn("peak", F.struct("chrom", "start"))
    members = overlapping(whole, peaks, size=size).select("peak", F.col("b_" + profile).alias("p")).distinct()
    other = members.select("peak", F.col("p").alias("q"))
    return members.join(other, "peak").where("p <= q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


def adjusted_p_values(tests: DataFrame, log_p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """log q = log p + ln(n / rank), without the monotone step; ties in ``log_p`` keep distinct ranks by row order of ``name``."""
    ranked = sums_before(tests, list(keys), range_bucket(tests, log_p), [F.col(log_p), F.col("name")], {"rank": F.lit(1)})
    ranked = ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))
    totals = tests.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        counted = ranked.join(totals, same)
    else:
        counted = ranked.withColumn("_n", F.lit(totals.first()["_n"]))
    return counted.select(*tests.columns, "rank", (F.col(log_p) + F.log(F.col("_n") / F.col("rank"))).alias("log_q"))


def top_by_coverage(regions: DataFrame, most: int, order: str) -> DataFrame:
    """Per chromosome, the best regions until their summed length reaches ``most``, the crossing one included.

    ``order`` is a number, the greatest first.
    """
    found = sums_before(regions, ["chrom"], range_bucket(regions, order, descending=True), [F.desc(order), "start", "end", "name"], {"covered_before": length()})
    return found.where((F.col("covered_before") < most) | (F.col("covered_before") == 0))


# ---------------------------------------------------------------- distances


def nearest(a: DataFrame, b: DataFrame, row_id: str, cap: int = 10_000_000) -> DataFrame:
    """Distance of each region of ``a`` to the nearest of ``b`` (0 if they overlap), at most ``cap``.

    An as-of lookup over the sorted union: the greatest end that starts before and the least start
    behind.
    """
    ours = a.select("chrom", "start", "end", F.lit(1).alias("ours"), F.col(row_id).alias("_id"))
    theirs = b.select("chrom", "start", "end", F.lit(0).alias("ours"), F.lit(None).cast(a.schema[row_id].dataType).alias("_id"))
    both = ours.unionByName(theirs).withColumn("_stretch", stretch())
    theirs_only = lambda c: F.when(F.col("ours") == 0, F.col(c))
    # Within a stretch by windows, beyond it from one row per stretch.
    over = Window.partitionBy("chrom").orderBy("_stretch")
    totals = both.groupBy("chrom", "_stretch").agg(F.max(theirs_only("end")).alias("_top"), F.min(theirs_only("start")).alias("_low"))
    totals = totals.select(
        "chrom",
        "_stretch",
        F.max("_top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"),
        F.min("_low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_on"),
    )
    by_start = Window.partitionBy("chrom", "_stretch").orderBy("start", "ours").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("chrom", "_stretch").orderBy(F.desc("start"), "ours").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_reach", F.max(theirs_only("end")).over(by_start)).withColumn("_ahead", F.min(theirs_only("start")).over(behind))
    seen = local.where("ours = 1").join(totals, ["chrom", "_stretch"])
    seen = seen.withColumn("_reach", F.greatest("_reach", "_back")).withColumn("_ahead", F.least("_ahead", "_on"))
    # greatest() skips nulls, so a side without a neighbour is told apart first.
    left = F.when(F.col("_reach").isNotNull(), F.greatest(F.lit(0), F.col("start") - F.col("_reach")))
    right = F.when(F.col("_ahead").isNotNull(), F.greatest(F.lit(0), F.col("_ahead") - F.col("end")))
    distance = F.least(left, right, F.lit(cap))
    return seen.select(F.col("_id").alias(row_id), "chrom", "start", "end", distance.cast("long").alias("distance"))


def self_distances(regions: DataFrame) -> DataFrame:
    """Distance of each region to the nearer neighbour in sorted order; the first and last of a chromosome are left out."""
    order = [F.col("start"), F.col("end"), F.length("name"), F.col("name")]
    found = with_neighbours(regions, ["chrom"], stretch(), order, {"_back": "end"}, {"_ahead": "start"})
    gap = F.least(F.col("start") - F.col("_back"), F.col("_ahead") - F.col("end"))
    inner = F.col("_back").isNotNull() & F.col("_ahead").isNotNull()
    return found.withColumn("distance", F.when(inner, gap)).where("distance is not null").drop("_back", "_ahead")


def successive_distances(regions: DataFrame, order_by: str) -> DataFrame:
    """start of the next region in list order (a number) less this end; negatives are kept."""
    found = with_neighbours(regions, ["chrom"], range_bucket(regions, order_by), [F.col(order_by)], {}, {"_ahead": "start"})
    return found.withColumn("distance", F.col("_ahead") - F.col("end")).where("distance is not null").drop("_ahead")


def hull_by(regions: DataFrame, key: str) -> DataFrame:
    """Largest region per property: hull, members and count; regions without the property are one per place."""
    named = F.coalesce(F.col(key), F.concat_ws("_", F.lit("NONAME"), F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string")))
    members = F.array_sort(F.collect_list(F.struct("start", "end")))
    return regions.groupBy("chrom", named.alias("property")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), members.alias("intervals"), F.count(F.lit(1)).alias("n")
    )


def flattened(composites: DataFrame, intervals: str = "intervals") -> DataFrame:
    """One row per interval of composite regions."""
    kept = [c for c in composites.columns if c not in ("start", "end", intervals)]
    flat = composites.select(*kept, F.explode(intervals).alias("i"))
    return flat.select(*kept, F.col("i.start").alias("start"), F.col("i.end").alias("end"))


def top_spaced(regions: DataFrame, score: str, n: int, apart: int) -> DataFrame:
    """Greedy best-first choice per chromosome, each more than ``apart`` from all chosen; then the same from the worst.

    The choice goes by the rows best first and ends with the n-th, so only a leading part of them
    decides.  That part is taken per partition before anything is shuffled, and taken longer until
    every side has its n or has been read to its end: the result is that of all rows.
    """
    import pyarrow as pa

    schema = "chrom string, start long, end long, name string, score double, side string"

    def choose(batches):
        chosen: list[tuple] = []
        at = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0], row[5]) != at:
                    at, chosen = (row[0], row[5]), []
                if len(chosen) < n and all(row[1] - e > apart or s - row[2] > apart for s, e in chosen):
                    chosen.append((row[1], row[2]))
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(batch.schema)], batch.schema.names)

    base = regions.select("chrom", "start", "end", "name", F.col(score).cast("double").alias("score"))
    sides = base.withColumn("side", F.explode(F.array(F.lit("top"), F.lit("bottom"))))
    key = F.when(F.col("side") == "top", -F.col("score")).otherwise(F.col("score"))
    order = [key, F.col("start"), F.col("end"), F.col("name")]
    most = 64 * n
    while True:
        first = sides.withColumn("_i", F.row_number().over(Window.partitionBy("chrom", "side").orderBy(*order))).where(F.col("_i") <= most).drop("_i")
        dealt = first.repartition("chrom", "side").sortWithinPartitions("chrom", "side", *order)
        found = dealt.mapInArrow(choose, schema)
        read = first.groupBy("chrom", "side").agg(F.count(F.lit(1)).alias("read"))
        held = found.groupBy("chrom", "side").agg(F.count(F.lit(1)).alias("held"))
        if not read.join(held, ["chrom", "side"], "left").where((F.col("read") == most) & (F.coalesce("held", F.lit(0)) < n)).limit(1).count():
            return found
        most *= 8
