"""Enumerated and simulated variants, random regions.

Randomness is a hash of (key, seed), so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import TOGETHER, range_bucket, sums_before
from .overlap import overlapping
from .regions import merge

#: Hexadecimal digits of a hash that make a draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) drawn from the key and the seed.

    It is the head of an MD5 over the key's texts joined by ``|``, which any SQL engine can repeat.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def normal(seed: int, *key: Column) -> Column:
    """Standard normal by Box and Muller from two draws of the key."""
    u = F.greatest(uniform(seed, *key, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, *key, F.lit("v")))


def random_places(rows: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Adds ``place``, from 0: the row's place in a random order of all rows."""
    ranges = max(1, -(-rows.count() // TOGETHER))  # draws are even, so their ranges are buckets of about equal size
    drawn = rows.withColumn("_u", uniform(seed, F.col(row_id)))
    return sums_before(drawn, [], F.floor(F.col("_u") * ranges), ["_u", row_id], {"place": F.lit(1)}).drop("_u")


def permuted(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """Rows in an order drawn from their keys."""
    return rows.orderBy(uniform(seed, *[F.col(k) for k in key]), *key)


def line_sample(rows: DataFrame, share: float, seed: int, *key: str) -> DataFrame:
    """Rows whose draw lies below the share: about that part of them, the same in every run."""
    return rows.where(uniform(seed, *[F.col(k) for k in key]) < share)


def parts_of(rows: DataFrame, parts: int, seed: int, *key: str) -> DataFrame:
    """Adds ``part``, 0 to parts - 1: rows split at random into lists of about equal length."""
    return rows.withColumn("part", F.floor(uniform(seed, *[F.col(k) for k in key]) * parts).cast("int"))


def in_turn(rows: DataFrame, parts: int, order: str) -> DataFrame:
    """Adds ``part``: rows are dealt in turn, in the order of a number."""
    numbered = sums_before(rows, [], range_bucket(rows, order), [order], {"_i": F.lit(1)})
    return numbered.withColumn("part", F.pmod("_i", F.lit(parts)).cast("int")).drop("_i")


def interleaved(lists: list[DataFrame], order: str) -> DataFrame:
    """Rows of several lists in one list: all first ones, then all second ones, and so on; adds turn and part."""
    out = None
    for part, rows in enumerate(lists):
        numbered = sums_before(rows, [], range_bucket(rows, order), [order], {"turn": F.lit(1)}).withColumn("part", F.lit(part))
        out = numbered if out is None else out.unionByName(numbered)
    return out.orderBy("turn", "part")


def element_bases(regions: DataFrame, bases: DataFrame) -> DataFrame:
    """(chrom, pos, element, base) of every base of every element; unknown bases are N."""
    spots = regions.where("start <= end").select("chrom", F.col("name").alias("element"), "row_id", F.explode(F.sequence("start", "end")).alias("pos"))
    joined = spots.join(bases.select("chrom", "pos", "base"), ["chrom", "pos"], "left")
    return joined.withColumn("base", F.coalesce(F.upper("base"), F.lit("N")))


def enumerate_snvs(bases: DataFrame) -> DataFrame:
    """Every other base at every element base: three rows, four where the base is N."""
    alts = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda a: a != F.col("base"))
    return bases.select("chrom", "pos", "element", "row_id", F.col("base").alias("ref"), F.explode(alts).alias("alt"))


def enumerate_indels(bases: DataFrame, longest: int, chunks_window: str = "following") -> DataFrame:
    """Per element base, insertions of N x 1..L and deletions of 1..L bases.

    ``following`` holds the L bases behind the base (see ``tracks.with_window``).
    """
    sizes = bases.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    inserted = sizes.select("chrom", "pos", "element", "row_id", F.col("base").alias("ref"), F.concat("base", F.repeat(F.lit("N"), F.col("n"))).alias("alt"))
    deleted = sizes.select("chrom", "pos", "element", "row_id", F.concat("base", F.substring(F.col(chunks_window), F.lit(1), F.col("n"))).alias("ref"), F.col("base").alias("alt"))
    return inserted.unionByName(deleted)


def simulate_snvs(bases: DataFrame, probability: float, seed: int = 1) -> DataFrame:
    """Each element base mutates with the probability to a uniform other base; genotype 0|1."""
    key = [F.col("chrom"), F.col("pos"), F.col("element"), F.col("row_id")]
    hit = bases.where(uniform(seed, *key) < probability)
    others = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda a: a != F.col("base"))
    pick = F.element_at(others, (F.floor(uniform(seed + 1, *key) * F.size(others)) + 1).cast("int"))
    name = F.concat_ws("_", "chrom", F.col("pos").cast("string"), F.lit("SNV"), "element")
    return hit.select("chrom", "pos", name.alias("id"), F.col("base").alias("ref"), pick.alias("alt"), F.lit("0|1").alias("gt"))


def simulate_indels(bases: DataFrame, longest: int, probability: float, deletions: float, seed: int = 1, following: str = "following") -> DataFrame:
    """Insertions and deletions at element bases, anchored at the base before.

    Length is floor(U * longest), 0 becoming 1; an insertion if a draw exceeds ``deletions``.
    ``before`` is the anchor base, ``following`` the bases from the position on.
    """
    key = [F.col("chrom"), F.col("pos"), F.col("element"), F.col("row_id")]
    hit = bases.where(uniform(seed, *key) < probability)
    size = F.greatest(F.lit(1), F.floor(uniform(seed + 1, *key) * longest).cast("int"))
    inserts = uniform(seed + 2, *key) > deletions
    drawn = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform(seed + 3, *key, i) * 4) + 1).cast("int"), F.lit(1)))
    gone = F.substring(F.col(following), F.lit(1), size)
    # Drawn before ``pos`` gets its new meaning: inside a lambda Spark would take the new one.
    hit = hit.withColumns({"_ins": inserts, "_drawn": F.array_join(drawn, ""), "_gone": gone})
    inserts = F.col("_ins")
    kind = F.when(inserts, "INS").otherwise("DEL")
    return hit.select(
        "chrom", (F.col("pos") - 1).alias("pos"), F.concat_ws("_", "chrom", F.col("pos").cast("string"), kind, "element").alias("id"),
        F.when(inserts, F.col("before")).otherwise(F.concat("before", "_gone")).alias("ref"),
        F.when(inserts, F.concat("before", "_drawn")).otherwise(F.col("before")).alias("alt"),
        F.lit("0|1").alias("gt"),
    )


def random_regions(regions: DataFrame, sizes: DataFrame, replicates: int, row_id: str, seed: int = 1, same_chrom: bool = True) -> DataFrame:
    """Regions of the same lengths at random places, ``replicates`` of each, on the same or any chromosome."""
    copies = regions.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = [F.col(row_id), F.col("replicate")]
    width = F.col("end") - F.col("start")
    if same_chrom:
        placed = copies.join(sizes.select("chrom", "length"), "chrom")
    else:
        spans = sizes.select(F.array_sort(F.collect_list(F.struct("chrom", "length"))).alias("_all"))  # one row: the chromosome list
        picked = F.element_at("_all", (F.floor(uniform(seed + 7, *key) * F.size("_all")) + 1).cast("int"))
        placed = copies.drop("chrom").crossJoin(F.broadcast(spans)).withColumn("_x", picked).withColumns({"chrom": F.col("_x.chrom"), "length": F.col("_x.length")}).drop("_all", "_x")
    start = F.floor(uniform(seed, *key) * F.greatest(F.lit(1), F.col("length") - width)) + 1
    return placed.withColumns({"_s": start, "_w": width}).withColumns({"start": F.col("_s").cast("long"), "end": (F.col("_s") + F.col("_w")).cast("long")}).drop("_s", "_w", "length")


def random_overlap(a: DataFrame, b: DataFrame, sizes: DataFrame, replicates: int, row_id: str, seed: int = 1) -> DataFrame:
    """Observed and random overlap of merged regions: one row per replicate, 0 being the observed one."""
    observed = a.select("chrom", "start", "end", F.lit(0).alias("replicate"))
    drawn = random_regions(a, sizes, replicates, row_id, seed).select("chrom", "start", "end", "replicate")
    islands = merge(observed.unionByName(drawn), 0, ("chrom", "replicate"))
    pairs = overlapping(islands, merge(b))
    return pairs.groupBy("replicate").agg(F.sum("l_overlap").alias("shared"))


def shuffled_profiles(peaks: DataFrame, profile: str, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """Profiles keep their numbers of peaks, but the peaks are dealt anew; merged per profile.

    Places and profiles are numbered at random, each on its own, and joined by number.
    """
    places = random_places(peaks.select(row_id, "chrom", "start", "end"), seed, row_id).drop(row_id)
    names = random_places(peaks.select(row_id, profile), seed + 1, row_id).drop(row_id)
    return merge(places.join(names, "place").drop("place"), 0, ("chrom", profile))
