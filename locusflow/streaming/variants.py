"""Variants as a stream against static tracks: a stateless stream-static join, and presence by key.

Axis and impacts are stored tables (Parquet): they are the static side and may not themselves
number lines or use windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_chrom
from ..operators import tracks
from ..operators.overlap import points_in


def vcf_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """VCF lines of files as they arrive: chrom, pos, vid (the ID), ref, alt, arrived."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    head = F.split("value", "\t", 6)
    cut = text.where("value <> '' AND NOT startswith(value, '#')").where(F.size(head) >= 5)
    return cut.select(
        normal_chrom(head[0]).alias("chrom"), head[1].try_cast("long").alias("pos"), head[2].alias("vid"), head[3].alias("ref"), head[4].alias("alt"),
        F.current_timestamp().alias("arrived"),
    )


def annotated_stream(variants: DataFrame, axis: DataFrame, impacts: DataFrame) -> DataFrame:
    """Arriving SNVs joined with the static axis and impact track; keeps no state.

    One row per variant, strand and impact with its ``elements``; :func:`annotated_rows` lays them out.  Impacts of
    ``placed_impacts`` are taken as they are.
    """
    snvs = variants.where(tracks.variant_kind(F.col("ref"), F.col("alt")) == "SNV")
    side = tracks.placed_product(impacts, axis, ["alt", "mask"]).withColumn("impact", tracks.impact_text(F.col("mask")))
    return snvs.join(side, ["chrom", "pos", "alt"]).select("arrived", "chrom", "pos", "vid", "ref", "alt", "mask", "impact", "elements")


def annotated_rows(written: DataFrame) -> DataFrame:
    """One row per variant and element from what :func:`annotated_stream` gives."""
    return tracks.laid_out(written).select("arrived", "chrom", "pos", "vid", "ref", "alt", "_x.element", "_x.track_pos", "mask", "impact")


def presence_stream(variants: DataFrame, axis: DataFrame, late: str = "1 hour") -> DataFrame:
    """Distinct (chrom, track_pos, alt) as they first appear; keys are forgotten ``late`` after the watermark."""
    # A track position belongs to one element and base, so what is new is known before the join: the state
    # holds a key per place and allele, not one per element they lie in.
    fresh = variants.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["chrom", "pos", "alt"])
    placed = points_in(fresh, axis)
    return placed.select("arrived", "chrom", tracks.track_position(F.col("pos")).alias("track_pos"), "alt")


def counts_stream(variants: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Variants per chromosome and arrival window; late rows within the watermark still count."""
    return variants.withWatermark("arrived", late).groupBy(F.window("arrived", window), "chrom").agg(F.count(F.lit(1)).alias("n"))
