"""Elements of interest from gene annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute
from .regions import merge


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of equal keys in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(window)).where("_i = 1").drop("_i")


def repeats_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows but the first of equal keys."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(window)).where("_i > 1").drop("_i")


def _selected(gff: DataFrame, feature: str, extension: int) -> DataFrame:
    rows = gff.where(F.col("feature") == feature)
    return rows.withColumns(
        {
            "gene": attribute(F.col("attributes"), "gene_id"),
            "transcript": attribute(F.col("attributes"), "transcript_id"),
            "start": F.col("start") - extension,
            "end": F.col("end") + extension,
        }
    )


def without_ids(gff: DataFrame, feature: str) -> DataFrame:
    """Rows of the feature that lack a gene or transcript id: a validation query."""
    rows = _selected(gff, feature, 0)
    return rows.where("gene IS NULL OR transcript IS NULL")


def elements_of_interest(gff: DataFrame, ids: DataFrame, feature: str = "exon", level: str = "transcript", extension: int = 0) -> DataFrame:
    """Merged (touching ones join) extended regions of the listed genes or transcripts, named by them."""
    rows = _selected(gff, feature, extension).withColumn("name", F.col(level))
    listed = rows.join(ids.select(F.col("id").alias("name")).distinct(), "name", "left_semi")
    merged = merge(listed, 1, ("chrom", "name", "strand"))
    return merged.select("chrom", "start", "end", "name", F.lit(0).alias("score"), "strand")


def frame_unique_elements(gff: DataFrame, genes: DataFrame, feature: str = "CDS", extension: int = 0) -> tuple[DataFrame, DataFrame]:
    """(first, redundant) regions per gene of equal start, end and frame; name is the transcript, score the frame."""
    rows = _selected(gff, feature, extension).join(genes.select(F.col("id").alias("gene")).distinct(), "gene", "left_semi")
    frame = F.coalesce(F.col("frame").try_cast("int"), F.lit(0))
    rows = rows.select("chrom", "start", "end", F.col("transcript").alias("name"), frame.alias("score"), "strand", "gene")
    keys = ["gene", "start", "end", "score"]
    return first_of(rows, keys, ["name"]), repeats_of(rows, keys, ["name"])
