"""Variant effects from gene structure: element classes and what a variant does to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import amino_acid, complement
from ..functions.text import attribute
from .overlap import BIN, overlapping
from .regions import introns, promoters
from .tracks import CHUNK, laid_out, variant_kind, with_window

def gene_elements(gff: DataFrame, sizes: DataFrame, promoter: int) -> DataFrame:
    """(chrom, start, end, name, strand, element_type, transcript) of CDS, UTRs, introns and promoters.

    A plain ``UTR`` counts as 5'.  Introns are genes less all exons; their name is the gene's.
    """
    rows = gff.withColumns({"gene": attribute(F.col("attributes"), "gene_id"), "transcript": attribute(F.col("attributes"), "transcript_id")})

    def of(features: list[str], kind: str, name: str) -> DataFrame:
        return rows.where(F.col("feature").isin(features)).select(
            "chrom", "start", "end", F.col(name).alias("name"), "strand", F.lit(kind).alias("element_type"), "transcript"
        )

    genes = rows.where("feature = 'gene'").select("chrom", "start", "end", F.col("gene").alias("name"), "strand", F.lit(None).cast("string").alias("transcript"))
    exons = rows.where("feature = 'exon'").select("chrom", "start", "end")
    gaps = introns(genes, exons, "name").withColumn("element_type", F.lit("intron"))
    near = promoters(genes, sizes, promoter).drop("tss").withColumn("element_type", F.lit("promoter"))
    out = of(["CDS"], "CDS", "transcript").unionByName(of(["five_prime_UTR", "UTR"], "5p_UTR", "transcript"))
    out = out.unionByName(of(["three_prime_UTR"], "3p_UTR", "transcript"))
    return out.unionByName(gaps, allowMissingColumns=True).unionByName(near, allowMissingColumns=True)


def transcript_base(variant: Column, strand: Column) -> Column:
    return F.when(strand == "-", complement(variant)).otherwise(variant)


def splice_loss(intron_start: Column, intron_end: Column, strand: Column, pos: Column, first2: Column, last2: Column, alt: Column) -> Column:
    """An SNV changes a GT donor or AG acceptor at an intron's edges (both given as genome bases)."""
    minus = strand == "-"
    donor = F.when(minus, last2 == "AC").otherwise(first2 == "GT")
    acceptor = F.when(minus, first2 == "CT").otherwise(last2 == "AG")
    at_first, at_last = pos.between(intron_start, intron_start + 1), pos.between(intron_end - 1, intron_end)
    old = F.when(at_first, F.substring(first2, (pos - intron_start + 1).cast("int"), F.lit(1))).otherwise(
        F.substring(last2, (pos - intron_end + 2).cast("int"), F.lit(1))
    )
    site = F.when(at_first, F.when(minus, acceptor).otherwise(donor)).when(at_last, F.when(minus, donor).otherwise(acceptor))
    return F.coalesce(site & (old != alt), F.lit(False))


def coding_effect(kind: Column, old_codon: Column, new_codon: Column, size: Column, indel_phase: Column) -> Column:
    """Effect inside a CDS whose transcript is a whole number of codons.

    ``indel_phase`` is the place in its codon (0 to 2), in reading order, of the first base behind an
    insertion or of the first one deleted: only on a codon boundary whole codons come or go.
    """
    old, new = amino_acid(old_codon), amino_acid(new_codon)
    snv = (
        F.when(new == "STOP", "CDS_EARLY_STOP").when(old == "STOP", "CDS_STOP_DISRUPTION").when(old != new, "CDS_NONSYNONYMOUS").otherwise("CDS_SYNONYMOUS")
    )
    ins = F.when((size % 3 == 0) & (indel_phase == 0), "CDS_INFRAME_INSERTION").when(size % 3 == 0, "CDS_POST_INFRAME_INSERTION").otherwise("CDS_FRAMESHIFT_INSERTION")
    gone = F.when((size % 3 == 0) & (indel_phase == 0), "CDS_INFRAME_DELETION").otherwise("CDS_FRAMESHIFT_DELETION")
    return F.when(kind == "SNV", snv).when(kind == "INS", ins).when(kind == "DEL", gone).otherwise("CDS_CNV")


def with_edges(elements: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds first2 and last2, the genome's bases at both ends of a region, as splice sites are read from them."""
    first = with_window(elements, chunks, "start", 0, 1, "first2", chunk)
    return with_window(first, chunks, "end", 1, 0, "last2", chunk)


def intron_effect(kind: Column, start: Column, end: Column, strand: Column, pos: Column, ref: Column, alt: Column, first2: Column, last2: Column) -> Column:
    """SPLICE_LOSS or INTRON: an SNV that changes a GT or AG edge, an insertion into or beside an edge's two
    bases, or a deletion of any of them."""
    inserted = (pos <= start) | (pos >= end - 1)  # behind ``pos``
    gone_from, gone_to = pos + F.length(alt), pos + F.length(ref) - 1
    deleted = ((gone_from <= start + 1) & (gone_to >= start)) | ((gone_to >= end - 1) & (gone_from <= end))
    lost = (
        F.when(kind == "SNV", splice_loss(start, end, strand, pos, first2, last2, alt))
        .when(kind == "INS", inserted).when(kind == "DEL", deleted).otherwise(F.lit(False))
    )
    return F.when(lost, "SPLICE_LOSS").otherwise("INTRON")


def variant_effects(variants: DataFrame, elements: DataFrame, transcripts: DataFrame, size: int = BIN) -> DataFrame:
    """One row per (variant, element): vid, name, element_type, effect, ref_aa, alt_aa.

    ``elements`` have chrom, start, end, name, strand, element_type; CDS rows also before, the
    transcript's bases in front of them, and introns first2 and last2 (:func:`with_edges`), without
    which no SNV is a splice loss.  ``transcripts`` (name, seq) hold the spliced sequences; those that
    are no whole number of codons have no coding effect.
    """
    # Of the letters only an SNV's own is looked at, so variants that differ in no more meet the elements once;
    # a row has 4,096 of them at most.
    single = variant_kind(F.col("ref"), F.col("alt")) == "SNV"
    unnamed = lambda c: F.repeat(F.lit("N"), F.length(c))
    alike = variants.select("vid", "chrom", "pos", unnamed("ref").alias("ref"), F.when(single, F.col("alt")).otherwise(unnamed("alt")).alias("alt"))
    key = ["chrom", "pos", "ref", "alt"]
    alike = alike.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("vid")) - 1) / 4_096))
    alike = alike.groupBy(*key, "_block").agg(F.collect_list(F.struct("vid")).alias("_vids"))
    spans = alike.select(*key, "_vids", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).cast("long").alias("end"))
    for missing, kind in (("before", "long"), ("first2", "string"), ("last2", "string")):
        if missing not in elements.columns:
            elements = elements.withColumn(missing, F.lit(None).cast(kind))
    # Sequences go to the elements before the interval join, whose pairs are many and are not dealt out again.
    read = elements.join(transcripts.select("name", F.col("seq").alias("_seq")), "name", "left")
    joined = overlapping(spans, read, size=size).withColumnRenamed("b__seq", "seq")
    minus = F.col("b_strand") == "-"
    offset = F.when(minus, F.col("b_end") - F.col("pos")).otherwise(F.col("pos") - F.col("b_start"))
    index = (F.col("b_before") + offset).cast("int")  # 0-based in the transcript
    phase = F.pmod(index, F.lit(3))
    old = F.substring(F.col("seq"), index - phase + 1, F.lit(3))
    new = F.overlay(old, transcript_base(F.col("alt"), F.col("b_strand")), phase + 1, F.lit(1))
    kind = variant_kind(F.col("ref"), F.col("alt"))
    width = F.abs(F.length("ref") - F.length("alt"))
    behind = F.when(minus, index).otherwise(index + 1)
    gone = F.when(minus, index - F.length("ref") + 1).otherwise(index + F.length("alt"))
    indel_phase = F.pmod(F.when(kind == "INS", behind).otherwise(gone), F.lit(3))
    whole = F.length("seq") % 3 == 0
    here = F.col("b_element_type")
    place = [F.col(c) for c in ("b_start", "b_end", "b_strand", "pos", "ref", "alt", "b_first2", "b_last2")]
    effect = (
        F.when((here == "CDS") & whole, coding_effect(kind, old, new, width, indel_phase))
        .when(here == "intron", intron_effect(kind, *place))
        .when(here == "5p_UTR", "UTR5")
        .when(here == "3p_UTR", "UTR3")
        .when(here == "promoter", "PROMOTER")
        .otherwise("NONE")
    )
    coding = (here == "CDS") & whole & (kind == "SNV")
    decoded = joined.select(
        F.col("_vids").alias("elements"), F.col("b_name").alias("name"), here.alias("element_type"), effect.alias("effect"),
        F.when(coding, amino_acid(old)).alias("ref_aa"), F.when(coding, amino_acid(new)).alias("alt_aa"),
    )
    return laid_out(decoded).select("_x.vid", "name", "element_type", "effect", "ref_aa", "alt_aa")


def gff_of(gff: DataFrame, feature: str | None = None, source: str | None = None) -> DataFrame:
    """GFF rows of a feature type, of a source, or of both."""
    if feature is not None:
        gff = gff.where(F.col("feature") == feature)
    return gff.where(F.col("source") == source) if source is not None else gff


def linked_genes(gff: DataFrame, part: str = "CDS") -> DataFrame:
    """Parts with their transcript's and gene's regions: part -> transcript by transcript_id, transcript -> gene by gene_id.

    Of several rows of one id the first by place counts; parts without either are kept with nulls.
    """
    rows = gff.withColumns({"transcript": attribute(F.col("attributes"), "transcript_id"), "gene": attribute(F.col("attributes"), "gene_id")})

    def first(feature: str, key: str, name: str, *more: str) -> DataFrame:
        place = F.struct("start", "end")
        found = gff_of(rows, feature).groupBy("chrom", F.col(key).alias(f"_{name}")).agg(F.min(place).alias("x"), *[F.min_by(m, place).alias(f"_{m}") for m in more])
        return found.select("chrom", f"_{name}", F.col("x.start").alias(f"{name}_start"), F.col("x.end").alias(f"{name}_end"), *[f"_{m}" for m in more])

    parts = gff_of(rows, part).select("chrom", "start", "end", "strand", "transcript")
    transcripts = first("transcript", "transcript", "transcript", "gene").withColumnRenamed("_gene", "gene")
    genes = first("gene", "gene", "gene")
    own = parts.join(transcripts.withColumnsRenamed({"chrom": "_c", "_transcript": "_t"}), (F.col("chrom") == F.col("_c")) & (F.col("transcript") == F.col("_t")), "left").drop("_c", "_t")
    return own.join(genes.withColumnsRenamed({"chrom": "_c", "_gene": "_g"}), (F.col("chrom") == F.col("_c")) & (F.col("gene") == F.col("_g")), "left").drop("_c", "_g")


def children_of(gff: DataFrame, parent_key: str = "Parent", id_key: str = "ID") -> DataFrame:
    """(parent, child) pairs by the comma list of parents each row names."""
    named = gff.withColumns({"id": attribute(F.col("attributes"), id_key), "parents": F.split(attribute(F.col("attributes"), parent_key), ",")})
    flat = named.select(F.col("id").alias("child"), "chrom", "start", "end", "feature", F.explode("parents").alias("parent"))
    return flat.join(named.select(F.col("id").alias("parent"), F.col("feature").alias("parent_feature")), "parent")
