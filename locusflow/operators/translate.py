"""Annotated products turned into codon changes and consequence terms.

Gene-strand logic is in ``oriented``: sequences are read on their strand before any codon is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotide import amino_acid, oriented
from ..schemas import context_mask
from .overlap import BIN, points_in, points_in_elements
from .tracks import CHUNK, deleted_spans, impact_text, in_blocks, laid_out, neighbourhood, placed_product, variant_kind


def _codon(seq: Column, frame: Column) -> Column:
    """Codon that starts at index 3 - frame (from 0)."""
    return F.substring(seq, (F.lit(4) - frame).cast("int"), F.lit(3))


def translate_snv(variants: DataFrame, track: DataFrame, product: DataFrame, size: int = BIN) -> DataFrame:
    """SNVs with their element, amino acids and terms.

    ``product`` has chrom, track_pos, alt, frame, neigh, mask, or is one of ``placed_impacts``; neigh may come with the
    variants instead.  Frame and neighbourhood are read on the element's strand; a codon with an unknown base has a
    null amino acid.
    """
    snvs, side = _sides(variants.where(variant_kind(F.col("ref"), F.col("alt")) == "SNV"), track, product, ["alt", "frame", "mask"], size)
    joined = snvs.join(side.withColumn("impact", impact_text(F.col("mask"))), ["chrom", "pos", "alt"])
    left, right = F.substring("neigh", 1, 3), F.substring("neigh", 4, 3)
    before = oriented(F.concat(left, F.col("ref"), right), F.col("strand"))
    after = oriented(F.concat(left, F.col("alt"), right), F.col("strand"))
    decoded = joined.select(
        "chrom",
        "pos",
        "vid",
        "ref",
        "alt",
        "strand",
        amino_acid(_codon(before, F.col("frame"))).alias("ref_aa"),
        amino_acid(_codon(after, F.col("frame"))).alias("alt_aa"),
        "impact",
        "elements",
    )
    return laid_out(decoded).select("chrom", "pos", "vid", "ref", "alt", "_x.element", "strand", "_x.track_pos", "ref_aa", "alt_aa", "impact")


def _sides(variants: DataFrame, track: DataFrame, product: DataFrame, kept: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Variants and the product by place; one of them has neigh."""
    own = ["neigh"] if "neigh" in variants.columns else []
    side = placed_product(product, track, [*kept, *([] if own else ["neigh"])], size)
    return variants.select("chrom", "pos", "vid", "ref", "alt", *own), side


def _joined(terms: list[Column], nominal: str) -> Column:
    present = F.filter(F.array(*terms), lambda t: t.isNotNull())
    return F.when(F.size(present) == 0, F.lit(nominal + ";")).otherwise(F.concat(F.array_join(present, ";"), F.lit(";")))


def _has(mask: Column, context: str) -> Column:
    return mask.bitwiseAND(F.lit(context_mask(context))) != 0


def translate_insertions(variants: DataFrame, track: DataFrame, product: DataFrame, size: int = BIN) -> DataFrame:
    """Insertions whose flanking bases both lie in the element.

    The junction sequence is the left three bases, the inserted ones and the right three; codons are
    scanned from 3 - frame for the first STOP.  ``product``: chrom, track_pos, frame, neigh, mask, or one of
    ``placed_impacts``; neigh may come with the variants instead.
    """
    ins, side = _sides(variants.where(variant_kind(F.col("ref"), F.col("alt")) == "INS"), track, product, ["frame", "mask"], size)
    joined = ins.join(side.withColumnRenamed("frame", "stored"), ["chrom", "pos"]).withColumn("frame", (F.col("stored") + 1) % 3)
    left, right = F.substring("neigh", 1, 3), F.substring("neigh", 4, 3)
    inserted = F.substring(F.col("alt"), F.length("ref") + 1, F.length("alt"))
    strand = F.col("strand")
    joined = joined.withColumn("_old", oriented(F.concat(left, right), strand))
    joined = joined.withColumn("_new", oriented(F.concat(left, inserted, right), strand))
    joined = joined.withColumn("ref_aa", amino_acid(_codon(F.col("_old"), F.col("frame"))))
    starts = F.sequence(F.lit(4) - F.col("frame"), F.greatest(F.lit(4) - F.col("frame"), F.length("_new") - 2), F.lit(3))
    stop = F.exists(starts, lambda i: F.substring(F.col("_new"), i.cast("int"), F.lit(3)).isin("TAA", "TAG", "TGA"))
    joined = joined.withColumn("_stop", stop)
    mask, old_stop = F.col("mask"), F.coalesce(F.col("ref_aa") == "STOP", F.lit(False))
    size_of = F.length("alt") - F.length("ref")
    cds = _has(mask, "CDS")
    terms = [
        F.when(cds, F.when(size_of % 3 == 0, "inframe_insertion").otherwise("frameshift_variant")),
        F.when(cds & F.col("_stop") & ~old_stop, "stop_gained"),
        F.when(_has(mask, "5p_UTR"), "5_prime_UTR_variant"),
        F.when(_has(mask, "Intron"), "intron_variant"),
        F.when(_has(mask, "3p_UTR"), "3_prime_UTR_variant"),
        F.when(_has(mask, "Start_Codon"), "start_lost"),
        F.when(_has(mask, "Stop_Codon"), "stop_lost"),
        F.when(_has(mask, "Stop_Codon") & F.col("_stop") & old_stop, "stop_retained_variant"),
        F.when(_has(mask, "Splice_Region"), "splice_region_variant"),
        F.when(_has(mask, "Splice_Acceptor"), "splice_acceptor_variant"),
        F.when(_has(mask, "Splice_Donor"), "splice_donor_variant"),
    ]
    decoded = joined.select(
        "chrom",
        "pos",
        (F.col("pos") + size_of - 1).cast("long").alias("end"),
        "vid",
        "strand",
        "ref_aa",
        _joined(terms, "NOMINAL_IMPACT").alias("impact"),
        "elements",
    )
    return laid_out(decoded).where("_x.more >= 1").select("chrom", "pos", "end", "vid", "_x.element", "strand", "ref_aa", "impact")


def translate_deletions(variants: DataFrame, track: DataFrame, product: DataFrame, size: int = BIN, compat: bool = False) -> DataFrame:
    """Deletions wholly inside an element.

    One ordered array of the deleted bases per (variant, element) carries frame, neighbourhood and
    mask; contexts are counted over it.  ``compat`` keeps the short historical term spellings.
    ``product``: chrom, track_pos, frame, neigh, mask.
    """
    spans = deleted_spans(variants).select("chrom", "start", "end", "vid", "ref", "alt")
    inside = _containing(spans, track, size)
    first = F.col("track_offset") + F.col("start") - F.col("r_start")
    bases = inside.withColumn("track_pos", F.explode(F.sequence(first, first + F.col("end") - F.col("start"))))
    bases = bases.withColumn("i", (F.col("track_pos") - F.col("track_offset") + F.col("r_start") - F.col("start")).cast("int"))
    known = bases.join(product.select("chrom", "track_pos", "frame", "neigh", "mask"), ["chrom", "track_pos"], "left")
    # A deletion is decoded if any of its bases is annotated; bases without annotation have no context.
    item = F.struct("i", F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("frame", F.lit(0)).alias("frame"), F.coalesce("neigh", F.lit("NNNNNN")).alias("neigh"))
    keys = ["chrom", "vid", "start", "end", "ref", "alt", "name", "strand", "r_start", "track_offset"]
    grouped = known.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("b"), F.count("mask").alias("annotated")).where("annotated > 0")
    return _deletions(grouped, compat).select(*_DELETION[:4], F.col("name").alias("element"), *_DELETION[4:])


#: Columns of translated deletions but the element.
_DELETION = ["chrom", "start", "end", "vid", "strand", "ref_aa", "del_aa", "del_aa_alt", "impact"]


def translate_deletions_placed(
    variants: DataFrame, track: DataFrame, annotations: DataFrame, chunks: DataFrame, chunk: int = CHUNK, size: int = BIN, compat: bool = False
) -> DataFrame:
    """:func:`translate_deletions` with annotations by place and element instead of a product.

    ``annotations``: chrom, pos, element, mask, frame, one row per place and element, which stands for every region
    of the element over the place.  What is annotated of a deletion is then the same in all regions of a name and,
    mostly, of many: names are found once per distinct span, those of equal bases and strand share a row, deletions
    are decoded once per such row, and elements are laid out last.  No pair of deletion and element is grouped.
    """
    span = ["chrom", "start", "end"]
    spans = deleted_spans(variants).select(*span, "vid", "ref", "alt")
    asked = spans.select(*span).distinct()
    placed = annotations.where("element IS NOT NULL").groupBy("chrom", "pos", "mask", "frame").agg(F.collect_list("element").alias("names"))
    placed = neighbourhood(placed, chunks, chunk=chunk)
    bases = asked.withColumn("pos", F.explode(F.sequence("start", "end")))
    item = F.struct((F.col("pos") - F.col("start")).cast("int").alias("i"), "mask", "frame", "neigh", "names")
    known = bases.join(placed, ["chrom", "pos"]).groupBy(*span).agg(F.collect_list(item).alias("_known"))

    over = points_in(asked.withColumn("pos", F.col("start")), track.select("chrom", "start", "end", "name", "strand"), size=size).where("end <= r_end")
    over = over.groupBy(*span, F.col("r_name").alias("name"), F.col("r_strand").alias("strand")).agg(F.count(F.lit(1)).alias("_n"))
    listed = in_blocks(over, span, ["name", "strand"]).groupBy(*span, "_block").agg(F.collect_list(F.struct("name", "strand", "_n")).alias("_names"))
    each = known.join(listed, span).withColumn("_x", F.explode("_names"))
    own = F.filter("_known", lambda k: F.array_contains(k["names"], F.col("_x.name")))
    each = each.select(*span, "_block", "_x.name", "_x.strand", "_x._n", F.transform(own, lambda k: F.struct(k["i"].alias("i"), k["mask"].alias("mask"), k["frame"].alias("frame"), k["neigh"].alias("neigh"))).alias("_own"))
    # A deletion is decoded if any of its bases is annotated; bases without annotation have no context.
    alike = each.where(F.exists("_own", lambda k: k["mask"].isNotNull())).withColumn("_own", F.array_sort("_own"))
    alike = alike.groupBy(*span, "_block", "strand", "_own").agg(F.flatten(F.collect_list(F.array_repeat("name", F.col("_n")))).alias("elements"))
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("frame"), F.lit("NNNNNN").alias("neigh"))

    def base(i: Column) -> Column:
        found = F.coalesce(F.try_element_at(F.filter("_own", lambda x: x["i"] == i), F.lit(1)), none)
        return F.struct(i.alias("i"), F.coalesce(found["mask"], F.lit(0)).alias("mask"), F.coalesce(found["frame"], F.lit(0)).alias("frame"), F.coalesce(found["neigh"], F.lit("NNNNNN")).alias("neigh"))

    alike = alike.select(*span, "strand", "elements", F.transform(F.sequence(F.lit(0), (F.col("end") - F.col("start")).cast("int")), base).alias("b"))
    decoded = _deletions(spans.join(alike, span), compat).select(*_DELETION, "elements")
    return laid_out(decoded).select(*_DELETION[:4], F.col("_x").alias("element"), *_DELETION[4:])


def _deletions(grouped: DataFrame, compat: bool) -> DataFrame:
    """Amino acids and impact of rows with ref, alt, strand and b, the ordered array of the deleted bases."""
    cds_bits = F.lit(context_mask("CDS"))
    deleted = F.substring("ref", F.length("alt") + 1, F.length("ref"))
    grouped = grouped.withColumn("_seq", deleted)
    grouped = grouped.withColumn("_cds", F.filter("b", lambda x: x["mask"].bitwiseAND(cds_bits) != 0))
    has_cds = F.size("_cds") > 0
    head, tail = F.try_element_at("_cds", F.lit(1)), F.try_element_at("_cds", F.lit(-1))
    lost = F.array_join(F.transform("_cds", lambda x: F.substring(F.col("_seq"), x["i"] + 1, F.lit(1))), "")
    old = F.concat(F.substring(head["neigh"], 1, 3), lost, F.substring(tail["neigh"], 4, 3))
    new = F.concat(F.substring(F.element_at("b", 1)["neigh"], 1, 3), F.substring(F.element_at("b", -1)["neigh"], 4, 3))
    frame = F.when(F.col("strand") == "-", tail["frame"]).otherwise(head["frame"])
    grouped = grouped.withColumns({"_old": oriented(old, F.col("strand")), "_new": oriented(new, F.col("strand")), "_frame": frame})
    other = (F.col("_frame") + 1) % 3
    absent = F.lit("-")
    grouped = grouped.withColumns(
        {
            "ref_aa": F.when(has_cds, amino_acid(_codon(F.col("_old"), F.col("_frame")))).otherwise(absent),
            "del_aa": F.when(has_cds, amino_acid(_codon(F.col("_new"), F.col("_frame")))).otherwise(absent),
            "del_aa_alt": F.when(has_cds, amino_acid(_codon(F.col("_new"), other))).otherwise(absent),
        }
    )

    def hit(context: str) -> Column:
        bits = F.lit(context_mask(context))
        return F.exists("b", lambda x: x["mask"].bitwiseAND(bits) != 0)

    stops = F.coalesce((F.col("ref_aa") == "STOP") & (F.col("del_aa") == "STOP"), F.lit(False))
    gained = has_cds & F.coalesce((F.col("ref_aa") != "STOP") & (F.col("del_aa") == "STOP"), F.lit(False))
    same_start = F.coalesce((F.col("ref_aa") == "Met") & (F.col("del_aa") == "Met"), F.lit(False))
    terms = [
        F.when(has_cds, F.when(F.size("_cds") % 3 == 0, "inframe_deletion").otherwise("frameshift_variant")),
        F.when(hit("Splice_Region"), "splice_region" if compat else "splice_region_variant"),
        F.when(hit("Splice_Acceptor"), "splice_acceptor_variant"),
        F.when(hit("Splice_Donor"), "splice_donor_variant"),
        F.when(hit("Start_Codon"), "start_lost"),
        F.when(hit("Start_Codon") & same_start, "start_retained" if compat else "start_retained_variant"),
        F.when(hit("Stop_Codon"), "stop_lost"),
        F.when(hit("Stop_Codon") & stops, "stop_retained_variant"),
        F.when(hit("Intron"), "intron_variant"),
        F.when(hit("5p_UTR"), "5_prime_UTR_variant"),
        F.when(hit("3p_UTR"), "3_prime_UTR_variant"),
        F.when(gained, "stop_gained"),
    ]
    return grouped.withColumn("impact", _joined(terms, "IMPACT_NOMINAL" if compat else "NOMINAL_IMPACT"))


def with_cds_neighbours(impacts: DataFrame, axis: DataFrame, cds: DataFrame, chunks: DataFrame, chunk: int = CHUNK, size: int = BIN) -> DataFrame:
    """Adds cds_neigh: three bases on either side in the element's spliced CDS, read on its strand; N beyond its ends.

    ``impacts`` are rows of an impact track with neigh; ``cds`` the coding regions, named by element.
    Positions outside their element's CDS are left out.
    """
    from .sequence import extract_chunked, running_frame, spliced

    exons = cds.select("chrom", "start", "end", "name", "strand").withColumn("row_id", F.xxhash64("chrom", "name", "start", "end"))
    transcripts = spliced(extract_chunked(exons, chunks, "row_id", chunk), "name").select(F.col("name").alias("_element"), F.col("seq").alias("_cds"))
    before = running_frame(exons, "name").select("chrom", "start", "end", "name", "strand", F.col("transcript_before").alias("before"))
    spans = axis.select(
        "chrom", F.col("track_offset").alias("start"), (F.col("track_offset") + F.col("end") - F.col("start")).alias("end"), "name", F.col("start").alias("first")
    )
    kept = ["chrom", "track_pos", "mask", "frame", "pos", "neigh"]
    at = points_in(impacts.select(*kept), spans, position="track_pos", size=size)
    at = at.select(*kept, F.col("r_name").alias("element"), (F.col("r_first") + F.col("track_pos") - F.col("r_start")).alias("genome"))
    inside = points_in_elements(at, before, position="genome", size=size)
    offset = F.when(F.col("r_strand") == "-", F.col("r_end") - F.col("genome")).otherwise(F.col("genome") - F.col("r_start"))
    joined = inside.withColumn("_i", (F.col("r_before") + offset + 1).cast("int")).join(transcripts, F.col("element") == F.col("_element"))
    padded = F.concat(F.lit("NNN"), "_cds", F.lit("NNN"))
    around = F.concat(F.substring(padded, F.col("_i"), F.lit(3)), F.substring(padded, F.col("_i") + 4, F.lit(3)))
    return joined.select(*kept, around.alias("cds_neigh"))


def _containing(spans: DataFrame, track: DataFrame, size: int) -> DataFrame:
    """Spans with the elements that contain them: the start decides the bin, so no span is copied."""
    points = spans.withColumn("pos", F.col("start"))
    hits = points_in(points, track, size=size).where(F.col("end") <= F.col("r_end"))
    return hits.select(
        "chrom", "start", "end", "vid", "ref", "alt", F.col("r_name").alias("name"), F.col("r_strand").alias("strand"),
        F.col("r_track_offset").alias("track_offset"), F.col("r_start").alias("r_start"),
    )
