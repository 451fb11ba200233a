"""Genotype matrices in long form: encoding on the track axis, allele and carrier counts, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dosage, genotype_alleles, haplotype_allele, haplotype_code, names_match, presence
from .overlap import BIN, points_in, prefixed
from .regions import merge
from .tracks import deleted_spans, track_position, variant_kind
from .translate import _containing

EXISTENCE, GENO, HAPLO = 0, 1, 2


def encoded(a0: Column, a1: Column, encoding: int) -> Column:
    """0/1 presence, 0..2 dosage, or 2 a0 + a1; missing is null (-1 for haplotypes)."""
    return {EXISTENCE: presence, GENO: dosage, HAPLO: haplotype_code}[encoding](a0, a1)


def long_genotypes(vcf: DataFrame, samples: list[str], encoding: int = GENO) -> DataFrame:
    """One row per variant and sample from ``format`` and ``calls`` (array of sample fields)."""
    at = F.array_position(F.split("format", ":"), "GT")
    flat = vcf.where(at > 0).select(
        "chrom", "pos", "id", "ref", "alt", at.cast("int").alias("_gt"), F.posexplode("calls").alias("sample_idx", "_call")
    )
    alleles = genotype_alleles(F.try_element_at(F.split("_call", ":"), F.col("_gt")))
    names = F.array(*[F.lit(s) for s in samples])
    return (
        flat.withColumn("_g", alleles)
        .withColumn("sample", F.try_element_at(names, F.col("sample_idx") + 1))
        .select("chrom", "pos", "id", "ref", "alt", "sample_idx", "sample", encoded(F.col("_g.a0"), F.col("_g.a1"), encoding).alias("code"), F.col("_g.phased").alias("phased"))
    )


def snv_matrix(genotypes: DataFrame, variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """(chrom, track_pos, alt, sample, code): codes of equal keys are united bitwise.

    ``genotypes``: vid, sample, dosage; ``vid`` must name one variant (a VCF's ID column does not: see
    :func:`encoded_snvs`).  Only variants with a carrier go through the interval join.
    """
    called = genotypes.where("dosage > 0")
    cells, codes = _united(_snv_cells(called, variants, track, size), ["chrom", "track_pos", "alt"], called)
    return cells.join(codes, "_vids").select("chrom", "track_pos", "alt", "sample", "code")


def snv_counts(genotypes: DataFrame, variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """(chrom, track_pos, alt, n): the summed codes of :func:`snv_matrix`, which is not laid out for it."""
    called = genotypes.where("dosage > 0")
    cells, codes = _united(_snv_cells(called, variants, track, size), ["chrom", "track_pos", "alt"], called)
    return cells.join(codes.groupBy("_vids").agg(F.sum("code").alias("n")), "_vids").drop("_vids")


def _snv_cells(called: DataFrame, variants: DataFrame, track: DataFrame, size: int) -> DataFrame:
    snvs = variants.where(variant_kind(F.col("ref"), F.col("alt")) == "SNV")
    carried = snvs.join(called.select("vid").distinct(), "vid", "left_semi")
    return points_in(carried, track, size=size).select("chrom", track_position(F.col("pos")).alias("track_pos"), "alt", "vid")


def _united(cells: DataFrame, keys: list[str], called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with the set of their variants, and for each set (sample, code) united bitwise.

    Many cells hold the same variants: a sample's code is found once per set, and no row per cell and
    sample is dealt out or grouped.
    """
    grouped = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("vid")).alias("_vids"))
    members = grouped.select("_vids").distinct().select("_vids", F.explode("_vids").alias("vid"))
    return grouped, members.join(called, "vid").groupBy("_vids", "sample").agg(F.bit_or("dosage").alias("code"))


def matrix_deletions(variants: DataFrame) -> DataFrame:
    """Deletions a matrix takes, those of one base of ALT and more of REF, with start and end of what is deleted."""
    return deleted_spans(variants.where(F.length("alt") == 1))


def deletion_matrix(genotypes: DataFrame, variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """(chrom, track_pos, sample, code), one row per deleted base of deletions inside an element."""
    called = genotypes.where("dosage > 0")
    spans = matrix_deletions(variants).select("chrom", "start", "end", "vid", "ref", "alt").join(called.select("vid").distinct(), "vid", "left_semi")
    inside = _containing(spans, track, size)
    first = F.col("track_offset") + F.col("start") - F.col("r_start")
    bases = inside.select("chrom", "vid", F.explode(F.sequence(first, first + F.col("end") - F.col("start"))).alias("track_pos"))
    cells, codes = _united(bases, ["chrom", "track_pos"], called)
    return cells.join(codes, "_vids").select("chrom", "track_pos", "sample", "code")


def _coded_samples(hits: DataFrame, keys: list[str], samples: list[str], encoding: int) -> DataFrame:
    """Spreads rows with ``format`` and ``calls`` over samples and unites the codes of equal keys."""
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    flat = hits.where(at > 0).select(*keys, at.alias("_gt"), F.posexplode("calls").alias("_i", "_call"))
    alleles = flat.withColumn("_g", genotype_alleles(F.try_element_at(F.split("_call", ":"), F.col("_gt"))))
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    coded = alleles.select(*keys, F.try_element_at(names, F.col("_i") + 1).alias("sample"), encoded(F.col("_g.a0"), F.col("_g.a1"), encoding).alias("code"))
    return coded.where("code > 0 AND sample IS NOT NULL").groupBy(*keys, "sample").agg(F.bit_or("code").alias("code"))


def encoded_snvs(vcf: DataFrame, samples: list[str], track: DataFrame, encoding: int = GENO, size: int = BIN) -> DataFrame:
    """The SNV matrix of VCF rows (chrom, pos, ref, alt, format, calls).

    Rows carry their own calls, so no identifier is needed and nothing is joined back.  Those of one place and
    allele are united before the interval join: a track position belongs to one element and base, so behind
    the join no two rows share a cell.  ``track`` is an axis.
    """
    snvs = vcf.where(variant_kind(F.col("ref"), F.col("alt")) == "SNV").select("chrom", "pos", "alt", "format", "calls")
    # Sample columns are cut for rows inside elements only; merged ones hold a row once.
    inside = points_in(snvs, merge(track.select("chrom", "start", "end")), size=size)
    coded = _coded_samples(inside, ["chrom", "pos", "alt"], samples, encoding)
    carriers = coded.groupBy("chrom", "pos", "alt").agg(F.collect_list(F.struct("sample", "code")).alias("_carriers"))
    hits = points_in(carriers, track, size=size).select("chrom", track_position(F.col("pos")).alias("track_pos"), "alt", F.explode("_carriers").alias("_x"))
    return hits.select("chrom", "track_pos", "alt", "_x.sample", "_x.code")


def encoded_deletions(vcf: DataFrame, samples: list[str], track: DataFrame, encoding: int = GENO, size: int = BIN // 4) -> DataFrame:
    """The deletion matrix of VCF rows, one row per deleted base and carrier, deletions inside an element only.

    Deletions of one place are united before the interval join, and a base meets the elements once for all the
    deletions it lies in (:func:`_deleted_bases`): behind the join no two rows share a cell.  ``track`` is an axis.
    Bases are many and close, so their bins (``size``) are smaller than others.
    """
    spans = matrix_deletions(vcf).select("chrom", "start", "end", "format", "calls")
    # Sample columns are cut for deletions inside islands of elements only; of the elements of one start the longest says enough.
    islands = merge(track.groupBy("chrom", "start").agg(F.max("end").alias("end")))
    inside = points_in(spans, islands, position="start").where(F.col("end") <= F.col("r_end"))
    bases = _deleted_bases(_coded_samples(inside, ["chrom", "start", "end"], samples, encoding))
    hits = points_in(bases, track, size=size).where("r_start > coalesce(_above, r_start - 1) AND r_start <= _first AND r_end >= least(_end1, _end2)")
    codes = [F.when(F.col(f"_end{bit}") <= F.col("r_end"), bit).otherwise(0) for bit in (1, 2)]
    cells = hits.select("chrom", track_position(F.col("pos")).alias("track_pos"), codes[0].bitwiseOR(codes[1]).alias("code"), "_samples")
    return cells.select("chrom", "track_pos", F.explode("_samples").alias("sample"), "code")


def _deleted_bases(coded: DataFrame) -> DataFrame:
    """Deleted bases (chrom, pos) of deletions (chrom, start, end, sample, code), with their ``_samples``.

    An element holds the deletions that start at or behind its start and end at or before its end.  So a base has a
    row per start of its deletions, for elements that start there or before but behind ``_above``, the start next
    before (null: none).  Bit 1 and 2 of the code, which has no more, are set from the element's end ``_end1`` and
    ``_end2`` on (null: never).
    """
    bases = coded.withColumn("pos", F.explode(F.sequence("start", "end")))
    ends = {bit: F.min(F.when(F.col("code").bitwiseAND(F.lit(bit)) != 0, F.col("end"))).alias(f"_end{bit}") for bit in (1, 2)}
    starts = bases.groupBy("chrom", "pos", "sample", F.col("start").alias("_first")).agg(*ends.values())
    order = Window.partitionBy("chrom", "pos", "sample").orderBy(F.desc("_first"))
    behind = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.select("chrom", "pos", "sample", "_first", F.lead("_first").over(order).alias("_above"), *[F.min(f"_end{bit}").over(behind).alias(f"_end{bit}") for bit in (1, 2)])
    return placed.groupBy("chrom", "pos", "_first", "_above", "_end1", "_end2").agg(F.collect_list("sample").alias("_samples"))


def allele_counts(genotypes: DataFrame) -> DataFrame:
    """Per variant: summed dosage, carriers and samples called."""
    return genotypes.groupBy("vid").agg(
        F.sum("dosage").alias("allele_count"), F.sum((F.col("dosage") > 0).cast("long")).alias("carriers"), F.count("dosage").alias("n_called")
    )


def matrix_counts(matrix: DataFrame, interest: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """Allele count per variant of interest (chrom, pos, alt, vid): sum of the codes at its track positions."""
    return counts_of_interest(matrix.groupBy("chrom", "track_pos", "alt").agg(F.sum("code").alias("n")), interest, track, size)


def counts_of_interest(counts: DataFrame, interest: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """Allele count per variant of interest inside an element, from counts (chrom, track_pos, alt, n).

    Counts go back to their genome position and are summed there; variants never meet all the elements
    they lie in.
    """
    spans = track.select("chrom", F.col("track_offset").alias("start"), (F.col("track_offset") + F.col("end") - F.col("start")).alias("end"), F.col("start").alias("first"))
    placed = points_in(counts, spans, position="track_pos", size=size).select("chrom", (F.col("r_first") + F.col("track_pos") - F.col("r_start")).alias("pos"), "alt", "n")
    sums = placed.groupBy("chrom", "pos", "alt").agg(F.sum("n").alias("n"))
    places = interest.select("chrom", "pos").distinct()
    inside = points_in(places, merge(track.select("chrom", "start", "end")), size=size).select("chrom", "pos")
    asked = interest.join(inside, ["chrom", "pos"], "left_semi").join(sums, ["chrom", "pos", "alt"], "left")
    return asked.groupBy("vid").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("allele_count"))


def deletion_carriers(matrix: DataFrame, interest: DataFrame) -> DataFrame:
    """Carriers of exactly the deletion [start, end] of each (chrom, start, end, vid) of interest.

    A sample counts with its code if all inner positions carry one and the same non-zero code and
    neither flank carries it.  ``matrix``: chrom, pos, sample, code.
    """
    spots = interest.withColumn("pos", F.explode(F.sequence(F.col("start") - 1, F.col("end") + 1)))
    joined = spots.join(matrix.where("code <> 0"), ["chrom", "pos"])
    inner = F.col("pos").between(F.col("start"), F.col("end"))
    per = joined.groupBy("vid", "start", "end", "sample").agg(
        F.min(F.when(inner, F.col("code"))).alias("low"),
        F.max(F.when(inner, F.col("code"))).alias("high"),
        F.sum(inner.cast("int")).alias("n"),
        F.coalesce(F.max(F.when(F.col("pos") < F.col("start"), F.col("code"))), F.lit(0)).alias("left"),
        F.coalesce(F.max(F.when(F.col("pos") > F.col("end"), F.col("code"))), F.lit(0)).alias("right"),
    )
    exact = (F.col("low") == F.col("high")) & (F.col("n") == F.col("end") - F.col("start") + 1)
    exact &= (F.col("low") != F.col("left")) & (F.col("low") != F.col("right"))
    counted = per.where(exact).groupBy("vid").agg(F.sum("low").alias("allele_count"), F.count(F.lit(1)).alias("carriers"))
    return interest.select("vid").join(counted, "vid", "left").select(
        "vid", F.coalesce("allele_count", F.lit(0)).cast("long").alias("allele_count"), F.coalesce("carriers", F.lit(0)).cast("long").alias("carriers")
    )


def haplotype_matrix(vcf: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, name, codes) of VCF rows: an array of haplotype codes per variant, missing -1.

    Rows in which any genotype has no two alleles are dropped whole.  With ``bases`` (chrom, pos,
    base) rows whose REF does not begin with the base there are dropped; see :func:`wrong_references`.
    """
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    fields = F.transform("calls", lambda c: F.try_element_at(F.split(c, ":"), at))
    parsed = vcf.where(at > 0).withColumn("_g", F.transform(fields, genotype_alleles))
    whole = parsed.where(F.forall(fields, lambda g: F.coalesce(F.rlike(g, F.lit("^(\\d+|\\.)[|/](\\d+|\\.)$")), F.lit(False))))
    if bases is not None:
        known = bases.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("base").alias("_b"))
        whole = whole.join(known, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.upper(F.substring("ref", 1, 1)) == F.upper("_b")), "left_semi")
    codes = F.transform("_g", lambda g: haplotype_code(g["a0"], g["a1"]))
    return whole.select("chrom", "pos", F.concat_ws("_", "id", "ref", "alt").alias("name"), codes.alias("codes"))


def wrong_references(vcf: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows whose REF does not begin with the genome's base, with that base: a validation query."""
    known = bases.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), "base")
    joined = vcf.join(known, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")))
    return joined.where(F.upper(F.substring("ref", 1, 1)) != F.upper("base")).drop("_c", "_p")


def haplotypes(coded: DataFrame, code: str = "code") -> DataFrame:
    """Adds hap0 and hap1, the alleles of both haplotypes."""
    return coded.withColumns({"hap0": haplotype_allele(F.col(code), 0), "hap1": haplotype_allele(F.col(code), 1)})


def genotype_text(code: Column, phased: bool = True) -> Column:
    """VCF GT of a haplotype code: first haplotype first; missing is ``.``."""
    sign = "|" if phased else "/"
    first, second = F.shiftright(code, 1).bitwiseAND(F.lit(1)), code.bitwiseAND(F.lit(1))
    return F.when(code < 0, F.lit(f".{sign}.")).otherwise(F.concat(first.cast("string"), F.lit(sign), second.cast("string")))


def merged_cohorts(a: DataFrame, b: DataFrame, by_name: bool = False) -> DataFrame:
    """Samples of two cohorts side by side for variants of equal place: chrom, pos, name, codes (arrays joined)."""
    right = prefixed(b, "b_")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("pos") == F.col("b_pos"))
    if by_name:
        on &= names_match(F.col("name"), F.col("b_name"))
    return a.join(right, on).select("chrom", "pos", "name", F.concat("codes", "b_codes").alias("codes"))


def sub_samples(matrix: DataFrame, have: list[str], want: list[str]) -> DataFrame:
    """Codes of the wanted samples in that order; samples that are not there are -1."""
    places = [have.index(s) + 1 if s in have else 0 for s in want]
    picked = [F.try_element_at("codes", F.lit(p)) if p else F.lit(-1) for p in places]
    return matrix.withColumn("codes", F.array(*[F.coalesce(p, F.lit(-1)).cast("int") for p in picked]))


def listed_variants(matrix: DataFrame, listed: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Rows of the matrix at the listed places; with ``n_samples``, absent places are rows of -1."""
    places = listed.select("chrom", "pos").distinct()
    found = matrix.join(places, ["chrom", "pos"], "left_semi")
    if n_samples is None:
        return found
    gone = places.join(matrix, ["chrom", "pos"], "left_anti")
    blank = F.array_repeat(F.lit(-1).cast("int"), n_samples)
    return found.select("chrom", "pos", "codes").unionByName(gone.select("chrom", "pos", blank.alias("codes")))


def duplicate_places(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def packed_codes(codes: Column, bits: int) -> Column:
    """Sample codes as hex text of little-endian bytes, ``bits`` per sample."""
    per = 8 // bits
    padded = F.concat(codes, F.array_repeat(F.lit(0).cast("int"), F.pmod(-F.size(codes), F.lit(per))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(codes) / per).cast("int") - 1))

    def byte(i: Column) -> Column:
        parts = [F.shiftleft(F.greatest(F.lit(0), F.try_element_at(padded, (i * per + j + 1).cast("int"))), bits * j) for j in range(per)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return F.lpad(F.hex(out), 2, "0")

    return F.when(F.size(codes) == 0, F.lit("")).otherwise(F.array_join(F.transform(starts, byte), ""))
