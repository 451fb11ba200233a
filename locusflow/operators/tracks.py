"""The track axis, impact and variant tracks, their product and its decoding.

Tracks are sparse: rows exist for non-zero positions only.  A key is (chrom, track_pos[, alt]);
overlapping elements give one genome base several track positions, so after the axis what is joined
by genome position lists its elements, each with its track position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import term_mask
from ..schemas import CONTEXTS, TERM_NAMES
from .overlap import BIN, overlapping, points_in, points_in_elements

#: Bases of a sequence chunk, and of the margin a chunk carries on both sides.
CHUNK = 65_536
MARGIN = 16


def axis(regions: DataFrame) -> DataFrame:
    """Adds track_offset: elements laid end to end per chromosome, positions from 1.

    A prefix sum in two levels: within stretches of the chromosome by a window, across them from one
    row per stretch, so no task sorts a whole chromosome.
    """
    from .regions import stretch

    rows = regions.where("start <= end").withColumn("_stretch", stretch()).withColumn("_n", F.col("end") - F.col("start") + 1)
    order = Window.partitionBy("chrom", "_stretch").orderBy("start", "end", F.length("name"), "name", *([F.col("row_id")] if "row_id" in regions.columns else []))
    totals = rows.groupBy("chrom", "_stretch").agg(F.sum("_n").alias("_t"))
    over = Window.partitionBy("chrom").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("chrom", "_stretch", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_inside", inside).join(totals, ["chrom", "_stretch"])
    offset = (F.lit(1) + F.col("_before") + F.col("_inside")).cast("long")
    return placed.select(*regions.columns, offset.alias("track_offset"))


def track_position(position: Column) -> Column:
    """Of a genome position inside a joined (``r_``) axis region."""
    return (F.col("r_track_offset") + position - F.col("r_start")).cast("long")


def axis_coverage(track: DataFrame) -> DataFrame:
    """Length of the axis per chromosome."""
    return track.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("axis_length"))


# ---------------------------------------------------------------- sequence chunks


def assembled(pieces: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(chrom, chunk, first, seq) from pieces of sequence (chrom, pos of the first base, seq) that do not overlap.

    The text of a chunk goes with ``margin`` bases around it, so any window of up to 2 * margin + 1
    bases is inside one row.  Missing bases are N.
    """
    last = F.col("pos") + F.length("seq") - 1
    targets = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - margin) / chunk)), F.floor((last + margin) / chunk))
    dealt = pieces.where("seq <> ''").select("chrom", "pos", "seq", last.alias("_last"), F.explode(targets).alias("chunk"))
    low = F.greatest("pos", F.col("chunk") * chunk - margin)
    high = F.least("_last", (F.col("chunk") + 1) * chunk - 1 + margin)
    dealt = dealt.where(low <= high).select(
        "chrom", "chunk", low.alias("at"), F.substring("seq", (low - F.col("pos") + 1).cast("int"), (high - low + 1).cast("int")).alias("text")
    )
    grouped = dealt.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    first = F.element_at("p", 1)["at"]
    gap = lambda x, i: F.when(i > 0, x["at"] - F.get("p", i - 1)["at"] - F.length(F.get("p", i - 1)["text"])).otherwise(F.lit(0)).cast("int")
    filled = F.array_join(F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("N"), gap(x, i)), x["text"])), "")
    return grouped.select("chrom", F.col("chunk").cast("long").alias("chunk"), first.alias("first"), filled.alias("seq"))


def chunked(bases: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """:func:`assembled` from single bases (chrom, pos, base)."""
    return assembled(bases.select("chrom", "pos", F.col("base").alias("seq")), chunk, margin)


def with_margin(chunks: DataFrame, margin: int, chunk: int = CHUNK) -> DataFrame:
    """The same chunks with another margin, taken from the neighbours' texts."""
    start = F.greatest("first", F.col("chunk") * chunk)
    end = F.least(F.col("first") + F.length("seq"), (F.col("chunk") + 1) * chunk)
    own = F.substring("seq", (start - F.col("first") + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))
    return assembled(chunks.select("chrom", start.alias("pos"), own.alias("seq")), chunk, margin)


def with_window(points: DataFrame, chunks: DataFrame, position: str, left: int, right: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the bases [position - left, position + right]; N beyond the sequence's ends.

    ``left`` and ``right`` may not pass the chunks' margin (see :func:`with_margin`).  A chunk is padded
    once, and as bytes, where a substring is a slice and not a walk from the first letter on.
    """
    keyed = points.withColumn("_chunk", F.floor(F.col(position) / chunk).cast("long"))
    padded = F.concat(F.repeat(F.lit("N"), F.lit(left)), F.col("seq"), F.repeat(F.lit("N"), F.lit(right))).cast("binary")
    side = chunks.select(F.col("chrom").alias("_c"), F.col("chunk").alias("_k"), F.col("first").alias("_first"), padded.alias("_seq"))
    joined = keyed.join(side, (F.col("chrom") == F.col("_c")) & (F.col("_chunk") == F.col("_k")), "left")
    size = left + right + 1
    start = (F.col(position) - F.col("_first") + 1).cast("int")
    window = F.substring("_seq", F.greatest(F.lit(1), start), F.greatest(F.lit(0), F.least(F.lit(size), start + size - 1))).cast("string")
    # A position before the first known base of its chunk has unknown bases on its left.
    window = F.rpad(F.when(start >= 1, window).otherwise(F.concat(F.repeat(F.lit("N"), F.least(F.lit(size), 1 - start)), window)), size, "N")
    return joined.withColumn(name, F.coalesce(window, F.lit("N" * size))).drop("_chunk", "_c", "_k", "_first", "_seq")


def neighbourhood(points: DataFrame, chunks: DataFrame, position: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds ``neigh``: the three bases before and the three behind a position."""
    wide = with_window(points, chunks, position, 3, 3, "_w", chunk)
    return wide.withColumn("neigh", F.concat(F.substring("_w", 1, 3), F.substring("_w", 5, 3))).drop("_w")


def junction(points: DataFrame, chunks: DataFrame, position: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds ``neigh`` of an insertion behind a position: the three bases up to it and the three behind it."""
    return with_window(points, chunks, position, 2, 3, "neigh", chunk)


# ---------------------------------------------------------------- annotations


def annotation_frame(cds_position: Column) -> Column:
    """(position - 1) % 3 of the leading number; 0 without one."""
    number = F.regexp_extract(cds_position.cast("string"), "^(\\d+)", 1).try_cast("long")
    return F.coalesce((number - 1) % 3, F.lit(0)).cast("int")


def insertion_frame(cds_position: Column) -> Column:
    """As :func:`annotation_frame`, but only a range ``a-b`` has a frame."""
    return F.when(F.rlike(cds_position, F.lit("^\\d+-\\d+$")), annotation_frame(cds_position)).otherwise(F.lit(0)).cast("int")


def impact_track(annotations: DataFrame, track: DataFrame, chunks: DataFrame | None = None, per_allele: bool = True, adjacent: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row per annotated (chrom, track_pos[, alt]): impact mask, frame and neighbourhood.

    ``annotations`` has chrom, pos, element, mask, frame, line_no[, alt].  Masks are united; the
    frame is that of the last line.  ``adjacent`` is for insertions: the element must also hold pos + 1,
    and the neighbourhood is that of the junction.  ``chunk`` is the size of the chunks.
    """
    keys = ["chrom", "pos", *(["alt"] if per_allele else [])]
    # A track position belongs to one element and base, so what is united per place and element needs no grouping behind the join.
    joined = points_in_elements(united_annotations(annotations, [*keys, "element"]), track)
    if adjacent:
        joined = joined.where(F.col("pos") + 1 <= F.col("r_end"))
    out = joined.select("chrom", track_position(F.col("pos")).alias("track_pos"), *keys[2:], "mask", "frame", "pos")
    if chunks is not None:
        out = (junction if adjacent else neighbourhood)(out, chunks, chunk=chunk)
    return out


def parsed_annotations(vep: DataFrame, insertions: bool = False) -> DataFrame:
    """chrom, pos, alt, element, mask, frame, line_no from annotator rows.

    ``consequence`` is an array of terms or a comma list; a location is ``chrom:pos`` or
    ``chrom:a-b``, of which the first position counts.
    """
    kind = dict(vep.dtypes)["consequence"]
    terms = F.col("consequence") if kind.startswith("array") else F.split("consequence", "[, ]+")
    frame = insertion_frame(F.col("cds_position").cast("string")) if insertions else annotation_frame(F.col("cds_position"))
    place = F.split("location", "[:-]")
    return vep.select(
        place[0].alias("chrom"),
        place[1].try_cast("long").alias("pos"),
        F.left("allele", F.lit(1)).alias("alt"),
        F.col("feature").alias("element"),
        term_mask(terms).alias("mask"),
        frame.alias("frame"),
        "line_no",
    )


def united_annotations(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """One line per ``keys``: masks are united, the frame is that of the last line."""
    return annotations.groupBy(*keys).agg(F.bit_or("mask").alias("mask"), F.max_by("frame", "line_no").alias("frame"), F.max("line_no").alias("line_no"))


def unmatched_annotations(annotations: DataFrame, track: DataFrame) -> DataFrame:
    """Annotation lines whose position lies in no region of their element."""
    found = points_in_elements(annotations, track).select("line_no").distinct()
    return annotations.join(found, "line_no", "left_anti")


# ---------------------------------------------------------------- variant tracks


def variant_kind(ref: Column, alt: Column) -> Column:
    """SNV, INS, DEL or MNV by the lengths."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(r < a, "INS").when(r > a, "DEL").otherwise("MNV")


def snv_track(variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """Distinct (chrom, track_pos, alt) of SNVs inside elements."""
    hits = points_in(variants.where(variant_kind(F.col("ref"), F.col("alt")) == "SNV"), track, size=size)
    return hits.select("chrom", track_position(F.col("pos")).alias("track_pos"), "alt").distinct()


def insertion_track(variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """Distinct (chrom, track_pos) of insertions whose two flanking bases lie in the element."""
    hits = points_in(variants.where(variant_kind(F.col("ref"), F.col("alt")) == "INS"), track, size=size)
    return hits.where("pos + 1 <= r_end").select("chrom", track_position(F.col("pos")).alias("track_pos")).distinct()


def deleted_spans(variants: DataFrame) -> DataFrame:
    """start and end of the deleted bases of each deletion; the anchor base stays."""
    dels = variants.where(variant_kind(F.col("ref"), F.col("alt")) == "DEL")
    gone = F.length("ref") - F.length("alt")
    start = F.col("pos") + F.length("alt")
    return dels.withColumns({"start": start.cast("long"), "end": (start + gone - 1).cast("long")})


def deletion_track(variants: DataFrame, track: DataFrame, size: int = BIN) -> DataFrame:
    """Distinct (chrom, track_pos) of deleted bases inside elements; partial overlap counts."""
    spans = deleted_spans(variants)
    pairs = overlapping(track, spans, size=size)
    base = F.explode(F.sequence("o_start", "o_end"))
    return pairs.select("chrom", "start", "track_offset", base.alias("base")).select(
        "chrom", (F.col("track_offset") + F.col("base") - F.col("start")).cast("long").alias("track_pos")
    ).distinct()


def elements_hit(variants: DataFrame, elements: DataFrame, size: int = BIN) -> DataFrame:
    """Elements that overlap any variant's reference bases, of any kind."""
    from .overlap import hit_by

    spans = variants.select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).cast("long").alias("end"))
    return hit_by(elements, spans, size=size)


def equal_length_variants(variants: DataFrame) -> DataFrame:
    """Multi-base substitutions, which are in no track."""
    return variants.where(variant_kind(F.col("ref"), F.col("alt")) == "MNV")


def placed_product(product: DataFrame, track: DataFrame, kept: list[str], size: int = BIN) -> DataFrame:
    """A product back on the genome: chrom, pos, strand, ``kept`` and ``elements`` (see :func:`_listed`).

    One made by :func:`placed_impacts` is taken as it is.
    """
    if "elements" in product.columns:
        return product
    spans = track.select(
        "chrom", F.col("track_offset").alias("start"), (F.col("track_offset") + F.col("end") - F.col("start")).alias("end"), F.col("start").alias("first"), "name", "strand"
    )
    placed = points_in(product.select("chrom", "track_pos", *kept), spans, position="track_pos", size=size)
    place = (F.col("r_first") + F.col("track_pos") - F.col("r_start")).cast("long")
    return _listed(placed.withColumns({"pos": place, "_more": F.col("r_end") - F.col("track_pos")}), kept)


def placed_impacts(annotations: DataFrame, track: DataFrame, per_allele: bool = True) -> DataFrame:
    """:func:`impact_track` by place: chrom, pos, strand[, alt], mask, frame and ``elements`` (see :func:`_listed`)."""
    keys = ["chrom", "pos", *(["alt"] if per_allele else []), "element"]
    joined = points_in_elements(united_annotations(annotations, keys), track)
    return _listed(joined.withColumns({"track_pos": track_position(F.col("pos")), "_more": F.col("r_end") - F.col("pos")}), [*keys[2:-1], "mask", "frame"])


def _listed(placed: DataFrame, kept: list[str]) -> DataFrame:
    """Rows of one place, strand and kept values with an array of their elements: name, track_pos and the bases that follow (more).

    What depends on these alone is then worked out once and not for each pair of variant and element.  A row holds
    elements of one block of the track only, so its length has a bound.
    """
    item = F.struct(F.col("r_name").alias("element"), "track_pos", F.col("_more").alias("more"))
    rows = placed.select("chrom", "pos", F.col("r_strand").alias("strand"), *kept, F.floor(F.col("track_pos") / CHUNK).alias("_block"), item.alias("_x"))
    return rows.groupBy("chrom", "pos", "strand", *kept, "_block").agg(F.collect_list("_x").alias("elements")).drop("_block")


def in_blocks(counts: DataFrame, keys: list[str], order: list[str], size: int = 4_096) -> DataFrame:
    """Rows with a count _n in pieces of at most ``size``, and a _block per ``size`` of the counts of equal keys.

    A list of all repeats of a block has a bound, however many there are of a key.
    """
    cut = counts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size))))
    cut = cut.withColumn("_n", F.least(F.lit(size), F.col("_n") - F.col("_k") * size).cast("int"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order, "_k").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_block", F.floor(F.coalesce(before, F.lit(0)) / size)).drop("_k")


def laid_out(rows: DataFrame) -> DataFrame:
    """One row per element of ``elements``, as ``_x``.

    The coalesce moves nothing: it ends the generated method of what comes before, which is often too large to be
    compiled, so that the loop over elements is.
    """
    return rows.coalesce(1 << 20).withColumn("_x", F.explode("elements")).drop("elements")


def multiply(impacts: DataFrame, presence: DataFrame, per_allele: bool = True) -> DataFrame:
    """Impacts at positions that carry a variant: an inner join, linear in both factors."""
    return impacts.join(presence, ["chrom", "track_pos", *(["alt"] if per_allele else [])])


# ---------------------------------------------------------------- decoding


def decoded_terms(product: DataFrame, track: DataFrame) -> DataFrame:
    """One row per set bit: chrom, genome pos, element, bit and term."""
    spans = track.select(
        F.col("chrom").alias("chrom"),
        F.col("track_offset").alias("start"),
        (F.col("track_offset") + F.col("end") - F.col("start")).alias("end"),
        F.col("start").alias("genome_start"),
        F.col("name").alias("name"),
    )
    points = product.select(*[c for c in product.columns if c != "pos"])
    placed = points_in(points, spans, position="track_pos")
    names = F.array(*[F.lit(t) for t in TERM_NAMES])
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(TERM_NAMES) - 1)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1)
    flat = placed.withColumn("bit", F.explode(bits))
    extra = ["alt"] if "alt" in product.columns else []
    return flat.select(
        "chrom",
        (F.col("r_genome_start") + F.col("track_pos") - F.col("r_start")).alias("pos"),
        *extra,
        F.col("r_name").alias("element"),
        "bit",
        F.element_at(names, F.col("bit") + 1).alias("term"),
    )


def impact_text(mask: Column) -> Column:
    """Terms joined by ``;``, each followed by one; NOMINAL_IMPACT; if there are none."""
    named = F.concat_ws(";", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(TERM_NAMES)])
    return F.when(named == "", F.lit("NOMINAL_IMPACT;")).otherwise(F.concat(named, F.lit(";")))


def context_runs(bases: DataFrame, keys: list[str], order: str, mask: str = "mask") -> DataFrame:
    """Per group and context: bases in it (n_), and runs of neighbouring such bases (r_)."""
    from ..schemas import context_mask

    window = Window.partitionBy(*keys).orderBy(order)
    counts = []
    flagged = bases
    for i, context in enumerate(CONTEXTS):
        inside = F.col(mask).bitwiseAND(F.lit(context_mask(context))) != 0
        flagged = flagged.withColumn(f"_c{i}", inside)
    for i, _ in enumerate(CONTEXTS):
        flagged = flagged.withColumn(f"_e{i}", F.col(f"_c{i}") & ~F.coalesce(F.lag(f"_c{i}").over(window), F.lit(False)))
    for i, context in enumerate(CONTEXTS):
        counts.append(F.sum(F.col(f"_c{i}").cast("long")).alias(f"n_{context}"))
        counts.append(F.sum(F.col(f"_e{i}").cast("long")).alias(f"r_{context}"))
    return flagged.groupBy(*keys).agg(*counts)


