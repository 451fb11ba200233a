"""Concordance of two annotators over the same variants, and term translation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import range_bucket, sums_before
from .overlap import BIN, points_in, prefixed
from .tracks import in_blocks, laid_out

#: Terms of one mask.
_WORD = 62
#: Elements of a place that one row lists.
_BLOCK = 4_096


def _listed(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


@dataclass(frozen=True)
class Reports:
    """Rows per report; all are lazy views of one join."""

    other_specific: DataFrame
    own_specific: DataFrame
    other_specific_high: DataFrame
    own_specific_high: DataFrame
    matched: DataFrame
    high_disagreement: DataFrame
    not_existing: DataFrame


def compare_annotations(own: DataFrame, other: DataFrame, focus: list[str], high: list[str]) -> Reports:
    """Own rows (vid, element, terms) against another annotator's (vid, element, terms).

    Joined by variant and element.  Within the focus terms: terms missing on either side (one row
    per term), the high-impact ones among them, pairs where any focus term is present, pairs that
    disagree on having a high-impact term, and rows of the other side that were never matched.
    """
    joined = own.join(prefixed(other, "o_"), (F.col("vid") == F.col("o_vid")) & (F.col("element") == F.col("o_element")))
    keys = own.select("vid", "element").distinct()
    return _reports(joined, focus, high, lambda rows: rows, other.join(keys, ["vid", "element"], "left_anti"))


def compare_placed(own: DataFrame, other: DataFrame, regions: DataFrame, focus: list[str], high: list[str], size: int = BIN) -> Reports:
    """:func:`compare_annotations` of rows (vid, chrom, pos, terms) that stand for one in every region over their place.

    Terms are compared once per pair of rows and only what a report holds meets the elements, each with the
    number of its regions over the place: neither side's rows per region are made, dealt out or paired.
    """
    joined = own.join(prefixed(other, "o_"), F.col("vid") == F.col("o_vid"))
    places = own.select("chrom", "pos").unionByName(other.select("chrom", "pos")).distinct()
    over = points_in(places, regions.select("chrom", "start", "end", "name"), size=size)
    over = over.groupBy("chrom", "pos", F.col("r_name").alias("element")).agg(F.count(F.lit(1)).alias("n")).where("element IS NOT NULL")

    def spread(rows: DataFrame) -> DataFrame:
        same = F.coalesce((F.col("chrom") == F.col("o_chrom")) & (F.col("pos") == F.col("o_pos")), F.lit(False))
        met = rows.where(same).join(over, ["chrom", "pos"])
        apart = rows.where(~same).join(over, ["chrom", "pos"])
        apart = apart.join(prefixed(over, "o_"), ["o_chrom", "o_pos"]).where("element = o_element")
        copies = [f.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), n.cast("int")))) for f, n in ((met, F.col("n") * F.col("n")), (apart, F.col("n") * F.col("o_n")))]
        return copies[0].select(*rows.columns, "element").unionByName(copies[1].select(*rows.columns, "element"))

    named = [points_in(rows, regions.select("chrom", "start", "end", "name"), size=size).withColumnRenamed("r_name", "element") for rows in (own, other)]
    lost = named[1].select("vid", "element", "terms").join(named[0].select("vid", "element").distinct(), ["vid", "element"], "left_anti")
    return _reports(joined, focus, high, spread, lost)


def _reports(
    joined: DataFrame, focus: list[str], high: list[str], spread: Callable[[DataFrame], DataFrame], not_existing: DataFrame, shown: Callable[[Column], Column] = lambda c: c
) -> Reports:
    """The reports of paired rows with terms and o_terms.  ``spread`` gives a report's rows their element."""
    wanted, severe = _listed(focus), _listed(high)
    cut = joined.withColumns({"own_terms": F.array_intersect("terms", wanted), "other_terms": F.array_intersect("o_terms", wanted)})
    kept = [c for c in joined.columns if c not in ("terms", "o_terms")]

    def only(a: str, b: str, within: Column | None = None) -> DataFrame:
        missing = F.array_except(a, b)
        if within is not None:
            missing = F.array_intersect(missing, within)
        return spread(cut.select(*kept, F.explode(missing).alias("term"))).select("vid", "element", "term")

    present = (F.size("own_terms") > 0) | (F.size("other_terms") > 0)
    own_high, other_high = F.arrays_overlap("terms", severe), F.arrays_overlap("o_terms", severe)
    return Reports(
        only("other_terms", "own_terms"),
        only("own_terms", "other_terms"),
        only("other_terms", "own_terms", severe),
        only("own_terms", "other_terms", severe),
        spread(cut.where(present).select(*kept, *[shown(F.col(c)).alias(c) for c in ("own_terms", "other_terms")])).select("vid", "element", "own_terms", "other_terms"),
        spread(cut.where(own_high != other_high).select(*kept, own_high.alias("own_high"), other_high.alias("other_high"))).select("vid", "element", "own_high", "other_high"),
        not_existing,
    )


def annovar_terms(rows: DataFrame) -> DataFrame:
    """Adds terms: the exonic function unless ``.``, and ``splicing`` if the function names it."""
    exonic = F.when(F.col("exonic_function") != ".", F.array("exonic_function")).otherwise(F.array().cast("array<string>"))
    splicing = F.when(F.contains("function", F.lit("splicing")), F.array(F.lit("splicing"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("terms", F.array_distinct(F.concat(exonic, splicing)))


def annovar_elements(rows: DataFrame) -> DataFrame:
    """Adds elements: second field of each amino-acid change and first field of each detail, without version."""
    # One expression a column, which is compiled; functions of lambdas would be interpreted row by row.
    changes = F.regexp_extract_all("aa_change", F.lit(r"(?<![^,])[^:,]*:(?!\.?(?:[:,]|\z))([^:,]*?)(?:\.\d+)?(?=[:,]|\z)"), F.lit(1))
    details = F.regexp_extract_all("detail", F.lit(r"(?<![^;])(?!\.?(?:[:;]|\z))([^:;]*?)(?:\.\d+)?(?=[:;]|\z)"), F.lit(1))
    return rows.withColumn("elements", F.array_distinct(F.concat(changes, details)))


def compare_annovar_by_element(own: DataFrame, annovar: DataFrame, terms: DataFrame) -> Reports:
    """Own rows (vid, element, terms) against exploded annotator rows translated by (source, target) terms.

    Terms outside the map are ignored on both sides; membership in the map also defines high impact.
    """
    targets, coding, listed = _vocabulary(terms)
    # Of a bare column Spark would infer a filter on its size and push it into the interval join that may lie
    # below, where every candidate pair would have its text parsed before the range is tested.
    coded = annovar.select("vid", "elements", *coding)
    flat = coded.select("vid", F.explode(F.array_distinct("elements")).alias("element"), *[f"_m{i}" for i in range(len(coding))])
    other = flat.groupBy("vid", "element").agg(F.count(F.lit(1)).alias("_n"), *[F.bit_or(f"_m{i}").alias(f"_m{i}") for i in range(len(coding))])
    return compare_annotations(own, other.select("vid", "element", listed.alias("terms")), targets, targets)


def compare_annovar_placed(
    own: DataFrame, annovar: DataFrame, named: DataFrame, regions: DataFrame, terms: DataFrame, shown: Callable[[Column], Column] = lambda c: c, size: int = BIN
) -> Reports:
    """:func:`compare_annovar_by_element` of rows that stand for many.

    ``own`` (vid, chrom, pos, terms) stands for a row in every region over its place.  A line of ``annovar`` (vid, chrom,
    pos, elements, terms) names the elements of ``named`` (chrom, pos, elements; one row a place) besides its own; it
    is compared with own rows of its vid and place.  Texts are parsed and elements looked up once per place, terms are
    compared once per own row, and what a report holds is laid out over the elements last.  ``shown`` is applied to both
    lists of terms of the matched.
    """
    targets, coding, listed = _vocabulary(terms)
    words, key = [f"_m{i}" for i in range(len(coding))], ["vid", "chrom", "pos"]
    none = F.array().cast("array<string>")
    lines = annovar.select(*key, F.array_distinct(F.coalesce("elements", none)).alias("_more"), *coding)
    united = lines.groupBy(*key).agg(F.collect_list(F.struct("_more", *words)).alias("_lines"), *[F.bit_or(m).alias(m) for m in words])
    paired = own.select(*key, "terms").join(united, key)

    places = own.select("chrom", "pos").distinct()
    over = points_in(places, regions.select("chrom", "start", "end", "name").where("name IS NOT NULL"), size=size)
    over = over.groupBy("chrom", "pos", F.col("r_name").alias("element")).agg(F.count(F.lit(1)).alias("_n"))
    pieces = in_blocks(over, ["chrom", "pos"], ["element"], _BLOCK)
    blocks = pieces.groupBy("chrom", "pos", "_block").agg(F.collect_list(F.array_repeat("element", F.col("_n"))).alias("_e"))
    known = named.select("chrom", "pos", F.coalesce("elements", none).alias("_known"))
    blocks = blocks.join(known, ["chrom", "pos"], "left").withColumn("_known", F.coalesce("_known", none))
    stated = lambda e: F.array_contains("_known", F.get(e, F.lit(0)))
    blocks = blocks.select("chrom", "pos", F.flatten(F.filter("_e", stated)).alias("elements"), F.flatten(F.filter("_e", lambda e: ~stated(e))).alias("_rest"))

    # A part for the elements that all lines of the place name, and one for each that a line names of itself.
    held = lambda e: lambda line: F.array_contains(line["_more"], e)
    union = lambda m, e: F.aggregate(F.filter("_lines", held(e)), F.lit(0).cast("long"), lambda acc, line: acc.bitwiseOR(line[m])).alias(m)
    most = F.array(F.struct(*words, "elements"))
    single = F.transform(F.filter("_rest", lambda e: F.exists("_lines", held(e))), lambda e: F.struct(*[union(m, e) for m in words], F.array(e).alias("elements")))
    joined = paired.join(blocks, ["chrom", "pos"])
    joined = joined.select("vid", "terms", F.explode(F.when(F.size("_rest") == 0, most).otherwise(F.concat(most, single))).alias("_p"))
    joined = joined.select("vid", "terms", *[F.col("_p")[c].alias(c) for c in (*words, "elements")]).select("vid", "terms", listed.alias("o_terms"), "elements")

    def spread(rows: DataFrame) -> DataFrame:
        return laid_out(rows).withColumnRenamed("_x", "element")

    # Those of no own row need their lines' elements in full.
    full = annovar.join(named.select("chrom", "pos", F.col("elements").alias("_known")), ["chrom", "pos"], "left")
    full = full.withColumn("elements", F.array_union(F.coalesce("elements", none), F.coalesce("_known", none)))
    hits = points_in(own, regions, size=size).select("vid", F.col("r_name").alias("element"), "terms")
    lost = compare_annovar_by_element(hits, full.select("vid", "elements", "terms"), terms).not_existing
    return _reports(joined, targets, targets, spread, lost, shown)


def _vocabulary(terms: DataFrame) -> tuple[list[str], list[Column], Column]:
    """Targets of (source, target) rows; masks of them, by a row's terms, named _m0, _m1...; and the targets that masks hold."""
    pairs = [(r.source, r.target) for r in terms.select("source", "target").distinct().collect()]  # a fixed small vocabulary
    targets = sorted({t for _, t in pairs if t is not None})
    # Sets of targets are masks: united on the map side, a row's terms without a row of their own.
    words = [targets[i : i + _WORD] for i in range(0, len(targets), _WORD)]
    masks = [_mask("terms", [[s for s, t in pairs if t == target and s is not None] for target in word]).alias(f"_m{i}") for i, word in enumerate(words)]
    found = [F.when(F.getbit(F.col(f"_m{i}"), F.lit(j)) == 1, F.lit(t)) for i, word in enumerate(words) for j, t in enumerate(word)]
    return targets, masks, F.array_except(F.array(*found), F.array(F.lit(None).cast("string"))) if found else _listed([])


def _mask(terms: str, sources: list[list[str]]) -> Column:
    """Bit i is set if ``terms`` holds any of the i-th ``sources``."""
    out = F.lit(0).cast("long")
    for i, names in enumerate(sources):
        out = out.bitwiseOR(F.when(F.arrays_overlap(F.col(terms), _listed(names)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def compare_annovar_by_variant(own: DataFrame, annovar: DataFrame, terms: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per variant: own and other terms pooled over the listed transcripts, and whether they match.

    Rows: vid, own_terms, other_terms, status (MATCHED, OWN_SPECIFIC, OTHER_SPECIFIC, NOT_MATCHED).
    """
    listed = transcripts.select(F.col("id").alias("element")).distinct()
    mapped = terms.select("source", "target")
    mine = own.join(listed, "element", "left_semi").select("vid", F.explode_outer("terms").alias("target"))
    mine = mine.join(mapped.select("target").distinct(), "target", "left_semi").groupBy("vid").agg(F.array_sort(F.collect_set("target")).alias("own_terms"))
    theirs = annovar.select("vid", F.explode_outer("terms").alias("source")).join(mapped, "source")
    theirs = theirs.groupBy("vid").agg(F.array_sort(F.collect_set("target")).alias("other_terms"))
    both = mine.join(theirs, "vid", "full_outer")
    status = (
        F.when(F.col("own_terms").isNull() | F.col("other_terms").isNull(), "NOT_MATCHED")
        .when(F.col("own_terms") == F.col("other_terms"), "MATCHED")
        .when(F.size(F.array_except("own_terms", "other_terms")) > 0, "OWN_SPECIFIC")
        .otherwise("OTHER_SPECIFIC")
    )
    return both.withColumn("status", status)


def converted_annotations(rows: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Effect rows rewritten as annotator rows.

    ``rows``: chrom, start, end (1-based), name (``REF ALT ID``), effect, transcript, line_no; ID is
    ``chr_pos_TYPE_transcript``.  Kept are rows whose ID names this ``kind`` and the impacted
    transcript; effects outside the map are dropped.  The made-up coding position cycles through
    31..500, then 30..500, over the kept rows in line order.
    """
    name = F.split("name", " ")
    parts = F.split(name[2], "_")
    cut = rows.withColumns({"ref": name[0], "alt": name[1], "id": name[2]})
    right_kind = F.lit(True) if kind == "SNV" else parts[2] == kind
    named = F.array_join(F.slice(parts, 4, 1000), "_")
    kept = cut.where(right_kind & (named == F.col("transcript"))).join(terms, F.col("effect") == F.col("source"))
    kept = kept.select("chrom", "start", "end", "ref", "alt", "id", "transcript", "target", "line_no")
    kept = sums_before(kept, [], range_bucket(kept, "line_no"), ["line_no", "target"], {"before": F.lit(1)})
    position = F.col("end") if kind == "SNV" else F.col("start")
    last = (position + F.greatest(F.length("ref") - F.length("alt"), F.lit(0)) - 1) if kind == "DEL" else position
    cds = _made_up(F.col("before") + 1)
    if kind == "INS":
        cds = F.concat(cds.cast("string"), F.lit("-"), (cds + 1).cast("string"))
    place = F.when(last > position, F.concat(position.cast("string"), F.lit("-"), last.cast("string"))).otherwise(position.cast("string"))
    allele = F.lit("-") if kind == "DEL" else F.col("alt")
    return kept.select(
        F.col("id").alias("uploaded_variation"), F.concat("chrom", F.lit(":"), place).alias("location"), allele.alias("allele"),
        F.col("transcript").alias("feature"), F.lit("Transcript").alias("feature_type"), F.col("target").alias("consequence"),
        cds.cast("string").alias("cds_position"), "line_no",
    )


def _made_up(order: Column) -> Column:
    """The coding position of a kept row by its place in line order, from 1."""
    return F.when(order <= 470, order + 30).otherwise((order - 471) % 471 + 30)


def converted_hits(variants: DataFrame, regions: DataFrame, terms: DataFrame, line_no: Column, size: int = BIN) -> DataFrame:
    """:func:`converted_annotations` of SNVs with a line per variant and element they lie in, in order of (vid, row_id).

    ``variants``: chrom, pos, alt, vid, effect, those of one vid at one place; ``line_no`` is over vid and row_id and
    must follow that order.  A line's place is that of its variant, from the numbers of elements, and that of its
    region among those of the place: lines are neither sorted nor dealt out.
    """
    known = variants.join(terms, F.col("effect") == F.col("source")).select("chrom", "pos", "alt", "vid", "target")
    placed = points_in(known.select("chrom", "pos").distinct(), regions.where("name IS NOT NULL"), size=size).select("chrom", "pos", "r_name", "r_row_id")
    counts = placed.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("r_row_id")) - 1
    item = F.struct(F.col("r_name").alias("name"), F.col("r_row_id").alias("row_id"), F.col("_rank").alias("rank"))
    blocks = placed.withColumn("_rank", rank).groupBy("chrom", "pos", F.floor(F.col("_rank") / 4_096).alias("_block")).agg(F.collect_list(item).alias("elements"))
    # Lines of one number are told apart by their target, and those of one vid have the same regions.
    same = Window.partitionBy("vid")
    counted = known.join(counts, ["chrom", "pos"])
    counted = counted.withColumns({"_copy": F.row_number().over(same.orderBy("target")) - 1, "_copies": F.count(F.lit(1)).over(same)})
    ordered = sums_before(counted, [], range_bucket(known, "vid"), ["vid", "_copy"], {"before": F.col("_n")})
    ordered = ordered.withColumn("_first", F.col("before") - F.col("_copy") * F.col("_n") + F.col("_copy") + 1)
    ordered = ordered.withColumn("location", F.concat("chrom", F.lit(":"), F.col("pos").cast("string")))
    ordered = ordered.withColumn("_id", F.concat("chrom", F.lit("_"), F.col("pos").cast("string"), F.lit("_SNV_")))
    lines = laid_out(ordered.join(blocks, ["chrom", "pos"])).withColumns({"name": F.col("_x.name"), "row_id": F.col("_x.row_id")})
    return lines.select(
        F.concat("_id", "name").alias("uploaded_variation"), "location", F.col("alt").alias("allele"), F.col("name").alias("feature"),
        F.lit("Transcript").alias("feature_type"), F.col("target").alias("consequence"),
        _made_up(F.col("_first") + F.col("_x.rank") * F.col("_copies")).cast("string").alias("cds_position"), line_no.alias("line_no"),
    )
