"""Hand-made cases: each row of the micro fixtures, and one named test per repaired defect."""

import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions import nucleotide as nuc
from locusflow.functions import text
from locusflow.operators import effects, genotypes, overlap, regions, sequence, simulate, tracks, translate
from locusflow.schemas import AMINO_ACIDS, TERM_BIT, TERM_NAMES

SEQ = "AAAATGGCCTAAGTTTAGCCC"
REGION = "chrom string, start long, end long, name string, strand string, row_id long"


@pytest.fixture(scope="module")
def bases(spark):
    return spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(SEQ)], "chrom string, pos long, base string")


@pytest.fixture(scope="module")
def chunks(bases):
    return tracks.chunked(bases)


def region(spark, *rows):
    return spark.createDataFrame([("1", s, e, n, d, i) for i, (s, e, n, d) in enumerate(rows)], REGION)


def variant(spark, *rows):
    return spark.createDataFrame([("1", p, r, a, i) for i, (p, r, a) in enumerate(rows)], "chrom string, pos long, ref string, alt string, vid long")


def impacts(spark, rows, alleles=True):
    """rows: (track_pos, alt, frame, neigh, terms)."""
    data = [("1", p, a, f, n, sum(1 << TERM_BIT[t] for t in ts)) for p, a, f, n, ts in rows]
    found = spark.createDataFrame(data, "chrom string, track_pos long, alt string, frame int, neigh string, mask long")
    return found if alleles else found.drop("alt")


def test_overlapping_elements_have_two_positions(spark):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+"), (8, 15, "T2", "+")))
    assert [r.track_offset for r in axis.orderBy("start").collect()] == [1, 10]
    hits = tracks.snv_track(variant(spark, (8, "A", "C")), axis)
    assert sorted(r.track_pos for r in hits.collect()) == [5, 10]


def test_name_tie_break_is_length_first(spark):
    axis = tracks.axis(region(spark, (4, 7, "T10", "+"), (4, 7, "T9", "+")))
    assert {r.name: r.track_offset for r in axis.collect()} == {"T9": 1, "T10": 5}


def test_last_base_is_kept(spark):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+"), (8, 15, "T2", "+")))
    assert [r.track_pos for r in tracks.snv_track(variant(spark, (15, "A", "C")), axis).collect()] == [17]


@pytest.mark.parametrize("second,n", [(8, 1), (9, 2)])
def test_merge_gap(spark, second, n):
    assert regions.merge(region(spark, (4, 7, "a", "+"), (second, 12, "a", "+")), 1).count() == n


def test_snv_codons_on_both_strands(spark, chunks):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+")))
    near = tracks.neighbourhood(variant(spark, (5, "T", "G")), chunks).first().neigh
    assert near == SEQ[1:4] + SEQ[5:8]
    product = impacts(spark, [(2, "G", 1, near, ["missense_variant", "splice_region_variant"])])
    row = translate.translate_snv(variant(spark, (5, "T", "G")), axis, product).first()
    assert (row.ref_aa, row.alt_aa, row.impact) == ("Met", "Arg", "splice_region_variant;missense_variant;")
    minus = tracks.axis(region(spark, (4, 12, "T1", "-")))
    row = translate.translate_snv(variant(spark, (5, "T", "G")), minus, product).first()
    seven = SEQ[1:8]
    turned = seven.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    mutated = (SEQ[1:4] + "G" + SEQ[5:8]).translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert (row.ref_aa, row.alt_aa) == (AMINO_ACIDS[turned[2:5]], AMINO_ACIDS[mutated[2:5]])


def test_stop_gained(spark):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+")))
    row = translate.translate_snv(variant(spark, (6, "G", "A")), axis, impacts(spark, [(3, "A", 1, "ATTGCC", [])])).first()
    assert (row.ref_aa, row.alt_aa, row.impact) == ("Trp", "STOP", "NOMINAL_IMPACT;")


@pytest.mark.parametrize("alt,term", [("TCCC", "inframe_insertion;"), ("TC", "frameshift_variant;"), ("TAAC", "inframe_insertion;stop_gained;")])
def test_insertion_terms(spark, alt, term):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+")))
    product = impacts(spark, [(2, "", 0, "AATGGC", ["missense_variant"])], alleles=False)
    assert translate.translate_insertions(variant(spark, (5, "T", alt)), axis, product).first().impact == term


@pytest.mark.parametrize("ref,term", [("ATGG", "inframe_deletion;"), ("ATG", "frameshift_variant;")])
def test_deletion_terms(spark, ref, term):
    axis = tracks.axis(region(spark, (4, 12, "T1", "+")))
    product = impacts(spark, [(p, "", 0, "AAATGG", ["coding_sequence_variant"]) for p in range(1, 9)], alleles=False)
    row = translate.translate_deletions(variant(spark, (4, ref, "A")), axis, product).first()
    assert row.impact.startswith(term)


def test_context_runs_across_a_border(spark):
    rows = impacts(spark, [(1, "", 0, "N", ["missense_variant"]), (2, "", 0, "N", ["missense_variant"]), (3, "", 0, "N", ["splice_region_variant"])], alleles=False)
    found = tracks.context_runs(rows, ["chrom"], "track_pos").first().asDict()
    assert (found["n_CDS"], found["r_CDS"], found["n_Splice_Region"], found["r_Splice_Region"]) == (2, 1, 1, 1)


def test_deletion_across_an_edge_is_in_the_track_only(spark):
    axis = tracks.axis(region(spark, (4, 7, "T1", "+")))
    crossing = variant(spark, (6, "GCCT", "G"))
    assert [r.track_pos for r in tracks.deletion_track(crossing, axis).collect()] == [4]
    product = impacts(spark, [(4, "", 0, "AAATGG", ["missense_variant"])], alleles=False)
    assert translate.translate_deletions(crossing, axis, product).count() == 0


def test_deletion_reaches_an_element_that_starts_inside_it(spark):
    axis = tracks.axis(region(spark, (8, 12, "T1", "+")))
    assert sorted(r.track_pos for r in tracks.deletion_track(variant(spark, (6, "GCCT", "G")), axis).collect()) == [1, 2]


def test_equal_length_substitutions_are_in_no_track(spark):
    axis, mnv = tracks.axis(region(spark, (4, 12, "T1", "+"))), variant(spark, (5, "AC", "GT"))
    assert tracks.equal_length_variants(mnv).count() == 1
    assert all(f(mnv, axis).count() == 0 for f in (tracks.snv_track, tracks.insertion_track, tracks.deletion_track))


def test_genotypes(spark):
    rows = spark.createDataFrame([(g,) for g in ("0|0", "0|1", "1|0", "1|1", "./.")], "gt string").withColumn("g", text.genotype_alleles(F.col("gt")))
    a0, a1 = F.col("g.a0"), F.col("g.a1")
    found = rows.select(text.presence(a0, a1).alias("p"), text.dosage(a0, a1).alias("d"), text.haplotype_code(a0, a1).alias("h")).collect()
    assert [tuple(r) for r in found] == [(0, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 3), (None, None, -1)]


def test_genotype_text_round_trip(spark):
    rows = spark.createDataFrame([(g,) for g in ("0|0", "0|1", "1|0", "1|1", ".|.")], "gt string").withColumn("g", text.genotype_alleles(F.col("gt")))
    back = rows.select("gt", genotypes.genotype_text(text.haplotype_code(F.col("g.a0"), F.col("g.a1"))).alias("x")).collect()
    assert all(r.gt == r.x for r in back)


@pytest.mark.parametrize("codes,counted", [((0, 1, 1, 0), True), ((1, 1, 1, 0), False), ((0, 1, 0, 0), False), ((0, 1, 2, 0), False)])
def test_deletion_carriers(spark, codes, counted):
    matrix = spark.createDataFrame([("1", 4 + i, 1, c) for i, c in enumerate(codes)], "chrom string, pos long, sample long, code int")
    voi = spark.createDataFrame([("1", 5, 6, 9)], "chrom string, start long, end long, vid long")
    assert genotypes.deletion_carriers(matrix, voi).first().carriers == int(counted)


def test_several_terms_set_their_bits(spark):
    row = spark.range(1).select(nuc.term_mask(F.array(F.lit("missense_variant"), F.lit("splice_region_variant"))).alias("m")).first()
    assert row.m == (1 << 26) | (1 << 24)


def test_chromosome_names(spark):
    rows = spark.createDataFrame([("chr1",), ("1",), ("CHR1",), ("a b",)], "c string")
    assert [r.x for r in rows.select(text.normal_chrom(F.col("c")).alias("x")).collect()] == ["1", "1", "1", "a_b"]


def test_unknown_base_has_no_amino_acid(spark):
    row = spark.range(1).select(nuc.amino_acid(F.lit("ANG")).alias("x"), nuc.codon_number(F.lit("ANG")).alias("n"), nuc.amino_acid(F.lit("aug")).alias("m")).first()
    assert (row.x, row.n, row.m) == (None, None, "Met")


def test_pack_round_trip(spark):
    draw = random.Random(1)
    data = [(draw.randrange(3), "".join(draw.choice("ACGT-") for _ in range(6)), "".join(draw.choice("ACGT") for _ in range(6)), draw.getrandbits(37)) for _ in range(200)]
    rows = spark.createDataFrame(data, "f int, n string, c string, m long")
    one = rows.select("*", nuc.unpack_impact(nuc.pack_impact(F.col("f"), F.col("n"), F.col("m"))).alias("u")).collect()
    assert all((r.u.frame, r.u.neighbours, r.u.mask) == (r.f, r.n, r.m) for r in one)
    two = rows.select("*", nuc.unpack_cds_impact(nuc.pack_cds_impact(F.col("f"), F.translate("n", "-", "A"), F.col("c"), F.col("m"))).alias("u")).collect()
    assert all((r.u.cds_neighbours, r.u.mask) == (r.c, r.m) for r in two)


def test_terms_decode_in_order(spark):
    mask = (1 << 37) - 1
    assert tuple(spark.range(1).select(nuc.terms_of(F.lit(mask)).alias("t")).first().t) == TERM_NAMES


def test_binned_join_equals_plain_join(spark):
    draw = random.Random(3)
    make = lambda: [("1", s := draw.randrange(1, 5000), s + draw.choice([0, 5, 300, 3000]), f"n{i}", "+", i) for i in range(150)]
    a, b = (spark.createDataFrame(make(), REGION) for _ in range(2))
    plain = a.alias("a").join(b.alias("b"), F.expr("a.chrom = b.chrom AND a.start <= b.end AND b.start <= a.end")).count()
    found = overlap.overlapping(a, b, size=64)
    assert found.count() == plain and found.select("row_id", "b_row_id").distinct().count() == plain


def test_merge_is_idempotent_and_subtract_complements(spark):
    draw = random.Random(4)
    make = lambda: [("1", s := draw.randrange(1, 900), s + draw.randrange(40), f"n{i}", "+", i) for i in range(60)]
    a, b = (spark.createDataFrame(make(), REGION) for _ in range(2))
    merged = regions.merge(a)
    assert sorted(regions.merge(merged).select("start", "end").collect()) == sorted(merged.select("start", "end").collect())
    whole = merged.withColumn("row_id", F.monotonically_increasing_id())
    cells = lambda d: {p for r in d.collect() for p in range(r.start, r.end + 1)}
    rest = cells(regions.subtract(whole, b, "row_id"))
    assert rest == cells(a) - cells(b)


def test_enumerated_snvs_translate_like_the_spliced_sequence(spark, bases, chunks):
    element = region(spark, (5, 13, "T1", "+"))
    axis = tracks.axis(element)
    snvs = simulate.enumerate_snvs(simulate.element_bases(element, bases)).withColumn("vid", F.monotonically_increasing_id())
    placed = tracks.neighbourhood(snvs, chunks).select(
        "chrom", (F.col("pos") - 4).alias("track_pos"), "alt", ((F.col("pos") - 5) % 3).cast("int").alias("frame"), "neigh", F.lit(0).cast("long").alias("mask")
    )
    found = translate.translate_snv(snvs, axis, placed).collect()
    assert len(found) == 27
    for r in found:
        at = r.pos - 5
        own = SEQ[4:13]
        new = own[:at] + r.alt + own[at + 1 :]
        codon = at - at % 3
        assert (r.ref_aa, r.alt_aa) == (AMINO_ACIDS[own[codon : codon + 3]], AMINO_ACIDS[new[codon : codon + 3]])


def test_window_at_the_ends_is_padded(spark, chunks):
    rows = tracks.neighbourhood(variant(spark, (1, "A", "C"), (21, "C", "A")), chunks).orderBy("pos").collect()
    assert [r.neigh for r in rows] == ["NNN" + SEQ[1:4], SEQ[17:20] + "NNN"]


def test_chunk_borders_do_not_show(spark, bases):
    small = tracks.chunked(bases, chunk=8, margin=4)
    rows = tracks.with_window(bases, small, "pos", 3, 3, "w", chunk=8).collect()
    padded = "NNN" + SEQ + "NNN"
    assert all(r.w == padded[r.pos - 1 : r.pos + 6] for r in rows)


def test_extracted_sequences_agree(spark, bases):
    draw = random.Random(5)
    rows = [(s := draw.randrange(1, 18), s + draw.randrange(4), f"n{i}", draw.choice("+-")) for i in range(30)]
    made = region(spark, *rows)
    one = {r.row_id: r.seq for r in sequence.extract(made, bases, "row_id").collect()}
    two = {r.row_id: r.seq for r in sequence.extract_chunked(made, tracks.chunked(bases, 8, 4), "row_id", 8).collect()}
    assert one == two


def test_derived_frequency_and_compat(spark):
    rows = spark.createDataFrame([("AA=A;AC=2;AN=10", "A", "C"), ("AA=C;AC=2;AN=10", "A", "C"), ("AC=2", "A", "C")], "info string, ref string, alt string")
    f = lambda compat: [r.x for r in rows.select(text.derived_frequency(F.col("info"), F.col("ref"), F.col("alt"), compat).alias("x")).collect()]
    assert f(False) == [0.2, 0.8, None] and f(True) == [0.8, pytest.approx(0.2), None]


def test_splice_loss(spark):
    rows = spark.createDataFrame([(5, 20, "+", 5, "GT", "AG", "A"), (5, 20, "+", 7, "GT", "AG", "A"), (5, 20, "-", 20, "CT", "AC", "G")], "s long, e long, d string, p long, f string, l string, a string")
    found = rows.select(effects.splice_loss(F.col("s"), F.col("e"), F.col("d"), F.col("p"), F.col("f"), F.col("l"), F.col("a")).alias("x")).collect()
    assert [r.x for r in found] == [True, False, True]


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("a;;b c"), "; ").alias("t"), text.is_balanced(F.lit("(a[b])")).alias("y"), text.is_balanced(F.lit("(]")).alias("n"),
        text.is_number(F.lit("-")).alias("m"), text.integers_in(F.lit("a12b3")).alias("i"), text.matching_prefix(F.lit("abc"), F.lit("abd")).alias("p"),
        text.attribute(F.lit("ID=x;gene_id=G1;gene_id=G2"), "gene_id").alias("g"), text.in_base(F.lit(255), 16).alias("h"), text.from_base(F.lit("ff"), 16).alias("b"),
    ).first()
    assert (row.t, row.y, row.n, row.m, row.i, row.p, row.g, row.h, row.b) == (["a", "b", "c"], True, False, False, [12, 3], 2, "G2", "ff", 255)


def test_top_spaced_keeps_its_distance(spark):
    rows = [(i * 10, i * 10 + 4, f"n{i}", "+") for i in range(1, 40)]
    made = region(spark, *rows).withColumn("score", F.col("row_id").cast("double"))
    chosen = [r for r in regions.top_spaced(made, "score", 3, 50).collect() if r.side == "top"]
    assert [r.start for r in chosen] == [390, 330, 270]
