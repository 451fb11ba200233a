"""Impacts by place: pairs of variant and element are laid out last and meet no join or grouping."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusflow.operators import concord, overlap, tracks, translate
from locusflow.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def operators(df):
    """Operators of the plan, from its top."""
    return [line.strip(" :+-*").split(" ")[0].split("(")[0] for line in df._jdf.queryExecution().sparkPlan().toString().splitlines()]


def copies(variants, n):
    """Variants of the same places and alleles under further ids."""
    return variants.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("vid", F.col("vid") + F.col("k") * 1_000_000).drop("k")


@pytest.mark.parametrize("kind", ["snv", "insertions"])
def test_placed_impacts_translate_like_the_track(views, kind):
    per_allele = kind == "snv"
    variants = copies(views.variants if per_allele else views.indels, 3)
    run = getattr(translate, f"translate_{kind}")
    track = run(variants, views.axis, views.impacts_with_bases(per_allele=per_allele))
    placed = run(views.with_bases(variants), views.axis, views.placed_impacts(per_allele))
    found = rows(track)
    assert found and found == rows(placed)


@pytest.mark.parametrize("name", ["translate_snv", "translate_ins"])
def test_elements_are_laid_out_behind_the_last_join(spark, name):
    plan = operators(entry.queries()[name](spark, SF))
    assert "Generate" in plan and plan.index("Generate") < min(i for i, x in enumerate(plan) if x.endswith("Join"))


def test_lines_of_one_place_are_united_before_the_regions(views):
    lines = tracks.united_annotations(views.annotations, ["chrom", "pos", "alt", "element"])
    assert rows(views.united.groupBy("chrom", "pos", "alt", "element").agg(F.bit_or("mask").alias("mask"), F.max_by("frame", "line_no").alias("frame"))) == rows(lines.drop("line_no"))


def test_converted_hits_number_lines_as_a_sort_of_them_does(spark):
    """Repeated ids, effects of two targets and of none; compared with the operator that sorts lines."""
    regions = spark.createDataFrame([("c1", 1 + i % 7, 20 + i % 5, f"T{i % 4}", i) for i in range(90)], "chrom string, start long, end long, name string, row_id long")
    variants = [("c1", 3 + i % 20, "A", "CGT"[i % 3], i, ["a", "b", "c"][i % 3]) for i in range(60)] + [("c1", 5, "A", "G", 2, "c"), ("c1", 3, "A", "T", 0, "a")]
    variants = spark.createDataFrame(variants, "chrom string, pos long, ref string, alt string, vid long, effect string")
    terms = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y")], "source string, target string")
    line_no = lambda row: F.col("vid") * 1_000 + F.col(row)
    found = concord.converted_hits(variants, regions, terms, line_no("row_id")).collect()
    hits = overlap.points_in(variants, regions)
    ident = F.concat_ws("_", "chrom", F.col("pos").cast("string"), F.lit("SNV"), "r_name")
    lines = hits.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat_ws(" ", "ref", "alt", ident).alias("name"), "effect", F.col("r_name").alias("transcript"), line_no("r_row_id").alias("line_no"))
    wanted = concord.converted_annotations(lines, terms, "SNV").collect()
    assert len(found) > 3_000

    def shown(rows):  # ids and alleles of lines that agree in number and target may go either way
        return sorted((r.line_no, r.consequence, r.location, r.feature, int(r.cds_position)) for r in rows)

    assert shown(found) == shown(wanted)


def test_no_line_of_convert_terms_is_dealt_out_or_sorted(spark):
    plan = operators(entry.queries()["convert_terms"](spark, SF))
    assert "Generate" in plan and plan.index("Generate") < min(i for i, x in enumerate(plan) if x.endswith("Join"))


def test_read_vep_stores_a_packed_line_per_variant_and_element(spark, views):
    import glob

    from locusflow.sources import scratch

    before = set(glob.glob(f"{scratch.app_folder(spark).removeprefix('file://')}/*/x.vep*"))
    found = entry.queries()["read_vep"](spark, SF)
    (folder,) = set(glob.glob(f"{scratch.app_folder(spark).removeprefix('file://')}/*/x.vep*")) - before
    lines = spark.read.text(folder).where("NOT startswith(value, '#')")
    hits = overlap.points_in(views.variants, views.regions)
    assert glob.glob(folder + "/*.gz") and lines.count() == hits.select("vid", "r_name").distinct().count()
    assert found.count() == hits.count()
