"""Commands on small files, with what they write worked out by hand."""

import pytest

from locusflow import cli
from locusflow.sources import readers

SEQ = "AAAATGGCCTAAGTTTAGCCC"


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    at = tmp_path_factory.mktemp("commands")
    (at / "eoi.bed").write_text("chr1\t3\t12\tT1\t0\t+\n1\t7\t15\tT2\t0\t-\n")
    (at / "ref.fa").write_text(f">chr1\n{SEQ}\n")
    (at / "indels.vcf").write_text("#h\n1\t6\tins1\tG\tGTTT\t.\t.\t.\n1\t5\tdel1\tTGG\tT\t.\t.\t.\n")
    (at / "ins.vep").write_text("ins1\tchr1:6-7\tTTT\tG1\tT1\tTranscript\tinframe_insertion\t-\t3-4\n")
    (at / "del.vep").write_text("del1\tchr1:6-7\t-\tG1\tT1\tTranscript\tframeshift_variant\t-\t3\n")
    (at / "own.tsv").write_text("vid\telement\timpact\nv1\tT1\tmissense_variant;\nv2\tT1\tintron_variant;\nv3\tT1\tstop_gained;\n")
    (at / "other.vep").write_text(
        "v1\tchr1:5\tG\tG1\tT1\tTranscript\tmissense_variant,splice_region_variant\t2\t2\nv9\t1:9\tA\tG1\tT1\tTranscript\tintron_variant\t-\t-\n"
    )
    (at / "focus").write_text("missense_variant\nsplice_region_variant\nintron_variant\n")
    (at / "high").write_text("splice_region_variant\n")
    line = "1\t5\t5\tA\tG\texonic\tG1\tT1.3:exon1\tstopgain\tG1:T1.2:exon1:c.1A>G" + "\t." * 5 + "\t{}\n"
    (at / "x.annovar").write_text(line.format("v1") + line.format("v3"))
    (at / "terms").write_text("stopgain\tstop_gained\n")
    (at / "transcripts").write_text("T1\n")
    effects = ["A C 1_5_SNV_T1", "ACG A 1_5_DEL_T1", "A ACG 1_5_INS_T1", "A C 1_9_SNV_T2", "A G 1_7_SNV_T1"]
    (at / "effects.bed").write_text("".join(f"chr1\t{4 + i}\t{5 + i}\t{name}\t0\t+\t{'stopgain' if i != 4 else 'unknown'}\tT1\n" for i, name in enumerate(effects)))
    part = "chr1\tsrc\tCDS\t4\t8\t.\t+\t{}\tgene_id=G1;transcript_id={}\n"
    (at / "x.gff").write_text(part.format(0, "T2") + part.format(0, "T1") + part.format(1, "T3") + "chr1\tsrc\texon\t4\t8\t.\t+\t0\tgene_id=G1;transcript_id=T1\n")
    (at / "genes").write_text("G1\n")
    return at


@pytest.fixture()
def run(spark, at, tmp_path):
    """Runs a command; ``@x`` is an input file, ``>x`` an output."""

    def call(name, *arguments):
        paths = [str(at / a[1:]) if a[0] == "@" else str(tmp_path / a[1:]) if a[0] == ">" else a for a in arguments]
        assert cli.main([name, *paths]) == 0
        return paths[-1]

    return call


def test_insertions(spark, run):
    run("impact-track-insertions", "@eoi.bed", "@ins.vep", "@ref.fa", ">impacts")
    track = run("variant-track-insertions", "@eoi.bed", "@indels.vcf", ">track")
    assert [(r.chrom, r.track_pos) for r in spark.read.parquet(track).collect()] == [("1", 3)]
    product = spark.read.parquet(run("multiply-indels", ">impacts", ">track", ">product")).collect()
    assert [(r.track_pos, r.pos, r.frame, r.neigh) for r in product] == [(3, 6, 2, "ATGGCC")]
    out = run("translate-insertions", "@eoi.bed", ">product", "@indels.vcf", ">out")
    rows = spark.read.option("sep", "\t").option("header", True).csv(out).collect()
    assert [(r.vid, r.element, r.ref_aa, r.impact) for r in rows] == [("ins1", "T1", "Ala", "inframe_insertion;")]


def test_deletions(spark, run):
    run("impact-track-deletions", "@eoi.bed", "@del.vep", "@ref.fa", ">impacts")
    track = run("variant-track-deletions", "@eoi.bed", "@indels.vcf", ">track")
    assert sorted((r.chrom, r.track_pos) for r in spark.read.parquet(track).collect()) == [("1", 3), ("1", 4)]
    product = spark.read.parquet(run("multiply-indels", ">impacts", ">track", ">product")).collect()
    assert [(r.track_pos, r.pos, r.frame, r.neigh) for r in product] == [(3, 6, 2, "AATGCC")]
    out = run("translate-deletions", "@eoi.bed", ">product", "@indels.vcf", ">out")
    rows = spark.read.option("sep", "\t").option("header", True).csv(out).collect()
    assert [(r.vid, r.start, r.end, r.element, r.ref_aa, r.impact) for r in rows] == [("del1", "6", "7", "T1", "Met", "frameshift_variant;")]


def test_elements_hit(spark, run):
    rows = spark.read.parquet(run("variant-track-non-coding", "@eoi.bed", "@indels.vcf", ">hit")).collect()
    assert [(r.name, r.start, r.end) for r in rows] == [("T1", 4, 12)]


def test_two_annotators(spark, run):
    out = run("compare-annotations", "@other.vep", "@focus", "@high", "@own.tsv", ">reports")
    rows = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{out}/{name}").select(*c).collect()]
    assert rows("other_specific", "vid", "term") == [("v1", "splice_region_variant")] and rows("own_specific", "vid") == []
    assert rows("other_specific_high", "vid", "term") == [("v1", "splice_region_variant")] and rows("own_specific_high", "vid") == []
    assert rows("matched", "vid") == [("v1",)] and rows("not_existing", "vid") == [("v9",)]
    assert rows("high_disagreement", "vid", "own_high", "other_high") == [("v1", False, True)]


def test_annovar(spark, run):
    out = run("compare-annovar-by-element", "@x.annovar", "@terms", "@own.tsv", ">elements")
    assert [tuple(r) for r in spark.read.parquet(out + "/other_specific").collect()] == [("v1", "T1", "stop_gained")]
    assert sorted(r.vid for r in spark.read.parquet(out + "/matched").collect()) == ["v1", "v3"]
    assert spark.read.parquet(out + "/own_specific").count() == spark.read.parquet(out + "/not_existing").count() == 0
    out = run("compare-annovar-by-variant", "@x.annovar", "@terms", "@transcripts", "@own.tsv", ">variants")
    assert sorted((r.vid, r.status) for r in spark.read.parquet(out).collect()) == [("v1", "NOT_MATCHED"), ("v3", "MATCHED")]


def test_conversions(spark, run):
    text = lambda path: [r.value for r in spark.read.text(path).collect()]
    # Only rows that name their transcript and a known effect are numbered.
    tail = "Transcript\tstop_gained\t."
    assert text(run("convert-snv-annotations", "@effects.bed", "@terms", ">snv"))[0] == f"1_5_SNV_T1\t1:5\tC\t.\tT1\t{tail}\t31"
    assert text(run("convert-deletion-annotations", "@effects.bed", "@terms", ">del")) == [f"1_5_DEL_T1\t1:6-7\t-\t.\tT1\t{tail}\t31"]
    assert text(run("convert-insertion-annotations", "@effects.bed", "@terms", ">ins")) == [f"1_5_INS_T1\t1:7\tACG\t.\tT1\t{tail}\t31-32"]


def test_frame_unique_elements(spark, run, tmp_path):
    out = run("frame-unique-elements", "@genes", "CDS", "@x.gff", "2", ">unique")
    pick = lambda path: sorted((r.start, r.end, r.name, r.score) for r in readers.bed(spark, path).collect())
    assert pick(out) == [(2, 10, "T1", "0"), (2, 10, "T3", "1")] and pick(out + "_redundant") == [(2, 10, "T2", "0")]


def test_simulated_snvs(spark, run):
    rows = readers.vcf(spark, run("simulate-snvs", "@eoi.bed", "1.0", "@ref.fa", ">sim"), genotypes=True).collect()
    assert sorted(r.pos for r in rows) == sorted([*range(4, 13), *range(8, 16)])
    assert all(r.ref == SEQ[r.pos - 1] and r.alt in "ACGT" and r.alt != r.ref and r.calls == ["0|1"] for r in rows)
