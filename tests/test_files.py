"""Sources, sinks, command line and streaming: round trips through real files."""

import gzip

import pytest
from pyspark.sql import functions as F

from locusflow import cli
from locusflow.operators import tracks
from locusflow.sources import readers, sinks
from locusflow.streaming import variants as stream

SEQ = "AAAATGGCCTAAGTTTAGCCC"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "eoi.bed").write_text("# c\ntrack x\nchr1\t3\t12\tT1\t0\t+\n1\t7\t15\tT2\t0\t-\n")
    (at / "ref.fa").write_text(f">chr1 x\n{SEQ[:10]}\n{SEQ[10:]}\n>chr2\nACGT\n")
    (at / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tINFO\tFORMAT\ts1\ts2\nchr1\t5\tv1\tT\tG,C\t.\t.\tAA=T\tGT\t0|1\t1|1\nchr1\t6\tv2\tGCC\tG\t.\t.\t.\tGT\t0|1\t./.\n1\t9\n")
    (at / "a.vep").write_text("v1\tchr1:5\tG\tG1\tT1\tTranscript\tmissense_variant,splice_region_variant\t2\t2\nv9\t1:900\tA\tG1\tT1\tTranscript\tintron_variant\t-\t-\n")
    (at / "x.bed12").write_text("chr1\t3\t12\tb\t0\t+\t3\t12\t0\t2\t2,3\t0,6\n")
    (at / "x.interval").write_text("n\tchr1\t+\t3\t12\t2\t3,9\t5,12\n")
    (at / "x.narrowPeak").write_text("chr1\t3\t12\tp\t5\t-\t1.5\t2\t3\t4\n")
    (at / "x.gff").write_text("chr1\tsrc\texon\t4\t8\t.\t+\t0\tID=e1;gene_id=G1;transcript_id=T1\nchr1\tsrc\texon\t9\t12\t.\t+\t.\tID=e2;gene_id=G1;transcript_id=T1\n")
    (at / "sizes").write_text("chr1 21\nchr2 4\n")
    (at / "ids").write_text("T1\n")
    (at / "samples").write_text("s1\ns2\n")
    with gzip.open(at / "z.bed.gz", "wt") as f:
        f.write("chr1\t0\t5\n")
    return at


def test_readers(spark, files):
    eoi = readers.bed(spark, str(files / "eoi.bed")).orderBy("start").collect()
    assert [(r.chrom, r.start, r.end, r.name, r.strand) for r in eoi] == [("1", 4, 12, "T1", "+"), ("1", 8, 15, "T2", "-")]
    assert readers.regions(spark, str(files / "z.bed.gz")).first().start == 1
    b12 = readers.bed12(spark, str(files / "x.bed12")).first()
    assert [(i.start, i.end) for i in b12.intervals] == [(4, 5), (10, 12)]
    assert [(i.start, i.end) for i in readers.interval(spark, str(files / "x.interval")).first().intervals] == [(4, 5), (10, 12)]
    assert readers.narrow_peak(spark, str(files / "x.narrowPeak")).first().strand == "-"
    assert readers.gff(spark, str(files / "x.gff")).count() == 2
    alts = readers.vcf(spark, str(files / "a.vcf"), split_alts=True)
    assert sorted((r.chrom, r.pos, r.alt) for r in alts.collect()) == [("1", 5, "C"), ("1", 5, "G"), ("1", 6, "G")]
    assert readers.vcf_samples(spark, str(files / "a.vcf")) == ["s1", "s2"]
    text = "".join(r.base for r in readers.fasta(spark, str(files / "ref.fa")).where("chrom = '1'").orderBy("pos").collect())
    assert text == SEQ


def test_strict_bed_raises(spark, tmp_path):
    (tmp_path / "bad.bed").write_text("1\t9\t3\tx\n")
    with pytest.raises(Exception, match="ill-formed"):
        readers.bed(spark, str(tmp_path / "bad.bed"), strict=True).collect()


def test_bed_round_trip(spark, files, tmp_path):
    eoi = readers.bed(spark, str(files / "eoi.bed"))
    sinks.write_bed(eoi, str(tmp_path / "o"))
    again = readers.bed(spark, str(tmp_path / "o"))
    pick = lambda d: sorted(tuple(r) for r in d.select("chrom", "start", "end", "name", "strand").collect())
    assert pick(eoi) == pick(again)


def test_track_round_trip(spark, files, tmp_path):
    axis = tracks.axis(readers.bed(spark, str(files / "eoi.bed")))
    track = spark.createDataFrame([("1", 1, "A", 5), ("1", 17, "T", 7)], "chrom string, track_pos long, alt string, mask long")
    sinks.write_track(track, axis, str(tmp_path / "t"), "mask", alleles=True)
    dense = sinks.dense_track(spark, str(tmp_path / "t"), "1")
    assert dense.shape == (4, 17) and dense[0, 0] == 5 and dense[3, 16] == 7 and dense.sum() == 12
    assert sorted(tuple(r) for r in sinks.sparse_track(spark, str(tmp_path / "t")).collect()) == [("1", 1, "A", 5), ("1", 17, "T", 7)]


def test_matrix_bytes_round_trip():
    rows = [(3, b"\x01\x02"), (900, b"\xff\x00")]
    assert sinks.parse_matrix_bytes(sinks.matrix_bytes(rows), 2) == rows


def test_annotation_pipeline(spark, files, tmp_path):
    f, o = (lambda n: str(files / n)), (lambda n: str(tmp_path / n))
    run = lambda *a: cli.main(list(a))
    assert run("impact-track-snv", f("eoi.bed"), f("a.vep"), f("ref.fa"), o("impacts")) == 0
    assert run("variant-track-snv", f("eoi.bed"), f("a.vcf"), o("snv")) == 0
    assert run("multiply-snv", o("impacts"), o("snv"), o("product")) == 0
    assert run("translate-snv", f("eoi.bed"), o("product"), f("a.vcf"), o("out")) == 0
    rows = spark.read.option("sep", "\t").option("header", True).csv(o("out")).collect()
    assert [(r.vid, r.element, r.ref_aa, r.alt_aa) for r in rows] == [("v1", "T1", "Met", "Arg")]
    assert spark.read.parquet(o("impacts_unmatched")).count() == 1
    assert run("extract-annotated", f("eoi.bed"), o("product"), o("terms")) == 0
    assert spark.read.parquet(o("terms")).count() == 2
    assert run("encode-snv-matrix", f("a.vcf"), f("samples"), f("eoi.bed"), "1", o("m")) == 0
    assert run("elements-of-interest", f("ids"), f("x.gff"), "exon", "Transcript", "1", o("eoi")) == 0
    made = readers.bed(spark, o("eoi")).first()
    assert (made.start, made.end, made.name) == (3, 13, "T1")
    assert run("separate-vcf", f("a.vcf"), f("sizes"), o("split")) == 0
    assert run("store-sequence", f("ref.fa"), o("seq")) == 0
    assert run("enumerate-snvs", f("eoi.bed"), o("seq"), o("enum")) == 0
    assert readers.vcf(spark, o("enum")).count() == 17 * 3
    assert run("simulate-indels", f("eoi.bed"), "3", "1.0", "0.5", f("ref.fa"), o("sim")) == 0
    assert readers.vcf(spark, o("sim")).count() == 17


def test_cli_rejects_nonsense(spark):
    assert cli.main([]) == 2 and cli.main(["no-such"]) == 2 and cli.main(["multiply-snv", "x"]) == 2


def test_stream_annotates_arriving_variants(spark, files, tmp_path):
    axis = tracks.axis(readers.bed(spark, str(files / "eoi.bed")))
    impacts = tracks.impact_track(tracks.parsed_annotations(readers.vep(spark, str(files / "a.vep"))), axis)
    stored = {}
    for name, table in (("axis", axis), ("impacts", impacts)):  # the static side of a stream is a stored table
        table.write.parquet(str(tmp_path / f"static_{name}"))
        stored[name] = spark.read.parquet(str(tmp_path / f"static_{name}"))
    axis, impacts = stored["axis"], stored["impacts"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.vcf").write_text("1\t5\tv1\tT\tG\t.\n")
    for name, query in (
        ("annotated", stream.annotated_stream(stream.vcf_stream(spark, str(folder)), axis, impacts)),
        ("present", stream.presence_stream(stream.vcf_stream(spark, str(folder)), axis)),
    ):
        writer = query.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
        writer.start().awaitTermination(120)
        assert spark.table(name).select(F.col("chrom")).count() == 1


def test_settings_are_overridden_by_arguments(tmp_path):
    (tmp_path / "run.conf").write_text("# a comment\nseed 5\nout = somewhere else  # why\n\nfast\n")
    found = readers.settings(str(tmp_path / "run.conf"), {"seed": "7"})
    assert found == {"seed": "7", "out": "somewhere else", "fast": ""}


def test_sweeping_deletes_an_applications_files(spark):
    import os

    from locusflow.sources import scratch

    path = scratch.scratch_file(spark, "x.parquet")
    spark.range(3).write.parquet(path)
    folder = scratch.app_folder(spark).removeprefix("file://")
    assert os.path.exists(path.removeprefix("file://")) and path.startswith(scratch.app_folder(spark))
    scratch.sweep(spark)
    assert not os.path.exists(folder)
