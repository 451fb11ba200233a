"""Paths that small tables do not take: many buckets, stretches, blocks of lines, long windows; against plain Python."""

import gzip
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow import cli
from locusflow.operators import concord, effects, genotypes, ordering, overlap, regions, sequence, simulate, tracks, translate
from locusflow.plans.catalog import QUERIES
from locusflow.sources import readers, sinks


def made_regions(spark, n, length, seed=1, span=300_000, chroms=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randint(1, span)
        rows.append((f"c{draw.randrange(chroms)}", start, start + int(draw.expovariate(1 / length)), f"T{draw.randrange(40)}", draw.choice("+-"), i))
    return rows, spark.createDataFrame(rows, "chrom string, start long, end long, name string, strand string, row_id long")


def plain_merge(rows, gap):
    out = {}
    for chrom, start, end, *_ in sorted(rows):
        mine = out.setdefault(chrom, [])
        if mine and start <= mine[-1][1] + gap:
            mine[-1][1] = max(mine[-1][1], end)
            mine[-1][2] += 1
        else:
            mine.append([start, end, 1])
    return sorted((c, *x) for c, xs in out.items() for x in xs)


@pytest.mark.parametrize("length,gap", [(20, 0), (800, 1), (60_000, 0), (5, 3_000)])
def test_merging_in_stretches(spark, monkeypatch, length, gap):
    monkeypatch.setattr(regions, "STRETCH", 1 << 10)
    rows, frame = made_regions(spark, 400, length)
    found = sorted((r.chrom, r.start, r.end, r.n_merged) for r in regions.merge(frame, gap).collect())
    assert found == plain_merge(rows, gap)


def test_ranks_and_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOGETHER", 17)
    rows, frame = made_regions(spark, 300, 30)
    by_chrom = {c: sorted((r for r in rows if r[0] == c), key=lambda r: r[5]) for c in ("c0", "c1")}
    found = {r.row_id: r.distance for r in regions.successive_distances(frame, "row_id").collect()}
    assert found == {a[5]: b[1] - a[2] for rs in by_chrom.values() for a, b in zip(rs, rs[1:])}
    top = {r.row_id: r.covered_before for r in regions.top_by_coverage(frame, 500, "row_id").collect()}
    want = {}
    for rs in by_chrom.values():
        used = 0
        for r in reversed(rs):
            if used < 500:
                want[r[5]] = used
            used += r[2] - r[1] + 1
    assert top == want
    tests = frame.select("row_id", (-(F.col("row_id") % 50) / 8).alias("log_p"), F.format_string("%06d", "row_id").alias("name"))
    order = sorted((-(i % 50) / 8, f"{i:06d}", i) for i in range(300))
    ranks = {r.row_id: (r["rank"], r.log_q) for r in regions.adjusted_p_values(tests, "log_p").collect()}
    assert all(ranks[i][0] == k + 1 and math.isclose(ranks[i][1], p + math.log(300 / (k + 1))) for k, (p, _, i) in enumerate(order))


def test_converted_positions_run_on_over_buckets(spark, monkeypatch):
    rows = [("c1", i, i, f"A C c1_{i}_SNV_T1", "stop", "T1", i * 3) for i in range(1_100)]
    frame = spark.createDataFrame(rows, "chrom string, start long, end long, name string, effect string, transcript string, line_no long")
    terms = spark.createDataFrame([("stop", "stop_gained")], "source string, target string")
    want = [str(i + 30 if i <= 470 else (i - 471) % 471 + 30) for i in range(1, 1_101)]
    for together in (ordering.TOGETHER, 90):
        monkeypatch.setattr(ordering, "TOGETHER", together)
        found = sorted((r.line_no, r.cds_position) for r in concord.converted_annotations(frame, terms, "SNV").collect())
        assert [p for _, p in found] == want


def test_walks_k_mers_and_maps_over_stretches(spark, monkeypatch):
    for module in (regions, sequence):
        monkeypatch.setattr(module, "STRETCH", 16)
    draw = random.Random(3)
    text = "".join(draw.choices("ACGT", k=150))
    bases = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate(text)], "chrom string, pos long, base string")
    walk = [r.walk for r in sequence.dna_walk(bases).orderBy("pos").collect()]
    assert walk == np.cumsum([1 if b in "CT" else -1 for b in text]).tolist()
    values = [r.value for r in sequence.centred_kmer_values(bases, 5).orderBy("pos").collect()]
    codes = ["ACGT".index(b) for b in text]
    want = [sum(codes[i + o] * 4 ** (o + 2) for o in range(-2, 3)) if 2 <= i < 148 else None for i in range(150)]
    assert values == want
    gapped = sequence.centred_kmer_values(bases.where("pos <> 40"), 3).where("value is null").collect()
    assert sorted(r.pos for r in gapped) == [1, 39, 41, 150]
    points = [(7, 0.5), (60, 2.0), (61, 2.5), (140, 9.0)]
    frame = spark.createDataFrame([("c", p, m) for p, m in points], "chrom string, pos long, cm double")
    found = [r.cm for r in sequence.cm_at(bases.select("chrom", "pos"), frame).orderBy("pos").collect()]
    assert np.allclose(found, np.interp(range(1, 151), *zip(*points)))
    made = sequence.recombination_intervals(frame).orderBy("start").collect()
    assert [(r.start, r.end, r.cm_left, r.cm_right) for r in made] == [(7, 60, 0.5, 2.0), (60, 61, 2.0, 2.5), (61, 140, 2.5, 9.0)]


def test_spaced_choice_reads_on_until_it_has_enough(spark):
    """The best rows crowd in one place, so that the leading part has to grow several times."""
    rows = [("c", 1_000 + i % 50, 1_010 + i % 50, "a", float(5_000 + i)) for i in range(2_500)]
    rows += [("c", 10_000 + 500 * i, 10_020 + 500 * i, "b", float(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "chrom string, start long, end long, name string, score double")
    for side, sign in (("top", -1), ("bottom", 1)):
        want = []
        for r in sorted(rows, key=lambda r: (sign * r[4], r[1], r[2], r[3])):
            if len(want) < 3 and all(r[1] - e > 50 or s - r[2] > 50 for s, e in want):
                want.append((r[1], r[2]))
        found = [(r.start, r.end) for r in regions.top_spaced(frame, "score", 3, 50).where(F.col("side") == side).collect()]
        assert sorted(found) == sorted(want)


def test_bins_bound_the_copies_of_regions(spark):
    rows = [("c", 1 + i, 10 + i, "a", "+", i) for i in range(500)] + [("c", 1, 2_000_000, "b", "+", 500)]
    frame = spark.createDataFrame(rows, "chrom string, start long, end long, name string, strand string, row_id long")
    size = overlap.bin_size(frame)
    assert overlap._binned(frame, size).count() <= 3 * len(rows)
    points = spark.createDataFrame([("c", 5), ("c", 1_999_999)], "chrom string, pos long")
    assert overlap.points_in(points, frame, size=size).count() == 5 + 2


def test_element_joins_by_bins(spark):
    rows, frame = made_regions(spark, 300, 3_000)
    draw = random.Random(9)
    points = [(f"c{draw.randrange(2)}", draw.randint(1, 300_000), f"T{draw.randrange(40)}", i) for i in range(2_000)]
    found = overlap.points_in_elements(spark.createDataFrame(points, "chrom string, pos long, element string, pid long"), frame)
    want = sorted((p[3], r[5]) for p in points for r in rows if p[0] == r[0] and p[2] == r[3] and r[1] <= p[1] <= r[2])
    assert sorted((r.pid, r.r_row_id) for r in found.collect()) == want


def test_fasta_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_LINES", 3)
    draw = random.Random(1)
    texts = {"1": "".join(draw.choices("ACGT", k=70_001)), "2": "".join(draw.choices("acgtN", k=300)), "X_1": "G"}
    for part, names in enumerate((["1", "2"], ["X_1"])):
        with open(tmp_path / f"{part}.fa", "w") as f:
            for k in names:
                f.write(f">chr{k} text\r\n")
                f.writelines(texts[k][i : i + 7] + "\n" for i in range(0, len(texts[k]), 7))
    found = {}
    for r in readers.fasta(spark, str(tmp_path)).collect():
        found.setdefault(r.chrom, {})[r.pos] = r.base
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in found.items()} == {k: t.upper() for k, t in texts.items()}
    chunks = readers.fasta_chunks(spark, str(tmp_path))
    for margin in (16, 100):
        for r in tracks.with_margin(chunks, margin).collect() if margin > 16 else chunks.collect():
            low, high = max(1, r.chunk * tracks.CHUNK - margin), (r.chunk + 1) * tracks.CHUNK - 1 + margin
            assert (r.first, r.seq) == (low, texts[r.chrom].upper()[low - 1 : high])


# ---------------------------------------------------------------- commands


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("more")
    draw = random.Random(5)
    text = "".join(draw.choices("ACGT", k=400))
    (at / "ref.fa").write_text(">chr1\n" + "\n".join(text[i : i + 50] for i in range(0, 400, 50)) + "\n")
    (at / "eoi.bed").write_text("chr1\t3\t12\tT1\t0\t+\n1\t7\t15\tT2\t0\t-\n")
    calls = ["0|1\t0|0\t.|.", "1|1\t0|0\t0|1", "0|0\t1|0\t0|0", "1|0\t0|1\t1|1"]
    lines = [f"1\t7\t.\tA\tC\t.\t.\t.\tGT\t{calls[0]}", f"1\t9\t.\tA\tC\t.\t.\t.\tGT\t{calls[1]}", f"1\t9\t.\tA\tG\t.\t.\t.\tGT\t{calls[2]}"]
    lines += [f"1\t5\t.\tACG\tA\t.\t.\t.\tGT\t{calls[3]}", f"1\t5\t.\tACG\tAC\t.\t.\t.\tGT\t{calls[3]}", f"1\t14\t.\tACG\tA\t.\t.\t.\tGT\t{calls[3]}"]
    (at / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tINFO\tFORMAT\ts1\ts2\ts3\n" + "\n".join(lines) + "\n")
    (at / "samples").write_text("s1\ns2\ns3\n")
    (at / "snvs.bed").write_text("1\t6\t7\tA C\t0\t+\n1\t8\t9\tA C\t0\t+\n1\t8\t9\tA G\t0\t+\n")
    (at / "dels.bed").write_text("1\t5\t7\td1\t0\t+\n1\t5\t6\td2\t0\t+\n")
    (at / "a.vep").write_text("v1\tchr1:9-10\t-\tG1\tT1\tTranscript\tframeshift_variant\t2\t4-5\nv2\t1:12-13\t-\tG1\tT1\tTranscript\tintron_variant\t-\t-\n")
    (at / "sizes").write_text("chr1 400\n")
    return at, text


def test_genotypes_without_identifiers(spark, files, tmp_path):
    at, _ = files
    f, o = (lambda n: str(at / n)), (lambda n: str(tmp_path / n))
    run = lambda *a: cli.main(list(a))
    assert run("encode-snv-matrix", f("a.vcf"), f("samples"), f("eoi.bed"), "1", o("snv")) == 0
    found = sorted((r.track_pos, r.alt, r.sample, r.code) for r in spark.read.parquet(o("snv")).collect())
    # Place 7 is base 4 of T1; place 9 base 6 of T1 and base 2 of T2, which begins at 10 on the axis.
    want = [(4, "C", "s1", 1)] + [(p, a, s, c) for p in (6, 11) for a, s, c in (("C", "s1", 2), ("C", "s3", 1), ("G", "s2", 1))]
    assert found == sorted(want)
    assert run("aggregate-snv-matrix", o("snv"), f("eoi.bed"), f("snvs.bed"), o("counts")) == 0
    counts = {r.vid: r.allele_count for r in spark.read.parquet(o("counts")).collect()}
    assert counts == {"A C": 1 + 2 * (2 + 1), "A G": 2}
    assert run("encode-deletion-matrix", f("a.vcf"), f("samples"), f("eoi.bed"), "1", o("del")) == 0
    found = sorted((r.track_pos, r.sample, r.code) for r in spark.read.parquet(o("del")).collect())
    # Bases 6 and 7 are gone, which T1 alone holds; the deletion of a longer ALT and the one beyond T2 are left out.
    assert found == sorted((p, s, c) for p in (3, 4) for s, c in (("s1", 1), ("s2", 1), ("s3", 2)))
    assert run("aggregate-deletion-matrix", o("del"), f("eoi.bed"), f("dels.bed"), o("carriers")) == 0
    assert {r.vid: (r.allele_count, r.carriers) for r in spark.read.parquet(o("carriers")).collect()} == {"d1": (4, 3), "d2": (0, 0)}


def test_indels_longer_than_a_margin(spark, files, tmp_path):
    at, text = files
    f, o = (lambda n: str(at / n)), (lambda n: str(tmp_path / n))
    for source in (f("ref.fa"), o("stored")):
        if source == o("stored"):
            assert cli.main(["store-sequence", f("ref.fa"), source]) == 0
        assert cli.main(["enumerate-indels", f("eoi.bed"), "30", source, o("enum")]) == 0
        at_5 = {(r.ref, r.alt) for r in readers.vcf(spark, o("enum")).where("pos = 5").collect()}
        want = {(text[4 : 5 + n], text[4]) for n in range(1, 31)} | {(text[4], text[4] + "N" * n) for n in range(1, 31)}
        assert at_5 == want
    assert cli.main(["simulate-indels", f("eoi.bed"), "60", "1.0", "1.0", f("ref.fa"), o("sim")]) == 0
    rows = readers.vcf(spark, o("sim")).collect()
    assert max(len(r.ref) for r in rows) > 18 and all(text[r.pos - 1 : r.pos - 1 + len(r.ref)] == r.ref for r in rows)


def test_indel_impact_commands(spark, files, tmp_path):
    at, text = files
    f, o = (lambda n: str(at / n)), (lambda n: str(tmp_path / n))
    assert cli.main(["impact-track-insertions", f("eoi.bed"), f("a.vep"), f("ref.fa"), o("ins")]) == 0
    rows = spark.read.parquet(o("ins")).collect()  # the second line's place has no base behind it in T1
    assert [(r.track_pos, r.pos, r.frame, r.neigh) for r in rows] == [(6, 9, 0, text[6:12])]
    assert cli.main(["impact-track-deletions", f("eoi.bed"), f("a.vep"), f("ref.fa"), o("del")]) == 0
    rows = spark.read.parquet(o("del")).orderBy("pos").collect()
    assert [(r.track_pos, r.pos, r.frame, r.neigh) for r in rows] == [(6, 9, 0, text[5:8] + text[9:12]), (9, 12, 0, text[8:11] + text[12:15])]
    assert cli.main(["impact-track-deletions-cds", f("eoi.bed"), f("a.vep"), f("ref.fa"), f("eoi.bed"), o("cds")]) == 0
    rows = spark.read.parquet(o("cds")).orderBy("pos").collect()
    assert [(r.pos, r.cds_neigh) for r in rows] == [(9, text[5:8] + text[9:12]), (12, text[8:11] + "NNN")]


def test_split_annotations(spark, files, tmp_path):
    at, _ = files
    assert cli.main(["separate-annotations", str(at / "a.vep"), str(at / "sizes"), str(tmp_path / "split")]) == 0
    lines = [r.value for r in spark.read.text(str(tmp_path / "split") + "/chrom=1").collect()]
    assert sorted(lines) == sorted((at / "a.vep").read_text().splitlines())


# ---------------------------------------------------------------- matrices, k-mers, motifs


def test_binary_matrix_files(spark, tmp_path):
    width = -(-2 * 6 // 8)
    codes = {(10, 1): [0, 1, 2, 3, 0], (10, 3): [3, 0, 0, 0, 0], (77, 4): [0, 0, 0, 0, 1]}
    data = b""
    for pos in (10, 77):
        data += struct.pack("<i", pos)
        for allele in range(5):
            packed = sum(c << (2 * i) for i, c in enumerate(codes.get((pos, allele), [0] * 5)))
            data += packed.to_bytes(width, "little")
    (tmp_path / "chr7_matrix.bin.gz").write_bytes(gzip.compress(data))
    found = sorted((r.chrom, r.pos, r.alt, r.codes) for r in readers.binary_matrix(spark, str(tmp_path), 5, 2, 5).collect())
    assert found == sorted(("7", p + 1, "ACGTN"[a], c) for (p, a), c in codes.items())


def test_matrix_reader_goes_by_suffix(spark, tmp_path):
    rows = spark.createDataFrame([("c", 5, "v_A_C", [1, 0, -1, 2])], "chrom string, pos long, name string, codes array<int>")
    sinks.write_packed_matrix(rows, str(tmp_path / "m.parquet"), 4)
    assert readers.matrix(spark, str(tmp_path / "m.parquet")).first().codes == [1, 0, 0, 2]
    sinks.write_matrix(rows, str(tmp_path / "m.txt"))
    assert readers.matrix(spark, str(tmp_path / "m.txt")).first().codes == [1, 0, -1, 2]
    (tmp_path / "c_matrix.bin").write_bytes(struct.pack("<iBB", 4, 0b10000001, 0))
    assert readers.matrix(spark, str(tmp_path / "c_matrix.bin"), samples=4).first().codes == [1, 0, 0, 2]
    with pytest.raises(ValueError):
        readers.matrix(spark, str(tmp_path / "c_matrix.bin"))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_gapped_distance_is_the_best_of_all_shifts():
    draw = random.Random(4)
    for _ in range(60):
        a, b = ("".join(draw.choices("ACGT", k=draw.choice([4, 6, 8]))) for _ in range(2))
        a = a[: len(b)].ljust(len(b), "A")
        want = min(plain_edits(a[s:], b[: len(b) - s]) if s >= 0 else plain_edits(a[:s], b[-s:]) for s in range(-3, 4))
        assert sequence.gapped_distance(a, b) == want


def test_kmer_lists_are_bounded(spark):
    with pytest.raises(ValueError):
        sequence.kmer_distances(spark.range(12).selectExpr("cast(id AS string) AS kmer"), most=10)


def test_a_planted_motif_is_found(spark):
    """Fitted weights tell sequences with the k-mer from shuffled ones."""
    made = sequence.random_sequences(spark, 300, 40, 3, "GATTACA", 0.05)
    fits = [sequence.fit_motif(made, "id", 7, rounds=12, seed=s) for s in range(4)]
    null = made.select("id", sequence.shuffled(F.col("seq"), 5, F.col("id")).alias("seq"))

    def mean(frame, weights):
        return sequence.motif_scan(frame, "id", weights).agg(F.avg("score")).first()[0]

    assert max(mean(made, w) - mean(null, w) for w in fits) > 2.0
    # Settled weights are those of the windows they choose.
    settled = sequence.fit_motif(made, "id", 7, rounds=60, seed=0)
    rows = sequence.motif_scan(made, "id", settled).collect()
    counts = np.ones((7, 4))
    for r in rows:
        for i, b in enumerate(r.kmer):
            counts[i, "ACGT".index(b)] += 1
    assert np.allclose(np.log(counts / counts.sum(1, keepdims=True)), [[w[b] for b in "ACGT"] for w in settled], atol=0.2)


def test_draws_are_even_and_repeatable(spark):
    rows = spark.range(20_000).select("id", simulate.uniform(3, F.col("id")).alias("u"))
    found = [r.u for r in rows.orderBy("id").collect()]
    assert found == [r.u for r in rows.repartition(7).orderBy("id").collect()]
    assert np.histogram(found, 10, (0, 1))[0].min() > 1_800 and abs(np.mean(found) - 0.5) < 0.01
    ordered = [r.id for r in simulate.permuted(spark.range(50), 2, "id").collect()]
    assert sorted(ordered) == list(range(50)) and ordered != list(range(50))
    normals = [r.x for r in spark.range(20_000).select(simulate.normal(4, F.col("id")).alias("x")).collect()]
    assert abs(np.mean(normals)) < 0.03 and abs(np.std(normals) - 1) < 0.03


def test_haplotypes_drop_lines_without_genotypes(spark):
    rows = [("c", 1, "v", "A", "C", "DP:GT", ["3:0|1", "2:."]), ("c", 2, "w", "A", "C", "GT", ["1|0", "./."]), ("c", 3, "x", "A", "C", "DP", ["3", "4"])]
    frame = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, format string, calls array<string>")
    bases = spark.createDataFrame([("c", 2, "G")], "chrom string, pos long, base string")
    assert [(r.name, r.codes) for r in genotypes.haplotype_matrix(frame).collect()] == [("w_A_C", [2, -1])]
    assert genotypes.haplotype_matrix(frame, bases).count() == 0
    assert [r.pos for r in genotypes.wrong_references(frame, bases).collect()] == [2]


@pytest.mark.parametrize("length,stranded", [(30, False), (30, True), (4_000, False), (60_000, True)])
def test_first_overlaps_over_stretches(spark, monkeypatch, length, stranded):
    monkeypatch.setattr(regions, "STRETCH", 1 << 12)
    mine, a = made_regions(spark, 300, 40, seed=3)
    theirs, b = made_regions(spark, 300, length, seed=4)
    bad = spark.createDataFrame([("c0", 900, 100, "T1", "+", 7_000), (None, 1, 300_000, "T1", "+", 7_001), ("c1", None, 5, "T1", "+", 7_002)], a.schema)
    found = overlap.first_overlap(a.unionByName(bad.withColumn("row_id", F.col("row_id") + 1_000)), b.unionByName(bad), "row_id", stranded)
    want = {}
    for x in mine:
        hits = [y for y in theirs if y[0] == x[0] and y[1] <= x[2] and x[1] <= y[2] and (not stranded or x[4] == y[4])]
        if hits:
            y = min(hits, key=lambda y: (y[1], y[2], y[3], y[4], y[5]))
            want[x[5]] = (y[5], max(x[1], y[1]), min(x[2], y[2]))
    rows = found.collect()
    assert {r.row_id: (r.b_row_id, r.o_start, r.o_end) for r in rows} == want and len(rows) == len(want)


def test_first_overlaps_make_no_pairs(spark):
    many = spark.range(40_000).selectExpr("'c0' AS chrom", "id % 50 + 1 AS start", "id % 50 + 60 AS end", "concat('T', id) AS name", "'+' AS strand", "id AS row_id")
    found = overlap.first_overlap(many, many, "row_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan and "Generate explode" not in plan
    assert found.where("b_row_id = 0").count() == 40_000


def test_running_bounds_read_a_stretch_once(spark, monkeypatch):
    monkeypatch.setattr(regions, "STRETCH", 1 << 10)
    rows, frame = made_regions(spark, 400, 300, seed=6)
    found = regions.running_bounds(frame)
    # A frame of all rows that follow is read anew for every row.
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    want, top = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], len(r[3]), r[3])):
        top[r[0]] = max(top.get(r[0], 0), r[2])
        want[r[5]] = (top[r[0]], r[1])
    assert {r.row_id: (r.running_end, r.rest_start) for r in found.collect()} == want


def made_cells(spark):
    """Variants that share places, deletions that share bases, genotypes with repeats and some of no variant."""
    draw = random.Random(8)
    regs = [("c0", s, s + draw.randint(0, 30), f"T{i % 4}", "+", i) for i, s in enumerate(draw.randint(1, 80) for _ in range(25))]
    axis = tracks.axis(spark.createDataFrame(regs, "chrom string, start long, end long, name string, strand string, row_id long"))
    snvs = [("c0", draw.randint(1, 90), "A", draw.choice("CG"), i) for i in range(60)]
    dels = [("c0", draw.randint(1, 90), "ACGTA"[: draw.randint(2, 5)], "A", 100 + i) for i in range(40)]
    variants = spark.createDataFrame(snvs + dels, "chrom string, pos long, ref string, alt string, vid long")
    calls = [(draw.randint(0, 160), draw.randint(1, 6), draw.randint(0, 2)) for _ in range(900)]
    return axis, snvs, dels, variants, calls, spark.createDataFrame(calls, "vid long, sample long, dosage int")


def test_matrices_unite_variants_that_share_cells(spark):
    axis, snvs, dels, variants, calls, genotypes_ = made_cells(spark)
    spans = axis.collect()
    want, lost = {}, {}
    for vid, sample, dosage in calls:
        if dosage > 0:
            for c, pos, _, alt, v in snvs:
                for r in spans:
                    if v == vid and r.start <= pos <= r.end:
                        key = (r.track_offset + pos - r.start, alt, sample)
                        want[key] = want.get(key, 0) | dosage
            for c, pos, ref, alt, v in dels:
                for r in spans:
                    if v == vid and r.start <= pos + 1 and pos + len(ref) - 1 <= r.end:
                        for p in range(pos + 1, pos + len(ref)):
                            lost[(r.track_offset + p - r.start, sample)] = lost.get((r.track_offset + p - r.start, sample), 0) | dosage
    matrix = genotypes.snv_matrix(genotypes_, variants, axis)
    rows = matrix.collect()
    assert {(r.track_pos, r.alt, r.sample): r.code for r in rows} == want and len(rows) == len(want)
    rows = genotypes.deletion_matrix(genotypes_, variants, axis).collect()
    assert {(r.track_pos, r.sample): r.code for r in rows} == lost and len(rows) == len(lost)
    # Counts without the matrix, and back at the variants, each as often as an element holds it.
    sums = {}
    for (tp, alt, _), code in want.items():
        sums[(tp, alt)] = sums.get((tp, alt), 0) + code
    counts = genotypes.snv_counts(genotypes_, variants, axis)
    assert {(r.track_pos, r.alt): r.n for r in counts.collect()} == sums
    hits = {v: [(r.track_offset + pos - r.start, alt) for r in spans if r.start <= pos <= r.end] for _, pos, _, alt, v in snvs + dels}
    asked = {v: sum(sums.get(k, 0) for k in ks) for v, ks in hits.items() if ks}
    for found in (genotypes.counts_of_interest(counts, variants, axis), genotypes.matrix_counts(matrix, variants, axis)):
        assert {r.vid: r.allele_count for r in found.collect()} == asked


def last_steps(frame):
    """The optimized plan above its first interval join."""
    return frame._jdf.queryExecution().optimizedPlan().toString().split("_bin")[0]


def test_no_row_per_cell_and_sample_is_grouped(spark):
    axis, _, _, variants, _, genotypes_ = made_cells(spark)
    for found in (genotypes.snv_matrix(genotypes_, variants, axis), genotypes.deletion_matrix(genotypes_, variants, axis)):
        assert "Join" in found._jdf.queryExecution().optimizedPlan().toString().splitlines()[1]
    listed = variants.selectExpr("chrom", "pos", "ref", "alt", "'GT' AS format", "array('0|1', '1|1') AS calls")
    found = genotypes.encoded_snvs(listed, ["a", "b"], axis)
    assert "Aggregate" not in last_steps(found)
    assert found.groupBy("chrom", "track_pos", "alt", "sample").count().where("count > 1").count() == 0


def test_effects_read_sequences_before_the_interval_join(spark):
    regs = spark.createDataFrame([("c0", 1, 9, "T1", "+", "CDS", 0)], "chrom string, start long, end long, name string, strand string, element_type string, before long")
    variants = spark.createDataFrame([("c0", 4, "A", "C", 1)], "chrom string, pos long, ref string, alt string, vid long")
    seqs = spark.createDataFrame([("T1", "ATGAAATAA")], "name string, seq string")
    found = effects.variant_effects(variants, regs, seqs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan.split("Join Inner")[0]
    assert [tuple(r) for r in found.collect()] == [(1, "T1", "CDS", "CDS_NONSYNONYMOUS", "Lys", "Gln")]


def annovar_rows(spark):
    changes = ["G:T1.12:exon1,G:T2.1.3", "G:T1", ":T3.4:x", "UNKNOWN", ".", "", "G:.:x,G::y,G:.7", ",G:T1.9,:", None]
    rows = [(i, c, d) for i, (c, d) in enumerate((c, d) for c in changes for d in ("X1.2:exon3;.", ";X2;;X2.1:a:b", ".", ":x;X3", "", None))]
    return rows, spark.createDataFrame(rows, "vid long, aa_change string, detail string")


def test_elements_of_annovar_fields(spark):
    rows, frame = annovar_rows(spark)
    for r in concord.annovar_elements(frame).collect():
        _, changes, details = rows[r.vid]
        if changes is None or details is None:
            assert r.elements is None
            continue
        named = [x.split(":")[1] for x in changes.split(",") if ":" in x] + [x.split(":")[0] for x in details.split(";")]
        assert r.elements == list(dict.fromkeys(re.sub(r"\.\d+$", "", x) for x in named if x not in ("", "."))), rows[r.vid]


def test_annovar_text_is_not_parsed_for_candidate_pairs(spark):
    """A filter inferred from the list of elements would stand in the condition of the interval join."""
    for name in ("annovar_other_specific", "annovar_not_existing"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join Inner" in x]
        assert joins and not any("regexp" in x for x in joins) and "collect_set" not in plan


def test_translated_terms_beyond_one_mask(spark):
    pairs = [(f"s{i:03}", f"t{i // 2:03}") for i in range(150)] + [("s001", "t074"), ("odd", None)]
    rows = [(i, ["E"], terms) for i, terms in enumerate([["s000", "s149"], ["s001"], ["none"], [], None, ["s124", "s125", None], ["odd"]])]
    rows.append((0, ["E", "F"], ["s003"]))
    own = spark.createDataFrame([(i, "E", ["t000", "t062"]) for i in range(7)], "vid long, element string, terms array<string>")
    annovar = spark.createDataFrame(rows, "vid long, elements array<string>, terms array<string>")
    found = concord.compare_annovar_by_element(own, annovar, spark.createDataFrame(pairs, "source string, target string"))
    want = {}
    for vid, _, terms in rows:
        want.setdefault(vid, set()).update(t for s, t in pairs if t and s in (terms or []))
    got = sorted((r.vid, r.term) for r in found.other_specific.collect())
    assert got == sorted((v, t) for v, ts in want.items() for t in ts - {"t000", "t062"})
    got = sorted((r.vid, r.term) for r in found.own_specific.collect())
    assert got == sorted((v, t) for v, ts in want.items() for t in {"t000", "t062"} - ts)
    assert [(r.vid, r.element, r.terms) for r in found.not_existing.collect()] == [(0, "F", ["t001"])]


def test_placed_annotations_are_compared_as_their_rows_would_be(spark):
    draw = random.Random(9)
    names = [f"t{i}" for i in range(6)]
    regs = spark.createDataFrame([("c0", s, s + draw.randint(0, 25), draw.choice(["A", "B", "C", None]), i) for i, s in enumerate(draw.randint(1, 60) for _ in range(40))], "chrom string, start long, end long, name string, row_id long")
    # Ids repeat, and an id's place differs between the sides or is not known.
    side = lambda: [(draw.randint(0, 25), draw.choice(["c0"] * 9 + [None]), draw.choice([draw.randint(1, 70), 30, None]), draw.sample(names, draw.randint(0, 3))) for _ in range(60)]
    own, other = (spark.createDataFrame(side(), "vid long, chrom string, pos long, terms array<string>") for _ in range(2))
    hits = lambda rows: overlap.points_in(rows, regs).select("vid", F.col("r_name").alias("element"), "terms")
    want = concord.compare_annotations(hits(own), hits(other), names[:4], names[2:5])
    got = concord.compare_placed(own, other, regs, names[:4], names[2:5])
    for report in ("other_specific", "own_specific", "other_specific_high", "own_specific_high", "matched", "high_disagreement", "not_existing"):
        a, b = (sorted(map(repr, getattr(x, report).collect())) for x in (want, got))
        assert a == b and a, report


def test_concordance_makes_no_row_per_region(spark):
    """Rows of both sides meet by variant; only counts of regions per place come out of the interval join."""
    plan = QUERIES["concord_own_specific"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert any("o_vid" in x for x in joins) and not any("o_vid" in x and "element" in x for x in joins)
    assert "count(1)" in plan


def test_deletions_of_one_base_meet_the_elements_once(spark):
    """Deletions that overlap, hold one another and repeat; elements that cut some of them; compared with plain Python."""
    draw = random.Random(11)
    regs = [("c0", s, s + draw.randrange(1, 14), f"T{i}", i) for i, s in enumerate(draw.randrange(1, 50) for _ in range(60))] + [("c1", 1, 9, "T0", 60)]
    axis = tracks.axis(spark.createDataFrame(regs, "chrom string, start long, end long, name string, row_id long")).cache()
    calls = ["0|0", "0|1", "1|0", "1/1", "./."]
    dels = [(draw.choice(["c0", "c0", "c1"]), draw.randrange(1, 50), "ACGTACGT"[: draw.randrange(2, 9)], "A", "GT:DP", [f"{draw.choice(calls)}:7" for _ in range(3)]) for _ in range(150)]
    vcf = spark.createDataFrame(dels, "chrom string, pos long, ref string, alt string, format string, calls array<string>")
    spans = axis.collect()
    for encoding, codes in ((genotypes.EXISTENCE, [0, 1, 1, 1, 0]), (genotypes.GENO, [0, 1, 1, 2, 0]), (genotypes.HAPLO, [0, 1, 2, 3, -1])):
        want = {}
        for chrom, pos, ref, _, _, fields in dels:
            start, end = pos + 1, pos + len(ref) - 1
            for r in (r for r in spans if r.chrom == chrom and r.start <= start and end <= r.end):
                for sample, field in zip("abc", fields):
                    if (code := codes[calls.index(field[:3])]) > 0:
                        for base in range(start, end + 1):
                            key = (chrom, r.track_offset + base - r.start, sample)
                            want[key] = want.get(key, 0) | code
        for size in (4, 256):
            found = genotypes.encoded_deletions(vcf, ["a", "b", "c"], axis, encoding, size).collect()
            assert len(found) == len(want) > 500 and {tuple(r)[:3]: r.code for r in found} == want
    plan = genotypes.encoded_deletions(vcf, ["a", "b", "c"], axis)
    assert "Aggregate" not in last_steps(plan)


def test_placed_annovar_lines_are_compared_as_their_rows_would_be(spark, monkeypatch):
    """Several lines a variant, lines with elements of their own, places that no line names; blocks of three elements."""
    draw = random.Random(13)
    regs = [("c0", s, s + draw.randint(0, 20), draw.choice(["A", "B", "C", "D", None]), i) for i, s in enumerate(draw.randint(1, 40) for _ in range(60))]
    regions_ = spark.createDataFrame(regs, "chrom string, start long, end long, name string, row_id long")
    place = {vid: draw.randint(1, 60) for vid in range(40)}
    own = [(vid, "c0", place[vid], draw.sample(["t0", "t1", "t2", "other"], draw.randint(0, 3))) for vid in (draw.randint(0, 39) for _ in range(60))]
    lines = [(vid, "c0", place[vid], draw.choice([None, [], ["B"], ["C", "X", "C"]]), draw.sample(["s0", "s1", "s2", "none"], draw.randint(0, 2))) for vid in (draw.randint(0, 39) for _ in range(60))]
    named = [("c0", pos, draw.choice([None, [], ["A"], ["A", "D", "Y"]])) for pos in range(1, 55)]
    own_ = spark.createDataFrame(own, "vid long, chrom string, pos long, terms array<string>")
    lines_ = spark.createDataFrame(lines, "vid long, chrom string, pos long, elements array<string>, terms array<string>")
    named_ = spark.createDataFrame(named, "chrom string, pos long, elements array<string>")
    terms = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(3)], "source string, target string")
    hits = overlap.points_in(own_, regions_).select("vid", F.col("r_name").alias("element"), "terms")
    known = {pos: e or [] for _, pos, e in named}
    full = spark.createDataFrame([(v, (e or []) + known.get(p, []), t) for v, _, p, e, t in lines], "vid long, elements array<string>, terms array<string>")
    want = concord.compare_annovar_by_element(hits, full, terms)
    monkeypatch.setattr(concord, "_BLOCK", 3)
    got = concord.compare_annovar_placed(own_, lines_, named_, regions_, terms)
    for report in ("other_specific", "own_specific", "other_specific_high", "own_specific_high", "matched", "high_disagreement", "not_existing"):
        a, b = (sorted(map(repr, getattr(x, report).collect())) for x in (want, got))
        assert a == b and a, report


def test_annovar_reports_make_no_row_per_region(spark):
    """Terms are compared once per own row; own rows meet lists of elements and never regions."""
    for name in ("annovar_matched", "annovar_own_specific", "annovar_other_specific"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(elements" in plan.split("Join")[0] and not any("vid" in x for x in plan.splitlines() if "_bin#" in x), name


def test_effects_of_like_variants_are_found_once(spark):
    """Rows of variants of one place and one kind of change, repeats and missing ids among them, and one join row for them."""
    regs = [("c0", 1, 9, "R1", "+", "CDS", 0, None, None), ("c0", 4, 12, "R2", "-", "intron", 0, "GT", "AG"), ("c0", 5, 30, "R3", "-", "CDS", 0, None, None)]
    regions_ = spark.createDataFrame(regs, "chrom string, start long, end long, name string, strand string, element_type string, before long, first2 string, last2 string")
    seqs = spark.createDataFrame([("R1", "ATGAAATAA"), ("R3", "ACGTACGTACGTACGTACGTACGTAC")], "name string, seq string")
    draw = random.Random(17)
    rows = [("c0", draw.choice([4, 5, 11]), *draw.choice([("A", "C"), ("A", "G"), ("G", "C"), ("A", "ATT"), ("C", "CGG"), ("ACG", "A"), ("TTG", "T"), ("AC", "GT"), ("A", None)]), draw.choice([None, *range(30)])) for _ in range(120)]
    schema = "chrom string, pos long, ref string, alt string, vid long"
    found = effects.variant_effects(spark.createDataFrame(rows, schema), regions_, seqs)
    want = []
    for i, row in enumerate(sorted(set(r[:4] for r in rows), key=repr)):
        alone = effects.variant_effects(spark.createDataFrame([(*row, i)], schema), regions_, seqs).collect() if i < 8 else None
        if alone is not None:
            want += [(repr((r[4], *tuple(a)[1:]))) for r in rows if r[:4] == row for a in alone]
    some = {r[4] for r in rows}
    got = sorted(repr(tuple(r)) for r in found.collect())
    assert want and len(some) > 20 and not set(want) - set(got)
    spans = {r[3]: (r[1], r[2]) for r in regs}
    assert len(got) == sum(1 for r in rows for a, b in spans.values() if r[1] <= b and r[1] + len(r[2]) - 1 >= a)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(elements" in plan.split("Join")[0]


def test_deletions_by_place_are_those_of_the_product(spark):
    """Names with several regions over a place, several bases annotated, bases without."""
    draw = random.Random(19)
    regs = [("c0", s, s + draw.randint(2, 25), draw.choice(["A", "B", "C", "D", None]), draw.choice("+-"), i) for i, s in enumerate(draw.randint(1, 60) for _ in range(60))]
    axis = tracks.axis(spark.createDataFrame(regs, "chrom string, start long, end long, name string, strand string, row_id long")).cache()
    anns = [("c0", p, e, draw.getrandbits(37) & draw.getrandbits(37), draw.randint(0, 2)) for p in range(1, 80) for e in "ABCX" if draw.random() < 0.6]
    annotations = spark.createDataFrame(anns, "chrom string, pos long, element string, mask long, frame int").cache()
    bases = spark.createDataFrame([("c0", 1, "".join(draw.choice("ACGT") for _ in range(100)))], "chrom string, pos long, seq string")
    chunks = tracks.assembled(bases, 64).cache()
    dels = [("c0", draw.randint(1, 70), "ACGTAC"[: draw.randint(2, 6)], "A", draw.randint(0, 50)) for _ in range(120)]
    variants = spark.createDataFrame(dels, "chrom string, pos long, ref string, alt string, vid long").distinct()
    product = tracks.impact_track(annotations.withColumn("line_no", F.lit(1)), axis, chunks, per_allele=False, chunk=64)
    for compat in (False, True):
        want = sorted(map(repr, translate.translate_deletions(variants, axis, product, compat=compat).collect()))
        found = translate.translate_deletions_placed(variants, axis, annotations, chunks, 64, compat=compat)
        assert sorted(map(repr, found.collect())) == want and len(want) > 500
    plan = QUERIES["translate_del"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(elements" in plan.split("Join")[0] and not any("vid" in x for x in plan.splitlines() if "Aggregate" in x and "collect_list" in x)
