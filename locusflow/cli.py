"""Command line: ``python -m locusflow.cli COMMAND ARG...``.

Each command reads files, runs operators and writes files; a missing input or a wrong number of
arguments ends with a non-zero status.  ``COMMANDS`` lists them with their arguments.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import concord, elements, genotypes, overlap, simulate, tracks, translate
from .sources import readers, sinks

COMMANDS: dict[str, tuple[list[str], Callable]] = {}


def command(*arguments: str):
    def register(f):
        COMMANDS[f.__name__.replace("_", "-")] = (list(arguments), f)
        return f

    return register


def _axis(spark: SparkSession, path: str) -> DataFrame:
    return tracks.axis(readers.bed(spark, path, strict=True).withColumn("row_id", F.col("line_no")))


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Bases of a FASTA file or of stored chunks."""
    if path.removesuffix(".gz").endswith((".fa", ".fasta")):
        return readers.fasta(spark, path)
    chunks = sinks.read_sequence(spark, path)
    own = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.struct((F.col("first") + i).alias("pos"), F.substring("seq", i + 1, F.lit(1)).alias("base")))
    flat = chunks.select("chrom", "chunk", F.explode(own).alias("x")).select("chrom", "chunk", "x.pos", "x.base")
    return flat.where(F.floor(F.col("pos") / tracks.CHUNK) == F.col("chunk")).drop("chunk")


def _chunks(spark: SparkSession, path: str, margin: int = tracks.MARGIN) -> DataFrame:
    """Sequence chunks of a FASTA file or as stored, with at least the margin."""
    if path.removesuffix(".gz").endswith((".fa", ".fasta")):
        return readers.fasta_chunks(spark, path, margin)
    chunks = sinks.read_sequence(spark, path)
    return tracks.with_margin(chunks, margin) if margin > tracks.MARGIN else chunks


def _vcf(spark: SparkSession, path: str) -> DataFrame:
    return readers.vcf(spark, path, split_alts=True).withColumn("vid", F.col("id"))


# ---------------------------------------------------------------- converters and splitters


def _convert(kind: str):
    def run(spark, annotations, term_map, out):
        rows = concord.converted_annotations(readers.effect_annotations(spark, annotations), readers.term_map(spark, term_map), kind)
        columns = ["uploaded_variation", "location", "allele", F.lit("."), "feature", "feature_type", "consequence", F.lit("."), "cds_position"]
        text = F.concat_ws("\t", *[F.col(c) if isinstance(c, str) else c for c in columns])
        rows.orderBy("line_no").select(text.alias("value")).write.mode("overwrite").text(out)

    return run


for _kind, _name in (("DEL", "convert-deletion-annotations"), ("INS", "convert-insertion-annotations"), ("SNV", "convert-snv-annotations")):
    COMMANDS[_name] = (["annotations", "term_map", "out"], _convert(_kind))


@command("vcf", "sizes", "out")
def separate_vcf(spark, vcf, sizes, out):
    known = readers.chromosome_sizes(spark, sizes).select("chrom")
    sinks.split_by_chromosome(readers.vcf(spark, vcf, raw=True).join(F.broadcast(known), "chrom", "left_semi"), out)


@command("annotations", "sizes", "out")
def separate_annotations(spark, annotations, sizes, out):
    rows = readers.vep(spark, annotations, raw=True).withColumn("chrom", F.split("location", ":")[0])
    known = readers.chromosome_sizes(spark, sizes).select("chrom")
    sinks.split_by_chromosome(rows.join(F.broadcast(known), "chrom", "left_semi"), out)


@command("fasta", "out")
def store_sequence(spark, fasta, out):
    sinks.write_chunks(readers.fasta_chunks(spark, fasta), out)


# ---------------------------------------------------------------- elements


@command("ids", "gff", "feature", "level", "extension", "out")
def elements_of_interest(spark, ids, gff, feature, level, extension, out):
    found = elements.elements_of_interest(readers.gff(spark, gff), readers.id_list(spark, ids), feature, level.lower(), int(extension))
    sinks.write_bed(found, out)


@command("genes", "feature", "gff", "extension", "out")
def frame_unique_elements(spark, genes, feature, gff, extension, out):
    first, again = elements.frame_unique_elements(readers.gff(spark, gff), readers.id_list(spark, genes), feature, int(extension))
    sinks.write_bed(first, out)
    sinks.write_bed(again, out + "_redundant")


# ---------------------------------------------------------------- tracks


def _impacts(insertions: bool, per_allele: bool):
    def run(spark, eoi, annotations, sequence, out):
        axis = _axis(spark, eoi)
        rows = tracks.parsed_annotations(readers.vep(spark, annotations), insertions)
        found = tracks.impact_track(rows, axis, _chunks(spark, sequence), per_allele, adjacent=insertions)
        found.write.mode("overwrite").parquet(out)
        tracks.unmatched_annotations(rows, axis).write.mode("overwrite").parquet(out + "_unmatched")

    return run


COMMANDS["impact-track-snv"] = (["eoi", "annotations", "sequence", "out"], _impacts(False, True))
COMMANDS["impact-track-insertions"] = (["eoi", "annotations", "sequence", "out"], _impacts(True, False))
COMMANDS["impact-track-deletions"] = (["eoi", "annotations", "sequence", "out"], _impacts(False, False))


@command("eoi", "annotations", "sequence", "cds", "out")
def impact_track_deletions_cds(spark, eoi, annotations, sequence, cds, out):
    """Deletion impacts with the neighbourhood in the spliced CDS beside the genome's."""
    axis, chunks = _axis(spark, eoi), _chunks(spark, sequence)
    rows = tracks.parsed_annotations(readers.vep(spark, annotations))
    found = tracks.impact_track(rows, axis, chunks, per_allele=False)
    placed = translate.with_cds_neighbours(found, axis, readers.bed(spark, cds), chunks)
    placed.write.mode("overwrite").parquet(out)


def _variant_track(make: Callable):
    def run(spark, eoi, vcf, out):
        make(_vcf(spark, vcf), _axis(spark, eoi)).write.mode("overwrite").parquet(out)

    return run


COMMANDS["variant-track-snv"] = (["eoi", "vcf", "out"], _variant_track(tracks.snv_track))
COMMANDS["variant-track-insertions"] = (["eoi", "vcf", "out"], _variant_track(tracks.insertion_track))
COMMANDS["variant-track-deletions"] = (["eoi", "vcf", "out"], _variant_track(tracks.deletion_track))
COMMANDS["variant-track-non-coding"] = (["eoi", "vcf", "out"], _variant_track(tracks.elements_hit))


def _multiply(per_allele: bool):
    def run(spark, impacts, presence, out):
        tracks.multiply(spark.read.parquet(impacts), spark.read.parquet(presence), per_allele).write.mode("overwrite").parquet(out)

    return run


COMMANDS["multiply-snv"] = (["impacts", "presence", "out"], _multiply(True))
COMMANDS["multiply-indels"] = (["impacts", "presence", "out"], _multiply(False))


@command("eoi", "product", "out")
def extract_annotated(spark, eoi, product, out):
    tracks.decoded_terms(spark.read.parquet(product), _axis(spark, eoi)).write.mode("overwrite").parquet(out)


def _translate(make: Callable):
    def run(spark, eoi, product, vcf, out):
        make(_vcf(spark, vcf), _axis(spark, eoi), spark.read.parquet(product)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(out)

    return run


COMMANDS["translate-snv"] = (["eoi", "product", "vcf", "out"], _translate(translate.translate_snv))
COMMANDS["translate-insertions"] = (["eoi", "product", "vcf", "out"], _translate(translate.translate_insertions))
COMMANDS["translate-deletions"] = (["eoi", "product", "vcf", "out"], _translate(translate.translate_deletions))

# ---------------------------------------------------------------- genotypes


def _encode(make: Callable):
    def run(spark, vcf, samples, eoi, encoding, out):
        names = [r.id for r in readers.id_list(spark, samples).orderBy("line_no").collect()]
        make(readers.vcf(spark, vcf, genotypes=True), names, _axis(spark, eoi), int(encoding)).write.mode("overwrite").parquet(out)

    return run


COMMANDS["encode-snv-matrix"] = (["vcf", "samples", "eoi", "encoding", "out"], _encode(genotypes.encoded_snvs))
COMMANDS["encode-deletion-matrix"] = (["vcf", "samples", "eoi", "encoding", "out"], _encode(genotypes.encoded_deletions))


def _interest(spark: SparkSession, path: str) -> DataFrame:
    name = F.split("name", " ")
    return readers.bed(spark, path).withColumns({"pos": F.col("start"), "ref": name[0], "alt": name[1], "vid": F.col("name")})


@command("matrix", "eoi", "voi", "out")
def aggregate_snv_matrix(spark, matrix, eoi, voi, out):
    genotypes.matrix_counts(spark.read.parquet(matrix), _interest(spark, voi), _axis(spark, eoi)).write.mode("overwrite").parquet(out)


@command("matrix", "eoi", "voi", "out")
def aggregate_deletion_matrix(spark, matrix, eoi, voi, out):
    axis = _axis(spark, eoi)
    spans = axis.select("chrom", F.col("track_offset").alias("start"), (F.col("track_offset") + F.col("end") - F.col("start")).alias("end"), "name", F.col("start").alias("g_start"))
    placed = overlap.points_in(spark.read.parquet(matrix), spans, position="track_pos")
    genome = placed.select("chrom", (F.col("r_g_start") + F.col("track_pos") - F.col("r_start")).alias("pos"), "sample", "code").distinct()
    genotypes.deletion_carriers(genome, _interest(spark, voi).select("chrom", "start", "end", "vid")).write.mode("overwrite").parquet(out)


# ---------------------------------------------------------------- concordance


def _own(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select("vid", "element", F.filter(F.split("impact", ";"), lambda x: x != "").alias("terms"))


def _write_reports(found: concord.Reports, out: str) -> None:
    for name in found.__dataclass_fields__:
        getattr(found, name).write.mode("overwrite").parquet(f"{out}/{name}")


@command("annotations", "focus", "high", "annotated", "out")
def compare_annotations(spark, annotations, focus, high, annotated, out):
    rows = readers.vep(spark, annotations).select(F.col("uploaded_variation").alias("vid"), F.col("feature").alias("element"), F.col("consequence").alias("terms"))
    lists = [[r.id for r in readers.id_list(spark, p).collect()] for p in (focus, high)]
    _write_reports(concord.compare_annotations(_own(spark, annotated), rows, *lists), out)


@command("annovar", "term_map", "annotated", "out")
def compare_annovar_by_element(spark, annovar, term_map, annotated, out):
    rows = concord.annovar_elements(concord.annovar_terms(readers.annovar(spark, annovar)))
    _write_reports(concord.compare_annovar_by_element(_own(spark, annotated), rows, readers.term_map(spark, term_map)), out)


@command("annovar", "term_map", "transcripts", "annotated", "out")
def compare_annovar_by_variant(spark, annovar, term_map, transcripts, annotated, out):
    rows = concord.annovar_terms(readers.annovar(spark, annovar))
    found = concord.compare_annovar_by_variant(_own(spark, annotated), rows, readers.term_map(spark, term_map), readers.id_list(spark, transcripts))
    found.write.mode("overwrite").parquet(out)


# ---------------------------------------------------------------- simulation


def _element_bases(spark: SparkSession, eoi: str, sequence: str) -> DataFrame:
    return simulate.element_bases(readers.bed(spark, eoi, strict=True).withColumn("row_id", F.col("line_no")), _bases(spark, sequence))


@command("eoi", "probability", "sequence", "out")
def simulate_snvs(spark, eoi, probability, sequence, out):
    sinks.write_vcf(simulate.simulate_snvs(_element_bases(spark, eoi, sequence), float(probability)), out)


@command("eoi", "longest", "probability", "deletions", "sequence", "out")
def simulate_indels(spark, eoi, longest, probability, deletions, sequence, out):
    n = int(longest)
    rows = tracks.with_window(_element_bases(spark, eoi, sequence), _chunks(spark, sequence, n), "pos", 1, n, "_w")
    rows = rows.withColumns({"before": F.substring("_w", 1, 1), "following": F.substring("_w", 2, n)})
    sinks.write_vcf(simulate.simulate_indels(rows, n, float(probability), float(deletions)), out)


@command("eoi", "sequence", "out")
def enumerate_snvs(spark, eoi, sequence, out):
    sinks.write_vcf(simulate.enumerate_snvs(_element_bases(spark, eoi, sequence)), out)


@command("eoi", "longest", "sequence", "out")
def enumerate_indels(spark, eoi, longest, sequence, out):
    n = int(longest)
    rows = tracks.with_window(_element_bases(spark, eoi, sequence), _chunks(spark, sequence, n), "pos", 0, n, "_w")
    sinks.write_vcf(simulate.enumerate_indels(rows.withColumn("following", F.substring("_w", 2, n)), n), out)


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in COMMANDS:
        print("commands:", file=sys.stderr)
        for name, (names, _) in sorted(COMMANDS.items()):
            print(f"  {name} {' '.join(names).upper()}", file=sys.stderr)
        return 2
    names, run = COMMANDS[arguments[0]]
    if len(arguments) - 1 != len(names):
        print(f"{arguments[0]} takes: {' '.join(names)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"locusflow {arguments[0]}").getOrCreate()
    run(spark, *arguments[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
