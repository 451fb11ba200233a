"""Writers of the line and binary formats.  They turn 1-based rows back into each format's convention."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(df: DataFrame, path: str, *columns, sort: list | None = None, partition: str | None = None) -> None:
    row = F.concat_ws("\t", *[c.cast("string") for c in columns])
    rows = df.select(row.alias("value"), *([F.col(partition)] if partition else []), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(sort or [])])
    keys = [f"_s{i}" for i in range(len(sort or []))]
    if partition:
        rows = rows.repartition(partition).sortWithinPartitions(partition, *keys)
    elif keys:
        rows = rows.orderBy(*keys)
    writer = rows.drop(*keys).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def write_bed(regions: DataFrame, path: str) -> None:
    """BED6, or BED3 for rows whose strand is not + or -."""
    known = F.col("strand").isin("+", "-") if "strand" in regions.columns else F.lit(False)
    name = F.col("name") if "name" in regions.columns else F.lit(".")
    score = F.col("score") if "score" in regions.columns else F.lit(".")
    strand = F.col("strand") if "strand" in regions.columns else F.lit(None).cast("string")
    extra = [F.when(known, c.cast("string")) for c in (name, score, strand)]
    _text(regions, path, F.col("chrom"), F.col("start") - 1, F.col("end"), *extra, sort=["chrom", "start", "end"])


def write_bed_with_p_values(regions: DataFrame, path: str) -> None:
    """BED6 with log p and log q behind it."""
    columns = [F.col(c) for c in ("name", "score", "strand", "log_p", "log_q")]
    _text(regions, path, F.col("chrom"), F.col("start") - 1, F.col("end"), *columns, sort=["chrom", "start", "end"])


def write_p_values(regions: DataFrame, path: str) -> None:
    """Name, log p and log q of each region, the least p first."""
    _text(regions, path, F.col("name"), F.col("log_p"), F.col("log_q"), sort=["log_p", "name"])


def write_interval(composites: DataFrame, path: str) -> None:
    starts = F.array_join(F.transform("intervals", lambda x: (x["start"] - 1).cast("string")), ",")
    ends = F.array_join(F.transform("intervals", lambda x: x["end"].cast("string")), ",")
    _text(composites, path, F.col("name"), F.col("chrom"), F.col("strand"), F.col("start") - 1, F.col("end"), F.size("intervals"), starts, ends, sort=["chrom", "start"])


def gff_rows(composites: DataFrame, source: str = ".", feature: str = "region", child: str = "interval") -> DataFrame:
    """Parent rows and one child row per interval, as GFF columns."""
    ident = F.concat(F.lit("ID="), F.col("name"))
    parents = composites.select("chrom", F.lit(source).alias("source"), F.lit(feature).alias("feature"), "start", "end", "strand", ident.alias("attributes"))
    flat = composites.select("chrom", "strand", "name", F.explode("intervals").alias("i"))
    children = flat.select(
        "chrom", F.lit(source).alias("source"), F.lit(child).alias("feature"), F.col("i.start").alias("start"), F.col("i.end").alias("end"), "strand",
        F.concat(F.lit("Parent="), F.col("name")).alias("attributes"),
    )
    return parents.unionByName(children)


def write_gff(rows: DataFrame, path: str) -> None:
    dot = F.lit(".")
    _text(rows, path, F.col("chrom"), F.col("source"), F.col("feature"), F.col("start"), F.col("end"), dot, F.col("strand"), dot, F.col("attributes"), sort=["chrom", "start", "end"])


def peaks_as_gff(peaks: DataFrame, source: str = "peaks", feature: str = "peak") -> DataFrame:
    summit = F.concat(F.lit("summit="), (F.col("start") + F.col("summit")).cast("string"), F.lit(";signal="), F.col("signal").cast("string"))
    return peaks.select("chrom", F.lit(source).alias("source"), F.lit(feature).alias("feature"), "start", "end", "strand", summit.alias("attributes"))


def write_vcf(variants: DataFrame, path: str, samples: list[str] | None = None) -> None:
    """VCF rows below a header file part; ``gt`` or an array ``calls`` gives the sample columns."""
    have = variants.columns
    ident = F.col("id") if "id" in have else F.lit(".")
    calls = F.array_join("calls", "\t") if "calls" in have else F.col("gt") if "gt" in have else None
    tail = [F.lit("GT"), calls] if calls is not None else []
    row = F.concat_ws("\t", F.col("chrom"), F.col("pos").cast("string"), ident, F.col("ref"), F.col("alt"), F.lit("."), F.lit("PASS"), F.lit("."), *tail)
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *(samples or ["sample"])] if tail else [])]
    head = variants.sparkSession.createDataFrame([("##fileformat=VCFv4.2", 0), ("\t".join(names), 1)], "value string, i int")
    body = variants.select(row.alias("value"), "chrom", "pos")
    whole = head.select("value", F.lit("").alias("chrom"), F.col("i").cast("long").alias("pos")).unionByName(body)
    whole.orderBy("chrom", "pos", "value").select("value").write.mode("overwrite").text(path)


def alt_sites(coded: DataFrame, which: str) -> DataFrame:
    """Sites that carry an alternative allele: ``all``, ``het``, ``first`` or ``second`` haplotype."""
    first, second = F.shiftright("code", 1).bitwiseAND(F.lit(1)), F.col("code").bitwiseAND(F.lit(1))
    test = {"all": (first + second) > 0, "het": (first + second) == 1, "first": first == 1, "second": second == 1}[which]
    return coded.where((F.col("code") >= 0) & test)


def write_matrix(matrix: DataFrame, path: str, form: str = "code") -> None:
    """Text matrix; haplotypes as the ``code``, its dosage or ``a|b``."""
    from ..functions.text import dosage_of_code
    from ..operators.genotypes import genotype_text

    one = {"code": lambda c: c.cast("string"), "dosage": lambda c: F.coalesce(dosage_of_code(c), F.lit(-1)).cast("string"), "pair": lambda c: genotype_text(c)}[form]
    _text(matrix, path, F.col("chrom"), F.col("pos") - 1, F.col("pos"), F.col("name"), F.array_join(F.transform("codes", one), "\t"), sort=["chrom", "pos"])


def split_by_chromosome(raw: DataFrame, path: str) -> None:
    """Raw ``line`` values in one folder per chromosome, in line order."""
    _text(raw, path, F.col("line"), sort=["line_no"], partition="chrom")


def write_track(track: DataFrame, axis: DataFrame, path: str, value: str, alleles: bool = False, width: int = 8) -> None:
    """Dense little-endian arrays, one binary row per chromosome and block, in Parquet.

    ``alleles`` lays the planes of A, C, G and T one after another.  Blocks of a megabase keep rows
    small; :func:`dense_track` joins them for a chromosome.
    """
    lengths = axis.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    planes = ["A", "C", "G", "T"] if alleles else [""]
    block = 1 << 20
    flat = track.select("chrom", (F.col("alt") if alleles else F.lit("")).alias("plane"), "track_pos", F.col(value).cast("long").alias("v"))
    blocks = lengths.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("b"), "n")
    blocks = blocks.withColumn("plane", F.explode(F.array(*[F.lit(p) for p in planes])))
    kind = {4: "<u4", 8: "<u8"}[width]

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table({"chrom": pa.array([], pa.string()), "plane": pa.array([], pa.string()), "b": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        chrom, b, plane, n = (right.column(c)[0].as_py() for c in ("chrom", "b", "plane", "n"))
        data = np.zeros(min(block, n - b * block), kind)
        if left.num_rows:
            data[left.column("track_pos").to_numpy() - 1 - b * block] = left.column("v").to_numpy().astype(kind)
        return pa.table({"chrom": [chrom], "plane": [plane], "b": pa.array([b], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    keyed = flat.withColumn("b", F.floor((F.col("track_pos") - 1) / block).cast("long"))
    out = keyed.groupBy("chrom", "plane", "b").cogroup(blocks.groupBy("chrom", "plane", "b")).applyInArrow(fill, "chrom string, plane string, b long, data binary")
    out.write.mode("overwrite").partitionBy("chrom").parquet(path)


def dense_track(spark: SparkSession, path: str, chrom: str, width: int = 8) -> np.ndarray:
    """A chromosome's dense array (planes, positions); reads one chromosome only."""
    rows = spark.read.parquet(path).where(F.col("chrom") == chrom).orderBy("plane", "b").collect()
    planes: dict[str, list[bytes]] = {}
    for r in rows:
        planes.setdefault(r.plane, []).append(bytes(r.data))
    kind = {4: "<u4", 8: "<u8"}[width]
    return np.array([np.frombuffer(b"".join(parts), kind) for parts in planes.values()])


def sparse_track(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """(chrom, track_pos, alt, value) of the non-zero entries of a written track."""
    kind, block = {4: "<u4", 8: "<u8"}[width], 1 << 20

    def read(batches):
        for batch in batches:
            for chrom, plane, b, data in zip(*(batch.column(c).to_pylist() for c in ("chrom", "plane", "b", "data"))):
                values = np.frombuffer(data, kind)
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_pydict(
                    {"chrom": pa.array([chrom] * len(at), pa.string()), "track_pos": pa.array(at + 1 + b * block, pa.int64()),
                     "alt": pa.array([plane] * len(at), pa.string()), "value": pa.array(values[at].astype(np.int64))}
                )

    rows = spark.read.parquet(path).select(F.col("chrom").cast("string").alias("chrom"), "plane", "b", "data")
    return rows.mapInArrow(read, "chrom string, track_pos long, alt string, value long")


def matrix_bytes(rows: list[tuple[int, bytes]]) -> bytes:
    """Binary matrix records: little-endian position and packed sample codes."""
    return b"".join(struct.pack("<i", pos) + codes for pos, codes in rows)


def parse_matrix_bytes(data: bytes, row_bytes: int) -> list[tuple[int, bytes]]:
    step = 4 + row_bytes
    return [(struct.unpack_from("<i", data, at)[0], data[at + 4 : at + step]) for at in range(0, len(data), step)]


def write_packed_matrix(matrix: DataFrame, path: str, bits: int) -> None:
    """Matrix rows (chrom, pos, name, codes) as records of packed codes, in Parquet by chromosome.

    ``bits`` (1, 2, 4 or 8) hold a sample's code; missing ones count as 0, the number of samples goes along.
    """
    from ..operators.genotypes import packed_codes

    records = matrix.select("chrom", "pos", "name", F.size("codes").alias("samples"), F.lit(bits).alias("bits"), F.unhex(packed_codes(F.col("codes"), bits)).alias("record"))
    records.write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Sequence chunks in Parquet, one folder per chromosome."""
    chunks.write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("chrom").cast("string").alias("chrom"), "chunk", "first", "seq")
