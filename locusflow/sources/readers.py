"""Readers of the line formats.  All give 1-based inclusive coordinates and normal chromosome names.

Text is read by Spark's own source (gzip included) and parsed by column expressions.  ``line_no``
orders lines where an operator asks for the last or first one: it is the file's name and the line's
place in it, as far as Spark knows it without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_chrom


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of text files; blank lines are kept.

    line_no grows with the place in a file.  It is exact order for one unsplit file (a gzip file is
    never split) and follows the split order otherwise.
    """
    return spark.read.text(path).select(F.rtrim(F.replace(F.col("value"), F.lit("\r"), F.lit(""))).alias("line"), F.monotonically_increasing_id().alias("line_no"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where("line <> ''").select(F.col("line").alias("id"), "line_no")


def _skip(rows: DataFrame) -> DataFrame:
    """Drops blank, comment and track lines."""
    return rows.where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, 'track')")


def _field(i: int, separator: str = "\t") -> Column:
    return F.try_element_at(F.split("line", separator), F.lit(i + 1))


def _number(i: int) -> Column:
    return _field(i).try_cast("long")


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """``strict`` raises on a region whose start lies behind its end, or that has no coordinates."""
    if not strict:
        return rows
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
    ok = F.when(bad, F.raise_error(F.concat(F.lit("ill-formed region: "), F.coalesce("chrom", F.lit("?")), F.lit(" "), F.coalesce(F.col("start").cast("string"), F.lit("?"))))).otherwise(F.col("start"))
    return rows.withColumn("start", ok.cast("long"))


def bed(spark: SparkSession, path: str, raw: bool = False, strict: bool = False) -> DataFrame:
    """BED of 3 to 6 columns; ``raw`` keeps the line."""
    cut = _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), (_number(1) + 1).alias("start"), _number(2).alias("end"),
        F.coalesce(_field(3), F.lit(".")).alias("name"), F.coalesce(_field(4), F.lit(".")).alias("score"),
        F.when(_field(5).isin("+", "-"), _field(5)).otherwise("+").alias("strand"), "line_no", *(["line"] if raw else []),
    )
    return _checked(cut, strict)


def bed12(spark: SparkSession, path: str) -> DataFrame:
    """BED12 with its blocks as ``intervals``; coordinates and blocks in 1-based form."""
    sizes, starts = (F.filter(F.split(_field(i), ","), lambda x: x != "") for i in (10, 11))
    blocks = F.transform(
        F.arrays_zip(starts.alias("a"), sizes.alias("b")),
        lambda x: F.struct((_number(1) + x["a"].cast("long") + 1).alias("start"), (_number(1) + x["a"].cast("long") + x["b"].cast("long")).alias("end")),
    )
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), (_number(1) + 1).alias("start"), _number(2).alias("end"), _field(3).alias("name"),
        _field(4).alias("score"), _field(5).alias("strand"), blocks.alias("intervals"), "line_no",
    )


def interval(spark: SparkSession, path: str) -> DataFrame:
    """Eight-column composite intervals: name, chrom, strand, start, end, n, starts, ends."""
    starts, ends = (F.filter(F.split(_field(i), ","), lambda x: x != "") for i in (6, 7))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct((x["a"].cast("long") + 1).alias("start"), x["b"].cast("long").alias("end")))
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(1)).alias("chrom"), (_number(3) + 1).alias("start"), _number(4).alias("end"), _field(0).alias("name"),
        _field(2).alias("strand"), _number(5).alias("n"), parts.alias("intervals"), "line_no",
    )


def narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    double = lambda i: _field(i).try_cast("double")
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), (_number(1) + 1).alias("start"), _number(2).alias("end"), _field(3).alias("name"),
        _field(4).alias("score"), F.when(_field(5).isin("+", "-"), _field(5)).otherwise("+").alias("strand"),
        double(6).alias("signal"), double(7).alias("p"), double(8).alias("q"), _number(9).alias("summit"), "line_no",
    )


def bed_with_p_values(spark: SparkSession, path: str) -> DataFrame:
    """BED6 and log p, log q."""
    cut = bed(spark, path, raw=True)
    return cut.withColumns({"log_p": _field(6).try_cast("double"), "log_q": _field(7).try_cast("double")}).drop("line")


def bed_with_sequences(spark: SparkSession, path: str, names: tuple[str, ...] = ("seq",)) -> DataFrame:
    """BED6 and sequence columns (one, or ancestral and derived)."""
    cut = bed(spark, path, raw=True)
    return cut.withColumns({n: _field(6 + i) for i, n in enumerate(names)}).drop("line")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix: .bed, .bed12, .narrowPeak, .interval (each also .gz)."""
    name = path.removesuffix(".gz").lower()
    for suffix, reader in ((".bed12", bed12), (".bed", bed), (".narrowpeak", narrow_peak), (".interval", interval)):
        if name.endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def gff(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), _field(1).alias("source"), _field(2).alias("feature"), _number(3).alias("start"),
        _number(4).alias("end"), _field(5).alias("score"), _field(6).alias("strand"), _field(7).alias("frame"), _field(8).alias("attributes"),
        "line_no", *(["line"] if raw else []),
    )


def vcf(spark: SparkSession, path: str, genotypes: bool = False, split_alts: bool = False, raw: bool = False) -> DataFrame:
    """VCF sites, or also ``format`` and ``calls``; lines of fewer than 8 columns are skipped.

    Sample columns stay one unsplit tail until ``calls`` is used, so a join that drops rows runs
    before thousands of samples are cut.
    """
    cut = _skip(lines(spark, path)).where(F.size(F.split("line", "\t", 9)) >= 8)
    head = F.split("line", "\t", 10)
    at = lambda i: F.try_element_at(head, F.lit(i + 1))
    rows = cut.select(
        normal_chrom(at(0)).alias("chrom"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"),
        at(5).alias("qual"), at(6).alias("filter"), at(7).alias("info"),
        *([at(8).alias("format"), F.split(F.coalesce(at(9), F.lit("")), "\t").alias("calls")] if genotypes else []),
        "line_no", *(["line"] if raw else []),
    )
    return rows.withColumn("alt", F.explode(F.split("alt", ","))) if split_alts else rows


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of a VCF's header line."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return head[0].value.split("\t")[9:] if head else []


def vep(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Annotator rows; the chromosome in the location is normalised too."""
    place = F.concat(normal_chrom(F.split(_field(1), ":")[0]), F.lit(":"), F.split(_field(1), ":")[1])
    return _skip(lines(spark, path)).select(
        _field(0).alias("uploaded_variation"), place.alias("location"), _field(2).alias("allele"), _field(3).alias("gene"), _field(4).alias("feature"),
        _field(5).alias("feature_type"), F.split(_field(6), "[, ]+").alias("consequence"), _field(7).alias("cdna_position"), _field(8).alias("cds_position"),
        "line_no", *(["line"] if raw else []),
    )


def annovar(spark: SparkSession, path: str) -> DataFrame:
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), _number(1).alias("start"), _number(2).alias("end"), _field(5).alias("function"), _field(7).alias("detail"),
        _field(8).alias("exonic_function"), _field(9).alias("aa_change"), _field(15).alias("vid"), "line_no",
    )


def effect_annotations(spark: SparkSession, path: str) -> DataFrame:
    """BED-like effect rows: chrom, start, end, ``REF ALT ID``, score, strand, effect, transcript."""
    return _skip(lines(spark, path)).select(
        normal_chrom(_field(0)).alias("chrom"), (_number(1) + 1).alias("start"), _number(2).alias("end"), _field(3).alias("name"),
        _field(6).alias("effect"), _field(7).alias("transcript"), "line_no",
    )


def term_map(spark: SparkSession, path: str) -> DataFrame:
    return _skip(lines(spark, path)).select(_field(0).alias("source"), _field(1).alias("target"))


def term_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Term table with a header: bit is the row's place, contexts the names of the flags set."""
    table = spark.read.option("header", True).option("sep", "\t").csv(path).coalesce(1)
    flags = [c for c in table.columns if c != "Term"]
    numbered = table.withColumn("bit", F.monotonically_increasing_id())
    return numbered.select("bit", F.col("Term").alias("term"), F.filter(F.array(*[F.when(F.col(f"`{c}`") == "1", F.lit(c)) for c in flags]), lambda x: x.isNotNull()).alias("contexts"))


def chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    cut = F.split("line", "\\s+")
    return _skip(lines(spark, path)).select(normal_chrom(cut[0]).alias("chrom"), cut[1].try_cast("long").alias("length"))


def recombination_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, cm) points."""
    cut = F.split("line", "\\s+")
    return _skip(lines(spark, path)).select(normal_chrom(cut[0]).alias("chrom"), cut[3].try_cast("long").alias("pos"), cut[2].try_cast("double").alias("cm")).where("pos is not null")


def genotype_matrix(spark: SparkSession, path: str, samples: int | None = None) -> DataFrame:
    """Text matrix: chrom, pos, name, ref, alt, codes; names are ``id_REF_ALT``."""
    cut = _skip(lines(spark, path))
    parts = F.split(_field(3), "_")
    codes = F.transform(F.slice(F.split("line", "\t"), 5, 1_000_000), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    return cut.select(
        normal_chrom(_field(0)).alias("chrom"), (_number(1) + 1).alias("pos"), _number(2).alias("end"), _field(3).alias("name"),
        F.try_element_at(parts, F.lit(-2)).alias("ref"), F.try_element_at(parts, F.lit(-1)).alias("alt"),
        (F.slice(codes, 1, samples) if samples else codes).alias("codes"), "line_no",
    )


def _unpacked(record: Column, bits: Column, samples: Column) -> Column:
    """Sample codes of a little-endian packed record."""
    per = F.floor(F.lit(8) / bits).cast("int")
    digits = F.hex(record)

    def code(i: Column) -> Column:
        byte = F.conv(F.substring(digits, (2 * F.floor(i / per) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bits * (i % per)).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1), bits) - 1)

    return F.when(samples > 0, F.transform(F.sequence(F.lit(0), samples - 1), code)).otherwise(F.array().cast("array<int>"))


def packed_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, name, codes) of records in Parquet, see ``sinks.write_packed_matrix``."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("chrom").cast("string").alias("chrom"), "pos", "name", _unpacked(F.col("record"), F.col("bits"), F.col("samples")).alias("codes"))


def binary_matrix(spark: SparkSession, path: str, samples: int, bits: int, alleles: int = 1) -> DataFrame:
    """(chrom, pos, alt, codes) of files ``CHROM_matrix.bin`` (or .gz): little-endian 32-bit positions from 0,
    each followed by packed codes, a block per allele A, C, G, T and unknown if there are five.

    Rows of codes that are all 0 are left out; positions are given from 1.  alt is null without blocks.
    """
    import gzip

    import numpy as np
    import pyarrow as pa

    width = -(-bits * (samples + 1) // 8)
    names = ["A", "C", "G", "T", "N"] if alleles > 1 else [None]

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                table = np.frombuffer(data, np.dtype([("pos", "<i4"), ("codes", np.uint8, (alleles, width))]))
                chrom = name.rpartition("/")[2].partition("_matrix.bin")[0]
                for lo in range(0, len(table), 10_000):
                    part = table[lo : lo + 10_000]
                    row, allele = np.nonzero(part["codes"].any(2))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chrom] * len(row), pa.string()), pa.array(part["pos"][row].astype(np.int64) + 1),
                            pa.array([names[a] for a in allele], pa.string()), pa.array([c.tobytes() for c in part["codes"][row, allele]], pa.binary()),
                        ],
                        ["chrom", "pos", "alt", "record"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_matrix.bin*").load(path).select("path", "content")
    rows = files.mapInArrow(parse, "chrom string, pos long, alt string, record binary")
    return rows.select(normal_chrom(F.col("chrom")).alias("chrom"), "pos", "alt", _unpacked(F.col("record"), F.lit(bits), F.lit(samples)).alias("codes"))


def matrix(spark: SparkSession, path: str, samples: int | None = None, bits: int = 2) -> DataFrame:
    """Genotype matrix by suffix: ``.parquet`` packed records, ``.bin`` and ``.bin.gz`` binary files, all else text."""
    name = path.removesuffix(".gz")
    if name.endswith(".parquet"):
        return packed_matrix(spark, path)
    if name.endswith(".bin"):
        if samples is None:
            raise ValueError("a binary matrix does not say how many samples it holds")
        return binary_matrix(spark, path, samples, bits)
    return genotype_matrix(spark, path, samples)


#: Lines of a file that one window partition orders.
_LINES = 13


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos of the first base, seq), one row per sequence line; several records a file are allowed.

    Headers are carried forward and lengths summed in two steps, within blocks of 8,192 lines and then
    over one row per block, so no task orders a file.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.upper(F.rtrim(F.replace(F.col("value"), F.lit("\r"), F.lit("")))).alias("seq"), F.rtrim("value").alias("line"), F.monotonically_increasing_id().alias("line_no")).where("line <> ''")
    rows = rows.withColumn("block", F.shiftright("line_no", _LINES))
    header = F.when(F.startswith("line", F.lit(">")), normal_chrom(F.regexp_extract("line", "^>(\\S+)", 1)))
    bases = F.when(header.isNull(), F.length("seq")).otherwise(F.lit(0)).cast("long")
    marked = rows.select("file", "block", "line_no", "seq", header.alias("header"), bases.alias("n"))
    order = Window.partitionBy("file", "block").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumns({"own": F.last("header", ignorenulls=True).over(order), "sum": F.coalesce(F.sum("n").over(before), F.lit(0))})
    inside = inside.withColumn("from", F.last(F.when(F.col("header").isNotNull(), F.col("sum")), ignorenulls=True).over(order))
    # What a block hands on: its last header and the bases behind it, or all its bases.
    last = F.max_by(F.struct("own", (F.col("sum") + F.col("n")).alias("sum"), "from"), "line_no").alias("x")
    blocks = inside.groupBy("file", "block").agg(last).select("file", "block", "x.own", (F.col("x.sum") - F.coalesce("x.from", F.lit(0))).alias("tail"))
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("total", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    mark = F.last(F.when(F.col("own").isNotNull(), F.col("total")), ignorenulls=True).over(earlier)
    carried = blocks.select(
        F.col("file").alias("_f"), F.col("block").alias("_b"), F.last("own", ignorenulls=True).over(earlier).alias("carried"),
        (F.col("total") - F.coalesce(mark, F.lit(0))).alias("offset"),
    )
    placed = inside.where("header IS NULL").join(carried, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    pos = F.when(F.col("own").isNotNull(), F.col("sum") - F.col("from")).otherwise(F.col("sum") + F.col("offset")) + 1
    named = placed.select(F.coalesce("own", "carried").alias("chrom"), pos.alias("pos"), "seq")
    return named.where("chrom IS NOT NULL")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, base), 1-based, from FASTA files."""
    letters = fasta_lines(spark, path).select("chrom", "pos", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("i", "base"))
    return letters.select("chrom", (F.col("pos") + F.col("i")).alias("pos"), "base")


def fasta_chunks(spark: SparkSession, path: str, margin: int | None = None) -> DataFrame:
    """Sequence chunks with margins, put together from whole lines."""
    from ..operators.tracks import MARGIN, assembled

    return assembled(fasta_lines(spark, path), margin=max(MARGIN, margin or 0))


def settings(path: str, arguments: dict[str, str] | None = None) -> dict[str, str]:
    """Configuration file of ``key value`` or ``key=value`` lines, overridden by arguments."""
    found: dict[str, str] = {}
    with open(path) as f:
        for line in f:
            line = line.partition("#")[0].strip()
            if line:
                key, _, value = line.replace("=", " ", 1).partition(" ")
                found[key.strip()] = value.strip()
    return found | (arguments or {})
