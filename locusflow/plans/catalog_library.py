"""Queries of the library calls that no command reaches: projections, names, bases, structures, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nucleotide, text
from ..operators import effects, genotypes, regions, sequence
from .catalog import _merge_sql, query
from .catalog_domain import _BASES, _REGION_SEQ, _region_sequences
from .views import Views

# ---------------------------------------------------------------- regions


@query("""SELECT 'chrom' AS kept, count(*) AS n FROM regions WHERE chrom = 'c1'
    UNION ALL SELECT 'strand', count(*) FROM regions WHERE strand = '+'
    UNION ALL SELECT 'longer', count(*) FROM regions WHERE "end" - "start" > 20
    UNION ALL SELECT 'shorter', count(*) FROM regions WHERE "end" - "start" < 20
    UNION ALL SELECT 'ending', count(*) FROM regions WHERE "end" < 100000
    UNION ALL SELECT 'ill_formed', count(*) FROM regions WHERE "start" + 10 > "end" """)
def region_filters(v: Views) -> DataFrame:
    r = v.regions
    kept = {
        "chrom": regions.on_chrom(r, "c1"),
        "strand": regions.on_strand(r, "+"),
        "longer": regions.longer_than(r, 20),
        "shorter": regions.shorter_than(r, 20),
        "ending": regions.ending_before(r, 100_000),
        "ill_formed": regions.ill_formed(r.withColumn("start", F.col("start") + 10)),
    }
    counts = [rows.agg(F.lit(name).alias("kept"), F.count(F.lit(1)).alias("n")) for name, rows in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""SELECT row_id, 'left' AS side, greatest(1, "start" - 20) AS "start", "start" AS "end" FROM regions
    UNION ALL SELECT row_id, 'right', "end", "end" + 20 FROM regions""")
def boundary_flanks(v: Views) -> DataFrame:
    sides = (("left", regions.left_flanks(v.regions, 20)), ("right", regions.right_flanks(v.regions, 20)))
    left, right = (rows.select("row_id", F.lit(side).alias("side"), "start", "end") for side, rows in sides)
    return left.unionByName(right)


@query("""SELECT *, CASE WHEN strand = '-' THEN "end" - genome + 1 ELSE genome - "start" + 1 END AS back, genome - 1 AS zero_based FROM (
    SELECT row_id, "start", "end", strand, i, CASE WHEN strand = '-' THEN "end" - i + 1 ELSE "start" + i - 1 END AS genome
    FROM (SELECT *, row_id % ("end" - "start" + 1) + 1 AS i FROM regions))""")
def index_maps(v: Views) -> DataFrame:
    rows = v.regions.select("row_id", "start", "end", "strand", (F.col("row_id") % (F.col("end") - F.col("start") + 1) + 1).alias("i"))
    place = [F.col(c) for c in ("start", "end", "strand")]
    rows = rows.withColumn("genome", regions.genome_position(F.col("i"), *place))
    return rows.withColumns({"back": regions.sequence_index(F.col("genome"), *place), "zero_based": regions.translate_coord(F.col("genome"), 1, 0)})


def _subtract_sql(source: str) -> str:
    """Parts of ``source`` (chrom, start, end, name, strand; names unique) outside ``merged``."""
    return f"""SELECT chrom, from_ AS "start", to_ AS "end", name, strand FROM (
        SELECT *, coalesce(lag(c_end) OVER w + 1, "start") AS from_, coalesce(c_start - 1, "end") AS to_ FROM (
          SELECT a.*, greatest(a."start", m."start") AS c_start, least(a."end", m."end") AS c_end
          FROM {source} a JOIN merged m ON a.chrom = m.chrom AND a."start" <= m."end" AND m."start" <= a."end"
          UNION ALL SELECT *, NULL, NULL FROM {source})
        WINDOW w AS (PARTITION BY name ORDER BY c_start ASC NULLS LAST)) WHERE from_ <= to_"""


_GENES = """SELECT chrom, "start", "end" + 150 AS "end", 'g' || cast(row_id AS varchar) AS name, strand FROM regions"""


@query(_subtract_sql("genes"), genes=_GENES, merged=_merge_sql("others", 0))
def intron_regions(v: Views) -> DataFrame:
    genes = v.regions.select("chrom", "start", (F.col("end") + 150).alias("end"), F.concat(F.lit("g"), F.col("row_id").cast("string")).alias("name"), "strand")
    return regions.introns(genes, v.others, "name").select("chrom", "start", "end", "name", "strand")


_PROPERTY = "CASE WHEN row_id % 11 = 0 THEN NULL ELSE name END"


@query(f"""SELECT chrom, property, min("start") AS "start", max("end") AS "end", count(*) AS n FROM (
    SELECT *, coalesce({_PROPERTY}, 'NONAME_' || chrom || '_' || "start" || '_' || "end") AS property FROM regions) GROUP BY chrom, property""")
def property_hulls(v: Views) -> DataFrame:
    return regions.hull_by(v.regions.withColumn("property", F.expr(_PROPERTY)), "property").drop("intervals")


@query(f"""SELECT chrom, coalesce({_PROPERTY}, 'NONAME_' || chrom || '_' || "start" || '_' || "end") AS property, "start", "end" FROM regions""")
def hull_members(v: Views) -> DataFrame:
    hulls = regions.hull_by(v.regions.withColumn("property", F.expr(_PROPERTY)), "property")
    return regions.flattened(hulls).select("chrom", "property", "start", "end")


# ---------------------------------------------------------------- gene structure

_GFF = """SELECT chrom, "start", "end" + CASE WHEN row_id % 5 = 0 THEN 200 ELSE 0 END AS "end", strand, row_id,
    ['gene', 'exon', 'CDS', 'UTR', 'three_prime_UTR'][cast(row_id % 5 AS int) + 1] AS feature,
    'g' || cast(row_id AS varchar) AS gene, 't' || cast(row_id % 300 AS varchar) AS transcript FROM regions"""


def _gff(v: Views) -> DataFrame:
    features = F.array(*[F.lit(f) for f in ("gene", "exon", "CDS", "UTR", "three_prime_UTR")])
    at, own = (F.col("row_id") % 5).cast("int"), F.col("row_id").cast("string")
    parents = F.concat_ws(",", *[F.concat(F.lit("r"), F.floor(F.col("row_id") / n).cast("string")) for n in (2, 3)])
    attributes = F.concat(
        F.lit("ID=r"), own, F.lit(";Parent="), parents, F.lit(";gene_id=g"), own, F.lit(";transcript_id=t"), (F.col("row_id") % 300).cast("string")
    )
    return v.regions.select(
        "chrom", "start", (F.col("end") + F.when(at == 0, 200).otherwise(0)).alias("end"), "strand",
        F.element_at(features, at + 1).alias("feature"), attributes.alias("attributes"),
    )


@query(
    f"""SELECT chrom, "start", "end", transcript AS name, strand, 'CDS' AS element_type, transcript FROM gff WHERE feature = 'CDS'
        UNION ALL SELECT chrom, "start", "end", transcript, strand, '5p_UTR', transcript FROM gff WHERE feature = 'UTR'
        UNION ALL SELECT chrom, "start", "end", transcript, strand, '3p_UTR', transcript FROM gff WHERE feature = 'three_prime_UTR'
        UNION ALL SELECT chrom, "start", "end", name, strand, 'intron', NULL FROM ({_subtract_sql('genes')})
        UNION ALL SELECT chrom, greatest(1, CASE WHEN strand = '-' THEN "end" ELSE "start" END - 500),
          least(200290, CASE WHEN strand = '-' THEN "end" ELSE "start" END + 500), name, strand, 'promoter', NULL FROM genes""",
    gff=_GFF,
    genes="""SELECT chrom, "start", "end", gene AS name, strand FROM gff WHERE feature = 'gene'""",
    merged=_merge_sql("(SELECT * FROM gff WHERE feature = 'exon')", 0),
)
def gene_elements(v: Views) -> DataFrame:
    sizes = v.spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chrom"), F.lit(200_300).cast("long").alias("length"))
    return effects.gene_elements(_gff(v), sizes, 500)


@query(
    """SELECT 'r' || c.row_id AS child, c.chrom, c."start", c."end", c.feature, 'r' || p.row_id AS parent, p.feature AS parent_feature
       FROM (SELECT *, unnest([row_id // 2, row_id // 3]) AS up FROM gff) c JOIN gff p ON p.row_id = c.up""",
    gff=_GFF,
)
def gff_children(v: Views) -> DataFrame:
    return effects.children_of(_gff(v))


@query("""SELECT *, cast(coalesce(sum("end" - "start" + 1) OVER (PARTITION BY name ORDER BY CASE WHEN strand = '-' THEN -"start" ELSE "start" END, "end"
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS transcript_before, cast(transcript_before % 3 AS int) AS frame
    FROM (SELECT DISTINCT chrom, "start", "end", name, strand FROM regions)""")
def coding_frames(v: Views) -> DataFrame:
    return sequence.running_frame(v.regions.select("chrom", "start", "end", "name", "strand").distinct(), "name")


# ---------------------------------------------------------------- genotype matrices


@query(
    """SELECT chrom, pos, cast(vid % 3 AS varchar) || ',' || cast(vid % 2 AS varchar) AS codes FROM variants SEMI JOIN listed USING (chrom, pos)
       UNION ALL SELECT chrom, pos, '-1,-1' FROM listed ANTI JOIN variants USING (chrom, pos)""",
    listed="SELECT DISTINCT chrom, pos + vid % 2 AS pos FROM variants",
)
def listed_variants(v: Views) -> DataFrame:
    matrix = v.variants.select("chrom", "pos", F.array((F.col("vid") % 3).cast("int"), (F.col("vid") % 2).cast("int")).alias("codes"))
    listed = v.variants.select("chrom", (F.col("pos") + F.col("vid") % 2).alias("pos"))
    found = genotypes.listed_variants(matrix, listed, 2)
    return found.select("chrom", "pos", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("SELECT chrom, pos, count(*) AS n FROM (SELECT chrom, pos // 7 AS pos FROM variants) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_places(v: Views) -> DataFrame:
    return genotypes.duplicate_places(v.variants.withColumn("pos", F.floor(F.col("pos") / 7)))


# ---------------------------------------------------------------- k-mer roll-ups

_COUNTS = """SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 4) AS kmer FROM (
    SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM rs WHERE length(seq) >= 4)) GROUP BY kmer"""


@query("SELECT substr(kmer, 1, 2) AS prefix, cast(sum(n) AS bigint) AS n FROM counts GROUP BY 1", bases=_BASES, rs=_REGION_SEQ, counts=_COUNTS)
def kmer_prefixes(v: Views) -> DataFrame:
    return sequence.kmer_prefix_totals(sequence.kmer_counts(_region_sequences(v), 4, both_strands=False), 2)


@query(
    """SELECT kmer, n, round(exp(lp) * (SELECT sum(n) FROM counts), 6) AS expected FROM counts JOIN (
         SELECT kmer, sum(ln(f)) AS lp FROM (SELECT kmer, unnest(string_split(kmer, '')) AS b FROM counts) JOIN freq USING (b) GROUP BY kmer) USING (kmer)""",
    bases=_BASES, rs=_REGION_SEQ, counts=_COUNTS,
    freq="""SELECT b, sum(n) / (SELECT sum(4 * n) FROM counts) AS f FROM (SELECT n, unnest(string_split(kmer, '')) AS b FROM counts) GROUP BY b""",
)
def kmer_expected(v: Views) -> DataFrame:
    found = sequence.kmer_background(sequence.kmer_counts(_region_sequences(v), 4, both_strands=False))
    return found.select("kmer", "n", F.round("expected", 6).alias("expected"))


@query(
    """SELECT row_id, greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')),
       length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))) >= length(seq) * 0.5::DOUBLE AS low FROM rs""",
    bases=_BASES, rs=_REGION_SEQ,
)
def low_complexity(v: Views) -> DataFrame:
    return _region_sequences(v).select("row_id", sequence.is_low_complexity(F.col("seq"), 0.5).alias("low"))


# ---------------------------------------------------------------- scalar functions

_CODON = "ref || alt || substr('ACGTN', cast(1 + vid % 5 AS int), 1)"
_ONE = "(CASE WHEN substr({0}, {1}, 1) = 'N' THEN 4 ELSE instr('ACGT', substr({0}, {1}, 1)) - 1 END)"


@query(
    f"""SELECT vid, codon, cast({_ONE.format('codon', 3)} AS int) AS code, replace(substr(codon, 3), 'N', '-') AS base, substr(codon, 3) <> 'N' AS known,
        reverse(translate(codon, 'ACGT', 'TGCA')) AS rc, reverse(translate(codon, 'ACGT', 'UGCA')) AS rna_rc, replace(codon, 'T', 'U') AS rna, codon AS dna,
        aa, CASE WHEN substr(codon, 3) <> 'N' THEN cast({_ONE.format('codon', 1)} * 16 + {_ONE.format('codon', 2)} * 4 + {_ONE.format('codon', 3)} AS int) END AS number,
        replace(ref || alt, 'T', 'U') IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG') AS paired, ref IN ('A', 'G') AS purine, ref IN ('C', 'G') AS gc,
        translate(ref, 'ACGT', 'GTAC') AS moved FROM (SELECT *, {_CODON} AS codon FROM variants) LEFT JOIN codons USING (codon)"""
)
def nucleotide_functions(v: Views) -> DataFrame:
    rows = v.variants.withColumn("codon", F.expr(_CODON))
    codon, ref, third = F.col("codon"), F.col("ref"), F.substring("codon", 3, 1)
    return rows.select(
        "vid", "codon",
        nucleotide.base_code(third).alias("code"),
        nucleotide.base_of(nucleotide.base_code(third)).alias("base"),
        nucleotide.is_base(third).alias("known"),
        nucleotide.reverse_complement(codon).alias("rc"),
        nucleotide.reverse_complement(codon, rna=True).alias("rna_rc"),
        nucleotide.transcribe(codon).alias("rna"),
        nucleotide.back_transcribe(nucleotide.transcribe(codon)).alias("dna"),
        nucleotide.amino_acid(codon).alias("aa"),
        nucleotide.codon_number(codon).alias("number"),
        nucleotide.pairs(ref, F.col("alt")).alias("paired"),
        nucleotide.is_purine(ref).alias("purine"),
        nucleotide.is_gc(ref).alias("gc"),
        nucleotide.transition(ref).alias("moved"),
    )


_SHIFTED = "list_sum(list_transform(range(1, 7), lambda i: (instr('ACGT', substr({}, i, 1)) - 1)::BIGINT << cast({} + 2 * (i - 1) AS int)))::BIGINT"


@query(
    f"""SELECT vid, frame, neigh AS neighbours, cds AS cds_neighbours, mask,
        frame::BIGINT | {_SHIFTED.format('neigh', 2)} | {_SHIFTED.format('cds', 14)} | (mask << 26) AS word
        FROM (SELECT vid, cast(vid % 3 AS int) AS frame, 1::BIGINT << cast(vid % 37 AS int) AS mask, {_CODON} || alt || ref || ref AS neigh, reverse({_CODON} || alt || ref || ref) AS cds FROM variants)
        WHERE NOT contains(neigh, 'N')
        UNION ALL SELECT vid, NULL, NULL, NULL, NULL, NULL FROM variants WHERE vid % 5 = 4"""
)
def cds_words(v: Views) -> DataFrame:
    neigh = F.concat(F.expr(_CODON), "alt", "ref", "ref")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vid") % 37).cast("int"))
    rows = v.variants.select("vid", nucleotide.pack_cds_impact((F.col("vid") % 3).cast("int"), neigh, F.reverse(neigh), mask).alias("word"))
    return rows.withColumn("x", nucleotide.unpack_cds_impact(F.col("word"))).select("vid", "word", "x.frame", "x.neighbours", "x.cds_neighbours", "x.mask")


_TEXT = "concat(name, '(', row_id, ');;', strand, ',[', row_id % 97, CASE WHEN row_id % 2 = 1 THEN ']' ELSE ')' END)"
_OTHER = "concat('T', row_id % 30)"


@query(
    f"""SELECT row_id, array_to_string(list_filter(string_split_regex(t, '[;,]'), lambda x: x <> ''), '|') AS parts, len(string_split_regex(t, '[;,]'))::BIGINT AS n_all,
        list_filter(string_split_regex(t, '[;,]'), lambda x: x <> '')[1] AS first, array_to_string(string_split(t, ');;'), '|') AS by_text,
        try_cast(substr(name, 2) AS DOUBLE) IS NOT NULL AS number, try_cast(t AS DOUBLE) IS NOT NULL AS no_number,
        array_to_string(list_transform(regexp_extract_all(t, '\\d+'), lambda x: cast(cast(x AS bigint) AS varchar)), '|') AS integers,
        lower(to_base(row_id, 16)) AS hex, row_id AS back, lower(name) = lower(o) AS same,
        contains(lower(name), lower(o)) OR contains(lower(o), lower(name)) AS matched,
        list_max(list_filter(range(0, least(length(name), length(o)) + 1), lambda i: left(name, i) = left(o, i)))::BIGINT AS prefix,
        translate(t, '();', '___') AS clean, regexp_replace(t, '[^0-9A-Za-z]', '', 'g') AS alnum, row_id % 2 = 1 AS balanced, t AS trimmed, chrom || '_1' AS chrom,
        round(0.5 * (1 - exp(-2 * (row_id % 300)::DOUBLE / 1000)), 9) AS recombined
        FROM (SELECT *, {_TEXT} AS t, {_OTHER} AS o FROM regions)"""
)
def text_functions(v: Views) -> DataFrame:
    rows = v.regions.withColumns({"t": F.expr(_TEXT), "o": F.expr(_OTHER)})
    t, name, o = F.col("t"), F.col("name"), F.col("o")
    return rows.select(
        "row_id",
        F.array_join(text.tokens(t, ";,"), "|").alias("parts"),
        text.count_tokens(t, ";,", keep_empty=True).cast("long").alias("n_all"),
        F.array_join(text.first_tokens(t, ";,", 1), "|").alias("first"),
        F.array_join(text.tokens_by_text(t, ");;"), "|").alias("by_text"),
        text.is_number(F.substring(name, 2, 10)).alias("number"),
        text.is_number(t).alias("no_number"),
        F.array_join(text.integers_in(t).cast("array<string>"), "|").alias("integers"),
        text.in_base(F.col("row_id"), 16).alias("hex"),
        text.from_base(text.in_base(F.col("row_id"), 16), 16).alias("back"),
        text.same_text(name, o, case_sensitive=False).alias("same"),
        text.names_match(name, o).alias("matched"),
        text.matching_prefix(name, o).cast("long").alias("prefix"),
        text.without(t, "();").alias("clean"),
        text.alphanumeric(t).alias("alnum"),
        text.is_balanced(t).alias("balanced"),
        text.trim_left(F.concat(F.lit("  "), t)).alias("trimmed"),
        text.normal_chrom(F.concat(F.lit("chr"), "chrom", F.lit(".1"))).alias("chrom"),
        F.round(text.recombination_probability((F.col("row_id") % 300) / 10), 9).alias("recombined"),
    )
