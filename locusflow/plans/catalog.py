"""The queries and their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotypes, overlap, regions, tracks, translate
from .views import Views, neigh_sql, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **extra: str):
    """Registers a function of the views; ``sql`` is the oracle's body, ``extra`` further expressions."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql, *[x for pair in extra.items() for x in pair])
        return f

    return register


# ---------------------------------------------------------------- joins


@query("""SELECT v.chrom, v.pos, v.vid, r.name, r."start", r."end" FROM variants v
    JOIN regions r ON v.chrom = r.chrom AND v.pos BETWEEN r."start" AND r."end" """)
def overlap_points(v: Views) -> DataFrame:
    found = overlap.points_in(v.variants, v.regions)
    return found.select("chrom", "pos", "vid", F.col("r_name").alias("name"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))


_PAIR = """a.chrom, a.row_id AS a_id, b.row_id AS b_id, greatest(a."start", b."start") AS o_start, least(a."end", b."end") AS o_end,
    least(a."end", b."end") - greatest(a."start", b."start") + 1 AS l_overlap
    FROM regions a JOIN others b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" """


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("chrom", F.col("row_id").alias("a_id"), F.col("b_row_id").alias("b_id"), "o_start", "o_end", "l_overlap")


@query(f"SELECT {_PAIR}")
def overlap_intervals(v: Views) -> DataFrame:
    return _pairs(overlap.overlapping(v.regions, v.others))


@query(f"SELECT {_PAIR} AND a.strand = b.strand")
def overlap_stranded(v: Views) -> DataFrame:
    return _pairs(overlap.overlapping(v.regions, v.others, stranded=True))


@query(f"""SELECT * EXCLUDE (i) FROM (SELECT p.*, row_number() OVER (PARTITION BY a_id ORDER BY b."start", b."end", b.name, b.row_id) AS i
    FROM (SELECT {_PAIR}) p JOIN others b ON b.row_id = p.b_id) WHERE i = 1""")
def overlap_first(v: Views) -> DataFrame:
    return _pairs(overlap.first_overlap(v.regions, v.others, "row_id"))


@query("""SELECT a.* FROM regions a WHERE NOT EXISTS (SELECT 1 FROM others b
    WHERE a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end")""")
def exclude_regions(v: Views) -> DataFrame:
    return overlap.not_hit_by(v.regions, v.others)


@query("""SELECT a.* FROM regions a WHERE NOT EXISTS (SELECT 1 FROM others b
    WHERE a.chrom = b.chrom AND a.strand = b.strand AND a."start" <= b."end" AND b."start" <= a."end")""")
def exclude_stranded(v: Views) -> DataFrame:
    return overlap.not_hit_by(v.regions, v.others, stranded=True)


@query("""SELECT a.* FROM regions a WHERE EXISTS (SELECT 1 FROM indels v
    WHERE a.chrom = v.chrom AND a."start" <= v.pos + length(v.ref) - 1 AND v.pos <= a."end")""")
def elements_hit(v: Views) -> DataFrame:
    return tracks.elements_hit(v.indels, v.regions)


@query("""SELECT a.row_id AS a_id, b.row_id AS b_id, a.name FROM regions a JOIN others b ON substr(a.name, 2) = substr(b.name, 2)""")
def same_names(v: Views) -> DataFrame:
    cut = lambda d: d.withColumn("name", F.substring("name", 2, 10))
    found = overlap.same_names(cut(v.regions), cut(v.others))
    return found.select(F.col("row_id").alias("a_id"), F.col("b_row_id").alias("b_id"), F.concat(F.lit("T"), "name").alias("name"))


@query("""SELECT a.row_id AS a_id, b.row_id AS b_id FROM regions a JOIN others b
    ON a.chrom = b.chrom AND a."start" = b."start" AND a."end" = b."end" """)
def same_place(v: Views) -> DataFrame:
    return overlap.same_place(v.regions, v.others).select(F.col("row_id").alias("a_id"), F.col("b_row_id").alias("b_id"))


# ---------------------------------------------------------------- axis, windows, set operations


@query("SELECT * FROM axis")
def track_axis(v: Views) -> DataFrame:
    return v.axis


_SORTED = """PARTITION BY chrom ORDER BY "start", "end", length(name), name"""


@query(f"""SELECT *, max("end") OVER ({_SORTED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_end,
    min("start") OVER ({_SORTED} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_start FROM regions""")
def running_bounds(v: Views) -> DataFrame:
    return regions.running_bounds(v.regions)


def _merge_sql(source: str, gap: int, keys: str = "chrom") -> str:
    return f"""SELECT {keys}, min("start") AS "start", max("end") AS "end", count(*) AS n_merged FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END AS fresh FROM (
        SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM {source}))) GROUP BY {keys}, island"""


@query(_merge_sql("regions", 1))
def merge_regions(v: Views) -> DataFrame:
    return regions.merge(v.regions, 1)


@query(_merge_sql("regions", 1, "chrom, strand"))
def merge_stranded(v: Views) -> DataFrame:
    return regions.merge(v.regions, 1, ("chrom", "strand"))


@query(_merge_sql("""(SELECT chrom, "start", "end" FROM regions UNION ALL SELECT chrom, "start", "end" FROM others)""", 0))
def union_regions(v: Views) -> DataFrame:
    return regions.merge_all([v.regions, v.others])


@query(
    """SELECT chrom, row_id, name, strand, from_ AS "start", to_ AS "end" FROM (
        SELECT chrom, row_id, name, strand, coalesce(lag(c_end) OVER w + 1, "start") AS from_, coalesce(c_start - 1, "end") AS to_
        FROM (SELECT a.*, greatest(a."start", m."start") AS c_start, least(a."end", m."end") AS c_end
              FROM regions a JOIN merged m ON a.chrom = m.chrom AND a."start" <= m."end" AND m."start" <= a."end"
              UNION ALL SELECT *, NULL, NULL FROM regions)
        WINDOW w AS (PARTITION BY row_id ORDER BY c_start ASC NULLS LAST)) WHERE from_ <= to_""",
    merged=_merge_sql("others", 0),
)
def subtract_regions(v: Views) -> DataFrame:
    return regions.subtract(v.regions, v.others, "row_id")


@query(
    """SELECT m.chrom, min(b."start") AS "start", max(b."end") AS "end", count(*) AS n,
        cast(sum(CASE WHEN b."start" < m."start" OR b."end" > m."end" THEN 1 ELSE 0 END) AS bigint) AS crossing
       FROM merged m JOIN others b ON m.chrom = b.chrom AND m."start" <= b."end" AND b."start" <= m."end"
       GROUP BY m.chrom, m."start", m."end" """,
    merged=_merge_sql("regions", 0),
)
def super_region_hull(v: Views) -> DataFrame:
    return regions.super_hulls(v.others, v.regions)


@query("""SELECT chrom, cast(sum("end" - "start" + 1) AS bigint) AS covered, count(*) AS n_regions FROM regions GROUP BY chrom""")
def coverage_by_chrom(v: Views) -> DataFrame:
    return regions.coverage(v.regions)


@query(
    """SELECT bin, count(*) AS n FROM (SELECT cast(floor(coalesce(best, 0) * 10 / ("end" - "start" + 1)) AS bigint) AS bin
        FROM regions LEFT JOIN (SELECT a.row_id, max(least(a."end", b."end") - greatest(a."start", b."start") + 1) AS best
        FROM regions a JOIN others b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.row_id) USING (row_id))
        GROUP BY bin"""
)
def overlap_fraction_hist(v: Views) -> DataFrame:
    return regions.overlap_histogram(v.regions, v.others, "row_id")


@query(
    """SELECT cov_a, cov_b, shared, 2 * shared / (cov_a + cov_b) AS overlap FROM
        (SELECT cast(sum("end" - "start" + 1) AS bigint) AS cov_a FROM ma), (SELECT cast(sum("end" - "start" + 1) AS bigint) AS cov_b FROM mb),
        (SELECT cast(sum(least(a."end", b."end") - greatest(a."start", b."start") + 1) AS bigint) AS shared
         FROM ma a JOIN mb b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end")""",
    ma=_merge_sql("regions", 0),
    mb=_merge_sql("others", 0),
)
def nuc_overlap(v: Views) -> DataFrame:
    return regions.nucleotide_overlap(v.regions, v.others)


@query(
    f"""WITH p AS (SELECT {_PAIR}) SELECT chrom, cast(sum(l_overlap) AS bigint) AS shared,
        (SELECT cast(sum("end" - "start" + 1) AS bigint) FROM regions r WHERE r.row_id IN (SELECT a_id FROM p q WHERE q.chrom = p.chrom)) AS touched_a,
        (SELECT cast(sum("end" - "start" + 1) AS bigint) FROM others r WHERE r.row_id IN (SELECT b_id FROM p q WHERE q.chrom = p.chrom)) AS touched_b
        FROM p GROUP BY chrom""".replace("WITH p AS", "SELECT * FROM (WITH p AS", 1)
    + ")"
)
def touched_overlap(v: Views) -> DataFrame:
    return regions.touched_overlap(v.regions, v.others, "row_id", "row_id")


@query("""SELECT a.chrom, count(*) AS n, cast(sum(CASE WHEN EXISTS (SELECT 1 FROM others b WHERE a.chrom = b.chrom
    AND a."start" <= b."end" AND b."start" <= a."end") THEN 1 ELSE 0 END) AS bigint) AS n_hit FROM regions a GROUP BY a.chrom""")
def hit_fraction(v: Views) -> DataFrame:
    return regions.hit_fraction(v.regions, v.others)


@query(
    """SELECT x.p, y.p AS q, count(*) AS n FROM m x JOIN m y USING (chrom, s) WHERE x.p <= y.p GROUP BY 1, 2""",
    merged=_merge_sql("regions", 0),
    m="""SELECT DISTINCT m.chrom, m."start" AS s, r.row_id % 7 AS p FROM merged m
         JOIN regions r ON m.chrom = r.chrom AND m."start" <= r."end" AND r."start" <= m."end" """,
)
def assoc_matrix(v: Views) -> DataFrame:
    return regions.association_counts(v.regions.withColumn("profile", F.col("row_id") % 7), "profile")


@query(
    """SELECT a.row_id, a.chrom, a."start", a."end", least(10000000, (SELECT min(greatest(0, a."start" - b."end", b."start" - a."end"))
        FROM others b WHERE a.chrom = b.chrom)) AS distance FROM regions a"""
)
def nearest_region(v: Views) -> DataFrame:
    return regions.nearest(v.regions, v.others, "row_id")


@query(
    """SELECT * FROM (SELECT *, least("start" - lag("end") OVER w, lead("start") OVER w - "end") AS distance,
        lag("end") OVER w AS b, lead("start") OVER w AS f FROM (SELECT DISTINCT chrom, "start", "end", name FROM regions)
        WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end", length(name), name))
        WHERE b IS NOT NULL AND f IS NOT NULL""".replace("SELECT * FROM (SELECT *, least", 'SELECT chrom, "start", "end", name, distance FROM (SELECT *, least', 1)
)
def self_distances(v: Views) -> DataFrame:
    return regions.self_distances(v.regions.select("chrom", "start", "end", "name").distinct())


@query("""SELECT * FROM (SELECT *, lead("start") OVER (PARTITION BY chrom ORDER BY row_id) - "end" AS distance FROM regions) WHERE distance IS NOT NULL""")
def successive_distances(v: Views) -> DataFrame:
    return regions.successive_distances(v.regions, "row_id")


_FLANK = 'name, strand, row_id, chrom'


@query(f"""SELECT {_FLANK}, CASE WHEN strand = '-' THEN '3p' ELSE '5p' END AS side, greatest(1, "start" - 20) AS "start", "start" - 1 AS "end"
        FROM regions WHERE "start" > 1 UNION ALL
        SELECT {_FLANK}, CASE WHEN strand = '-' THEN '5p' ELSE '3p' END, "end" + 1, "end" + 20 FROM regions""")
def flanks(v: Views) -> DataFrame:
    return regions.end_flanks(v.regions, 20)


@query(f"""SELECT {_FLANK}, greatest(1, CASE WHEN strand = '-' THEN "start" ELSE "start" - 10 END) AS "start",
        CASE WHEN strand = '-' THEN "end" + 10 ELSE "end" END AS "end" FROM regions""")
def extended(v: Views) -> DataFrame:
    return regions.extend(v.regions, 10, five_prime=True, three_prime=False)


@query(f"""SELECT {_FLANK}, greatest(1, ("start" + "end") // 2 - 15) AS "start", ("start" + "end") // 2 + 15 AS "end" FROM regions""")
def region_mids(v: Views) -> DataFrame:
    return regions.mids(v.regions, 30)


@query(f"""SELECT {_FLANK}, CASE WHEN strand = '-' THEN "end" ELSE "start" END AS tss,
        greatest(1, CASE WHEN strand = '-' THEN "end" ELSE "start" END - 100) AS "start",
        least(199990, CASE WHEN strand = '-' THEN "end" ELSE "start" END + 100) AS "end" FROM regions""")
def promoters(v: Views) -> DataFrame:
    sizes = v.spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chrom"), F.lit(200_000).cast("long").alias("length"))
    return regions.promoters(v.regions, sizes, 100)


@query(
    """SELECT * FROM (SELECT *, cast(coalesce(sum("end" - "start" + 1) OVER (PARTITION BY chrom ORDER BY row_id DESC, "start", "end", name
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS covered_before FROM regions) WHERE covered_before < 500"""
)
def top_by_coverage(v: Views) -> DataFrame:
    return regions.top_by_coverage(v.regions, 500, "row_id")


@query(
    """SELECT row_id, chrom, rank, round(log_p + ln(n / rank), 9) AS log_q FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY log_p, name) AS rank,
        count(*) OVER (PARTITION BY chrom) AS n FROM (SELECT row_id, chrom, 'r' || lpad(cast(row_id AS varchar), 12, '0') AS name,
        cast(-((row_id * 31) % 1000) AS double) / 8 AS log_p FROM regions))"""
)
def bh_correct(v: Views) -> DataFrame:
    tests = v.regions.select(
        "row_id", "chrom", F.concat(F.lit("r"), F.lpad(F.col("row_id").cast("string"), 12, "0")).alias("name"),
        (-((F.col("row_id") * 31) % 1000).cast("double") / 8).alias("log_p"),
    )
    found = regions.adjusted_p_values(tests, "log_p", ("chrom",))
    return found.select("row_id", "chrom", F.col("rank").cast("long").alias("rank"), F.round("log_q", 9).alias("log_q"))


@query("""SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY name, "start", "end" ORDER BY row_id) AS i FROM regions) WHERE i = 1""")
def eoi_dedup_frames(v: Views) -> DataFrame:
    from ..operators.elements import first_of

    return first_of(v.regions, ["name", "start", "end"], ["row_id"])


# ---------------------------------------------------------------- tracks


@query("SELECT DISTINCT chrom, track_pos, alt FROM hits")
def variant_track_snv(v: Views) -> DataFrame:
    return tracks.snv_track(v.variants, v.axis)


@query("""SELECT DISTINCT v.chrom, a.track_offset + v.pos - a."start" AS track_pos FROM indels v JOIN axis a
    ON v.chrom = a.chrom AND v.pos >= a."start" AND v.pos + 1 <= a."end" WHERE length(v.ref) < length(v.alt)""")
def variant_track_ins(v: Views) -> DataFrame:
    return tracks.insertion_track(v.indels, v.axis)


@query("""SELECT DISTINCT chrom, track_offset + b - s AS track_pos FROM (
    SELECT d.chrom, a.track_offset, a."start" AS s, unnest(range(greatest(d.d_start, a."start"), least(d.d_end, a."end") + 1)) AS b
    FROM dels d JOIN axis a ON d.chrom = a.chrom AND d.d_start <= a."end" AND a."start" <= d.d_end)""")
def variant_track_del(v: Views) -> DataFrame:
    return tracks.deletion_track(v.indels, v.axis)


@query("SELECT * FROM impacts")
def impact_track(v: Views) -> DataFrame:
    return v.impacts


@query("SELECT i.* FROM impacts i JOIN (SELECT DISTINCT chrom, track_pos + vid % 2 AS track_pos, alt FROM hits) USING (chrom, track_pos, alt)")
def annotated_track(v: Views) -> DataFrame:
    hits = overlap.points_in(v.variants, v.axis)
    moved = tracks.track_position(F.col("pos")) + F.col("vid") % 2
    return tracks.multiply(v.impacts, hits.select("chrom", moved.alias("track_pos"), "alt").distinct())


@query("""SELECT i.chrom, i.pos, i.alt, a.name AS element, t.bit, t.term FROM impacts i
    JOIN axis a ON i.chrom = a.chrom AND i.track_pos BETWEEN a.track_offset AND a.track_offset + a."end" - a."start"
    JOIN terms t ON (i.mask >> t.bit) & 1 = 1""")
def decode_terms(v: Views) -> DataFrame:
    return tracks.decoded_terms(v.impacts, v.axis)


@query("""SELECT line_no FROM vep v WHERE NOT EXISTS (SELECT 1 FROM axis a WHERE v.chrom = a.chrom AND v.element = a.name
    AND v.pos + 5 BETWEEN a."start" AND a."end")""")
def unmatched_annotations(v: Views) -> DataFrame:
    moved = v.annotations.withColumn("pos", F.col("pos") + 5)
    return tracks.unmatched_annotations(moved, v.axis).select("line_no")


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_SNV_SQL = f"""SELECT chrom, pos, vid, ref, alt, element, strand, track_pos, c1.aa AS ref_aa, c2.aa AS alt_aa,
    (SELECT string_agg(t.term, ';' ORDER BY t.bit) || ';' FROM terms t WHERE (mask >> t.bit) & 1 = 1) AS impact
    FROM (SELECT *, CASE WHEN strand = '-' THEN {_RC.format('o7')} ELSE o7 END AS o, CASE WHEN strand = '-' THEN {_RC.format('n7')} ELSE n7 END AS n
      FROM (SELECT *, substr(neigh, 1, 3) || ref || substr(neigh, 4, 3) AS o7, substr(neigh, 1, 3) || alt || substr(neigh, 4, 3) AS n7
        FROM (SELECT h.chrom, h.pos, h.vid, h.ref, h.alt, h.element, h.strand, h.track_pos, i.frame, i.mask, {neigh_sql("h.chrom", "h.pos")} AS neigh
          FROM hits h JOIN impacts i USING (chrom, track_pos, alt))))
    LEFT JOIN codons c1 ON c1.codon = substr(o, 4 - frame, 3) LEFT JOIN codons c2 ON c2.codon = substr(n, 4 - frame, 3)"""


@query(_SNV_SQL)
def translate_snv(v: Views) -> DataFrame:
    return translate.translate_snv(v.with_bases(v.variants), v.axis, v.placed_impacts())


# ---------------------------------------------------------------- genotypes


@query("""SELECT vid, cast(sum(dosage) AS bigint) AS allele_count, cast(sum(CASE WHEN dosage > 0 THEN 1 ELSE 0 END) AS bigint) AS carriers,
    count(dosage) AS n_called FROM genotypes GROUP BY vid""")
def allele_count(v: Views) -> DataFrame:
    return genotypes.allele_counts(v.genotypes)


@query("SELECT h.chrom, h.track_pos, h.alt, g.sample, bit_or(g.dosage) AS code FROM hits h JOIN genotypes g USING (vid) WHERE g.dosage > 0 GROUP BY 1, 2, 3, 4")
def encode_snv(v: Views) -> DataFrame:
    return genotypes.snv_matrix(v.genotypes, v.variants, v.axis)


@query("""SELECT chrom, track_pos, sample, bit_or(dosage) AS code FROM (
    SELECT d.chrom, d.vid, unnest(range(a.track_offset + d.d_start - a."start", a.track_offset + d.d_end - a."start" + 1)) AS track_pos
    FROM dels d JOIN axis a ON d.chrom = a.chrom AND d.d_start >= a."start" AND d.d_end <= a."end") JOIN genotypes g USING (vid)
    WHERE g.dosage > 0 GROUP BY 1, 2, 3""")
def encode_del(v: Views) -> DataFrame:
    return genotypes.deletion_matrix(v.genotypes, v.indels, v.axis)


from . import catalog_domain, catalog_files, catalog_library, catalog_more  # noqa: E402,F401  register the remaining queries
