"""Sequences: extraction, k-mers, motifs, walks, recombination and allele-frequency statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import base_code, is_gc, oriented, reverse_complement
from ..functions.text import derived_frequency
from .ordering import sums_before, with_neighbours
from .overlap import BIN, points_in, prefixed
from .regions import STRETCH, stretch
from .tracks import CHUNK

# ---------------------------------------------------------------- extraction


def extract(regions: DataFrame, bases: DataFrame, row_id: str, size: int = BIN) -> DataFrame:
    """Adds ``seq``, the region's bases read on its strand; missing bases are N."""
    inside = points_in(bases, regions, size=size)
    pieces = inside.groupBy(F.col("r_" + row_id).alias(row_id)).agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("_m"))
    joined = regions.where("start <= end").join(pieces, row_id, "left")
    text = F.array_join(F.transform(F.sequence("start", "end"), lambda p: F.coalesce(F.try_element_at("_m", p), F.lit("N"))), "")
    return joined.withColumn("seq", oriented(text, F.col("strand"))).drop("_m")


def extract_chunked(regions: DataFrame, chunks: DataFrame, row_id: str, chunk: int = CHUNK) -> DataFrame:
    """As :func:`extract` from sequence chunks: each region meets the few chunks it spans."""
    at = F.explode(F.sequence(F.floor(F.col("start") / chunk).cast("long"), F.floor(F.col("end") / chunk).cast("long")))
    cut = regions.where("start <= end").withColumn("_k", at)
    side = chunks.select(F.col("chrom").alias("_c"), F.col("chunk").alias("_q"), F.col("first").alias("_f"), F.col("seq").alias("_s"))
    joined = cut.join(side, (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_q")), "left")
    start = F.greatest("start", F.col("_k") * chunk)
    end = F.least("end", (F.col("_k") + 1) * chunk - 1)
    padded = F.concat(F.repeat(F.lit("N"), F.greatest(F.lit(0), F.col("_f") - start).cast("int")), "_s")
    text = F.substring(padded, F.greatest(F.lit(1), start - F.col("_f") + 1).cast("int"), (end - start + 1).cast("int"))
    piece = F.rpad(F.coalesce(text, F.lit("")), (end - start + 1).cast("int"), F.lit("N"))
    parts = joined.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return regions.join(parts, row_id).withColumn("seq", oriented(F.col("seq"), F.col("strand")))


def spliced(exon_sequences: DataFrame, key: str) -> DataFrame:
    """Concatenated exon sequences per transcript in reading order, with length and reading-frame validity."""
    rank = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    pieces = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "seq")))
    joined = exon_sequences.groupBy(key, "strand").agg(F.array_join(F.transform(pieces, lambda x: x["seq"]), "").alias("seq"))
    return joined.withColumns({"length": F.length("seq"), "in_frame": F.length("seq") % 3 == 0})


def running_frame(exons: DataFrame, key: str) -> DataFrame:
    """Adds transcript_before, the bases of the transcript before each exon, and its coding frame."""
    rank = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    before = Window.partitionBy(key).orderBy(rank, "end").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(before), F.lit(0))
    return exons.withColumn("transcript_before", total).withColumn("frame", (total % 3).cast("int"))


# ---------------------------------------------------------------- k-mers


def kmers(sequences: DataFrame, k: int, seq: str = "seq", both_strands: bool = False) -> DataFrame:
    """One row per window of ``k`` bases: all columns but the sequence, i (from 1) and kmer."""
    kept = [c for c in sequences.columns if c != seq]
    long_enough = sequences.where(F.length(seq) >= k)
    rows = long_enough.select(*kept, F.col(seq), F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("i"))
    rows = rows.select(*kept, "i", F.upper(F.substring(F.col(seq), F.col("i"), F.lit(k))).alias("kmer"))
    if not both_strands:
        return rows
    other = rows.withColumn("kmer", reverse_complement(F.col("kmer")))
    return rows.unionByName(other)


def kmer_counts(sequences: DataFrame, k: int, seq: str = "seq", both_strands: bool = True) -> DataFrame:
    return kmers(sequences.select(seq), k, seq, both_strands).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_prefix_totals(counts: DataFrame, length: int) -> DataFrame:
    """Counts rolled up to prefixes."""
    return counts.groupBy(F.substring("kmer", 1, length).alias("prefix")).agg(F.sum("n").alias("n"))


def kmer_background(counts: DataFrame) -> DataFrame:
    """Adds expected, the count under independent bases with the bases' frequencies in the k-mers themselves."""
    flat = counts.select("kmer", "n", F.explode(F.split("kmer", "")).alias("b")).where("b <> ''")
    base = flat.groupBy("b").agg(F.sum("n").alias("bn"))
    total = flat.agg(F.sum("n").alias("all")).first()["all"] or 0
    logs = flat.join(base, "b").groupBy("kmer").agg(F.sum(F.log(F.col("bn") / F.lit(float(max(1, total))))).alias("lp"))
    size = counts.agg(F.sum("n").alias("m")).first().m or 0
    return counts.join(logs, "kmer").select("kmer", "n", (F.exp("lp") * F.lit(float(size))).alias("expected"))


def enriched_kmers(positive: DataFrame, negative: DataFrame, most: int = 2000) -> DataFrame:
    """K-mers whose share is greater in the positive counts, the most frequent ``most`` first."""
    shares = []
    for counts, name in ((positive, "pos"), (negative, "neg")):
        total = counts.agg(F.sum("n").alias("t"))
        shares.append(counts.crossJoin(F.broadcast(total)).select("kmer", F.col("n").alias(f"n_{name}"), (F.col("n") / F.col("t")).alias(f"share_{name}")))  # one row
    joined = shares[0].join(shares[1], "kmer", "left").fillna(0)
    best = joined.where("share_pos > share_neg").orderBy(F.desc("n_pos"), "kmer").limit(most)
    return best.select("kmer", "n_pos", "n_neg", "share_pos", "share_neg")


def gapped_distances(a: np.ndarray, b: np.ndarray, gap: float = 1.0, band: int = 3) -> np.ndarray:
    """Edits between rows of two letter matrices, pair by pair, where end gaps up to ``band`` cost nothing.

    One edit-distance table per shift, filled cell by cell for all pairs at once.
    """
    best = np.full(len(a), np.inf)
    for shift in range(-band, band + 1):
        x, y = (a[:, shift:], b) if shift >= 0 else (a, b[:, -shift:])
        n = min(x.shape[1], y.shape[1])
        row = np.tile(np.arange(n + 1) * gap, (len(a), 1))
        for i in range(1, n + 1):
            swapped = row[:, :-1] + (x[:, i - 1 : i] != y[:, :n])
            next_row = np.empty_like(row)
            next_row[:, 0] = i * gap
            np.minimum(swapped, row[:, 1:] + gap, out=next_row[:, 1:])
            for j in range(1, n + 1):
                np.minimum(next_row[:, j], next_row[:, j - 1] + gap, out=next_row[:, j])
            row = next_row
        best = np.minimum(best, row[:, n])
    return best


def gapped_distance(a: str, b: str, gap: float = 1.0, band: int = 3) -> float:
    """:func:`gapped_distances` of one pair of k-mers."""
    letters = [np.frombuffer(x.encode(), np.uint8).reshape(1, -1) for x in (a, b)]
    return float(gapped_distances(*letters, gap, band)[0])


def kmer_distances(kmers: DataFrame, band: int = 3, most: int = 5_000) -> DataFrame:
    """Gapped distance of each pair among a bounded list of k-mers of one length (such as a top-2000).

    A list of more than ``most`` is refused: every pair is a row.
    """
    if kmers.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} k-mers; take the most frequent ones first")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer("".join(s).encode(), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series(gapped_distances(x, y, band=band))

    side = kmers.select("kmer")
    both = side.join(F.broadcast(side.withColumnRenamed("kmer", "other")), F.col("kmer") < F.col("other"))
    return both.withColumn("distance", distance("kmer", "other"))


def is_low_complexity(kmer: Column, share: float = 0.8) -> Column:
    """One base makes up at least ``share`` of it."""
    counts = [F.length(kmer) - F.length(F.replace(kmer, F.lit(b), F.lit(""))) for b in "ACGT"]
    return F.greatest(*counts) >= F.length(kmer) * share


# ---------------------------------------------------------------- motifs


def motif_score(kmer: Column, weights: list[dict[str, float]]) -> Column:
    """Sum of position weights; an unknown base adds the position's least weight."""
    score = F.lit(0.0)
    for i, w in enumerate(weights):
        base = F.substring(kmer, i + 1, 1)
        value = F.lit(float(min(w.values())))
        for b, x in w.items():
            value = F.when(base == b, F.lit(float(x))).otherwise(value)
        score = score + value
    return score


def motif_scan(sequences: DataFrame, key: str, weights: list[dict[str, float]], seq: str = "seq") -> DataFrame:
    """Best window of each sequence over both strands: key, i, strand, kmer, score."""
    rows = kmers(sequences.select(key, seq), len(weights), seq)
    both = rows.select(key, "i", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("kmer").alias("kmer")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("kmer")).alias("kmer")))).alias("w"))
    scored = both.select(key, "i", "w.strand", "w.kmer", motif_score(F.col("w.kmer"), weights).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("i")).alias("ni"), "strand", "kmer")).alias("x"))
    return best.select(key, (-F.col("x.ni")).alias("i"), "x.strand", "x.kmer", F.col("x.score").alias("score"))


def fit_motif(sequences: DataFrame, key: str, k: int, rounds: int = 10, seed: int = 1, seq: str = "seq") -> list[dict[str, float]]:
    """Hard expectation maximisation of a position weight matrix: the best window of each sequence is counted.

    Only the k x 4 counts come to the driver in each round.
    """
    draw = np.random.default_rng(seed)
    weights = [dict(zip("ACGT", np.log(p))) for p in draw.dirichlet(np.full(4, 4.0), k)]
    for _ in range(rounds):
        best = motif_scan(sequences, key, weights, seq)
        flat = best.select(F.posexplode(F.split("kmer", "")).alias("p", "b")).where("b in ('A', 'C', 'G', 'T')")
        counts = np.ones((k, 4))
        for r in flat.groupBy("p", "b").count().collect():
            if r.p < k:
                counts[r.p, "ACGT".index(r.b)] += r["count"]
        new = [dict(zip("ACGT", np.log(row / row.sum()))) for row in counts]
        if all(abs(new[i][b] - weights[i][b]) < 1e-9 for i in range(k) for b in "ACGT"):
            return new
        weights = new
    return weights


def shuffled(seq: Column, seed: int, salt: Column) -> Column:
    """The letters of a sequence in an order drawn from (salt, seed): by the MD5 of salt, seed and place."""
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    keyed = F.transform(letters, lambda x, i: F.struct(F.md5(F.concat_ws("|", salt.cast("string"), F.lit(str(seed)), (i + 1).cast("string"))).alias("h"), x.alias("b")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["b"]), "")


def motif_null(sequences: DataFrame, key: str, weights: list[dict[str, float]], replicates: int = 10, seed: int = 1, seq: str = "seq") -> DataFrame:
    """Mean and deviation of the best score over shuffled copies of each sequence."""
    copies = sequences.select(F.col(key), F.col(seq), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r"))
    copies = copies.select(F.struct(F.col(key), "_r").alias("_k"), shuffled(F.col(seq), seed, F.concat(F.col(key).cast("string"), F.lit("/"), F.col("_r").cast("string"))).alias(seq))
    scores = motif_scan(copies, "_k", weights, seq)
    return scores.groupBy(F.col("_k")[key].alias(key)).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("deviation"))


# ---------------------------------------------------------------- walks


def dna_walk(bases: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Running sum of +1 for a pyrimidine and -1 for a purine, with GC flag and base code."""
    upper = F.upper("base")
    step = F.when(upper.isin("C", "T", "U"), 1).when(upper.isin("A", "G"), -1).otherwise(0)
    walked = sums_before(bases, list(keys), stretch("pos"), ["pos"], {"walk": step}).withColumn("walk", F.col("walk") + step)
    return walked.withColumns({"gc": is_gc(F.col("base")).cast("int"), "code": base_code(F.col("base"))})


def centred_kmer_values(bases: DataFrame, k: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Base-4 number of the k-mer centred on each base (odd k), lowest digit first; null where a base of it is missing.

    Bases near a border between stretches are dealt to both, so every k-mer lies in one of them.
    """
    half = k // 2
    near = F.array_distinct(F.array(*[F.floor((F.col("pos") + o) / F.lit(STRETCH)).cast("long") for o in (-half, 0, half)]))
    dealt = bases.withColumn("_stretch", F.explode(near))
    frame = Window.partitionBy(*keys, "_stretch").orderBy("pos")
    code = base_code(F.col("base"))

    def digit(o: int) -> Column:
        if o == 0:
            return code
        move = F.lead if o > 0 else F.lag
        return F.when(move("pos", abs(o)).over(frame) == F.col("pos") + o, move(code, abs(o)).over(frame))

    value = digit(-half).cast("long")
    for i, o in enumerate(range(-half + 1, half + 1), 1):
        value = value + digit(o) * (4**i)
    return dealt.withColumn("value", value).where(F.col("_stretch") == stretch("pos")).drop("_stretch")


# ---------------------------------------------------------------- populations


def recombination_intervals(points: DataFrame) -> DataFrame:
    """Half-open map intervals (start, end, cm_left, cm_right) from (chrom, pos, cm) points."""
    left = with_neighbours(points.select("chrom", "pos", "cm"), ["chrom"], stretch("pos"), [F.col("pos")], {"start": "pos", "cm_left": "cm"}, {})
    return left.where("start is not null").select("chrom", "start", F.col("pos").alias("end"), "cm_left", F.col("cm").alias("cm_right"))


def cm_at(positions: DataFrame, points: DataFrame, position: str = "pos", name: str = "cm") -> DataFrame:
    """Adds the map value at a position, linear between points; outside the map the nearest point counts.

    As-of lookups on both sides over a sorted union, within stretches and then over one row per stretch.
    """
    ours = positions.withColumns({"_p": F.col(position), "_m": F.lit(None).cast("double"), "_own": F.lit(1)})
    theirs = points.select(F.col("chrom"), F.col("pos").alias("_p"), F.col("cm").alias("_m"), F.lit(0).alias("_own"))
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_stretch", stretch("_p"))
    back = Window.partitionBy("chrom", "_stretch").orderBy("_p", "_own").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("chrom", "_stretch").orderBy(F.desc("_p"), "_own").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("_own") == 0, F.struct("_p", "_m"))
    found = both.withColumns({"_l": F.last(here, ignorenulls=True).over(back), "_r": F.last(here, ignorenulls=True).over(ahead)}).where("_own = 1")
    along = Window.partitionBy("_c").orderBy("_k")
    edges = both.groupBy(F.col("chrom").alias("_c"), F.col("_stretch").alias("_k")).agg(F.max(here).alias("_top"), F.min(here).alias("_low"))
    edges = edges.select(
        "_c", "_k", F.last("_top", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_low", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"),
    )
    found = found.join(edges, F.col("chrom").eqNullSafe(F.col("_c")) & F.col("_stretch").eqNullSafe(F.col("_k")))
    found = found.withColumns({"_l": F.coalesce("_l", "_before"), "_r": F.coalesce("_r", "_behind")})
    share = (F.col("_p") - F.col("_l._p")) / (F.col("_r._p") - F.col("_l._p"))
    between = F.col("_l._m") + share * (F.col("_r._m") - F.col("_l._m"))
    value = F.when(F.col("_l").isNull(), F.col("_r._m")).when(F.col("_r").isNull() | (F.col("_r._p") == F.col("_l._p")), F.col("_l._m")).otherwise(between)
    return found.select(*positions.columns, value.alias(name))


def cm_distance(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Adds delta_cm between (chrom, start) and (chrom, end)."""
    one = cm_at(pairs, points, "start", "cm_start")
    return cm_at(one, points, "end", "cm_end").withColumn("delta_cm", F.col("cm_end") - F.col("cm_start"))


def allele_frequencies(variants: DataFrame, compat: bool = False) -> DataFrame:
    """Adds daf from INFO's AA, AC and AN."""
    return variants.withColumn("daf", derived_frequency(F.col("info"), F.col("ref"), F.col("alt"), compat))


def mutation_matrix(variants: DataFrame, low: float, high: float) -> DataFrame:
    """Ancestral by derived base counts of variants with low < daf < high: one row per ancestral base."""
    cut = variants.where((F.col("daf") > low) & (F.col("daf") < high))
    return cut.groupBy("ancestral").pivot("derived", list("ACGT")).count().fillna(0)


def verified_snp(ref: Column, ancestral: Column, alt: Column, genome_base: Column, strand: Column) -> Column:
    """REF is the genome's base on its strand, and the ancestral allele is REF or ALT."""
    return (F.upper(ref) == F.upper(oriented(genome_base, strand))) & (F.upper(ancestral).isin(F.upper(ref), F.upper(alt)))


def random_sequences(spark, n: int, length: int, seed: int = 1, embedded: str | None = None, mutation: float = 0.0) -> DataFrame:
    """``n`` sequences of random bases, drawn from (row, place, seed), optionally holding a mutated k-mer at a random place."""
    from .simulate import uniform

    def base(*key: Column) -> Column:
        return F.substring(F.lit("ACGT"), (F.floor(uniform(seed, *key) * 4) + 1).cast("int"), F.lit(1))

    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: base(F.col("id"), i))
    rows = spark.range(n).select("id", F.array_join(letters, "").alias("seq"))
    if not embedded:
        return rows
    k = len(embedded)
    mutated = [
        F.when(uniform(seed, F.col("id"), F.lit(i + 1), F.lit("changes")) < mutation, base(F.col("id"), F.lit(i + 1), F.lit("to"))).otherwise(F.lit(c))
        for i, c in enumerate(embedded)
    ]
    place = (F.floor(uniform(seed, F.col("id"), F.lit("place")) * (length - k + 1)) + 1).cast("int")
    return rows.withColumn("place", place).withColumn("seq", F.overlay("seq", F.concat(*mutated), F.col("place"), F.lit(k)))


def same_sequences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose sequences differ between two tables: a validation query."""
    return a.join(prefixed(b, "b_"), F.col(key) == F.col("b_" + key)).where(F.col("seq") != F.col("b_seq")).select(key)
