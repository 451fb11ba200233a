"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into segments and mapped to the number of set bits of each.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints,
so every pair within ``max_bits`` lies within ``max_bits`` in the grid as well.

Grid join: the segments form ``blocks`` blocks.  If the distance is at most k, at least
``blocks - k`` blocks have equal counts, so the pair shares a grid cell for some choice of that
many blocks.  Each distinct fingerprint enters one cell per choice; within a cell the Manhattan
bound filters and the exact bit distance decides.  A cell yields a spanning forest of its links,
never all pairs, and a large cell is worked off in blocks of bounded size.

Links between distinct fingerprints become components by alternating star contraction.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, text_bytes

SEED = 42
SHINGLE = 4
MAX_BITS = 4
SEGMENT_BITS = 2
BLOCKS = 8
#: Fingerprints of a cell compared at once (rows x rows bytes of working memory).
CELL_BLOCK = 2_048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority vote of the shingles' XXH64 hashes; 0 for a text without words."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(joined, seed), "big")
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    total = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, total, 65_536):
        hi = min(total, lo + 65_536)
        hashes = b"".join([xxh64_digest(joined[s : e - 1], seed) for s, e in zip(starts[lo:hi], starts[lo + shingle : hi + shingle])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, ``fp`` (the 64 bits as a signed long) and the text's SHA-256, one row per input row."""

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # few texts at a time outside the batch
                keys, texts = rows_of(batch.slice(at, 512))
                prints = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
                digests = pa.array([sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prints), digests], ["doc_id", "fp", "digest"])

    return text_bytes(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long, digest string")


def segment_counts(prints: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """Per-segment bit counts, one row per fingerprint: the embedding."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(prints), 64 // segment_bits, segment_bits).sum(2, dtype=np.uint8)


def cell_keys(prints: np.ndarray, max_bits: int, segment_bits: int, blocks: int) -> np.ndarray:
    """One grid cell id per fingerprint and choice of ``blocks - max_bits`` blocks (rows x choices)."""
    counts = segment_counts(prints, segment_bits)
    edges = np.linspace(0, counts.shape[1], blocks + 1).astype(int)
    base = segment_bits + 1
    codes = np.zeros((len(prints), blocks), np.uint64)
    for b in range(blocks):
        for s in range(edges[b], edges[b + 1]):
            codes[:, b] = codes[:, b] * np.uint64(base) + counts[:, s]
    choices = list(combinations(range(blocks), blocks - max_bits))
    keys = np.empty((len(prints), len(choices)), np.uint64)
    with np.errstate(over="ignore"):
        for c, chosen in enumerate(choices):
            mixed = np.full(len(prints), c + 1, np.uint64)
            for b in chosen:  # injective up to 64 bits; beyond that a collision only adds a candidate
                mixed = mixed * np.uint64(base ** int(edges[b + 1] - edges[b])) + codes[:, b]
            keys[:, c] = mixed * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def near_pairs(prints: np.ndarray, runs: np.ndarray, max_bits: int, segment_bits: int = SEGMENT_BITS):
    """Index pairs (i, j) of equal ``runs`` (sorted) within ``max_bits``, one offset j - i at a time.

    The Manhattan distance in the embedding filters, the exact bit distance decides.
    """
    counts = segment_counts(prints.view(np.uint64), segment_bits).astype(np.int8)
    alive = np.arange(len(prints))
    for step in range(1, len(prints)):
        alive = alive[alive + step < len(prints)]
        alive = alive[runs[alive] == runs[alive + step]]
        if not len(alive):
            return
        bound = np.abs(counts[alive] - counts[alive + step]).sum(1, dtype=np.int16)
        i = alive[bound <= max_bits]
        i = i[np.bitwise_count((prints[i] ^ prints[i + step]).view(np.uint64)) <= max_bits]
        if len(i):
            yield i, i + step


def spanning(pairs, prints: np.ndarray) -> list[tuple[int, int]]:
    """Of verified pairs, those that join two trees: connects the same, fewer than fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for left, right in pairs:
        for a, b in zip(prints[left].tolist(), prints[right].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                links.append((max(a, b), min(a, b)))
    return links


def links_between(prints: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS, blocks: int = BLOCKS, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Links (a > b) between distinct fingerprints ``fp`` that connect every pair within ``max_bits``.

    A cell of more than ``cell_block`` fingerprints is dealt into blocks of about that many by a hash, and
    each pair of blocks is compared on its own, so no task orders or holds more than two blocks of a cell.
    """

    def keyed(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 4_096):
                part = fps[lo : lo + 4_096]
                keys = cell_keys(part.view(np.uint64), max_bits, segment_bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], ["cell", "fp"])

    cells = prints.select("fp").mapInArrow(keyed, "cell long, fp long")
    # Sizes first: a cell is then split by a hash of the fingerprint, and no task orders a cell.
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    last = F.floor((F.col("n") - 1) / cell_block).cast("int")
    own = F.pmod(F.xxhash64("fp"), last + 1).cast("int")
    # Hashed, not sorted: the sizes of crowded cells are far fewer than the rows that look them up.
    crowded = cells.join(sizes.hint("shuffle_hash"), "cell").select("cell", "fp", last.alias("last"), own.alias("own"))
    met = crowded.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    met = met.select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table):
            tags = [rows.column(n).to_numpy() for n in ("cell", "p", "q")]
            change = np.zeros(rows.num_rows, bool)
            for tag in tags:
                change[1:] |= tag[1:] != tag[:-1]
            fps = rows.column("fp").to_numpy()
            links = spanning(near_pairs(fps, np.cumsum(change), max_bits, segment_bits), fps)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            end = rows.slice(rows.num_rows - 1) if rows.num_rows else rows
            if rows.num_rows == 0:
                continue
            same = np.ones(rows.num_rows, bool)
            for n in ("cell", "p", "q"):
                same &= rows.column(n).to_numpy() == end.column(n)[0].as_py()
            whole_runs = int(np.argmax(same))  # the last run may go on in the next batch
            if whole_runs:
                yield work(rows.slice(0, whole_runs))
            held = rows.slice(whole_runs).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    dealt = met.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, root being the smallest node of its component.

    Alternating large-star and small-star contraction: each round is two grouped minima and two
    joins on the links, and is written to the shared folder before the next.
    """
    edges, seen = materialize(links.select("a", "b").where("a <> b"), "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").distinct(), "links")
        discard(edges)
        edges = new


def _labelled(docs, id_col, text_col, shingle, seed, max_bits, segment_bits, blocks) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, digest) per row, and (fp, root) per distinct fingerprint."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = prints.select("fp").distinct()
    stars = components(links_between(classes, max_bits, segment_bits, blocks))
    rooted = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, rooted


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    max_bits: int = MAX_BITS,
    segment_bits: int = SEGMENT_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of ``max_bits`` or fewer differing bits are linked; component_id is the smallest
    doc_id reachable over links (equal fingerprints are one node).  Texts without words, null
    ones included, have fingerprint zero and are linked like any other.  Null ids stay null and
    never name a component (a component of null ids only has component_id null).  Repeated rows
    stay.  An empty table gives no rows.  Columns other than id and text are ignored.
    """
    prints, rooted = _labelled(docs, id_col, text_col, shingle, seed, max_bits, segment_bits, blocks)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = rooted.join(first, "fp")
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = classes.join(named, "root").select("fp", "component_id")
    return prints.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    max_bits: int = MAX_BITS,
    segment_bits: int = SEGMENT_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: exactly one row of each.

    That is the row of the smallest id (null ids last), and of those the one whose text's SHA-256
    is least.  Rows equal in id and text are one row.
    """
    prints, rooted = _labelled(docs, id_col, text_col, shingle, seed, max_bits, segment_bits, blocks)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(rooted, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = best.select(_row_key(F.col("best.doc_id"), F.col("best.digest")).alias("key"))
    # The row goes as one struct beside its key, so no column of it can clash with the key's name.  One
    # key of one column: the join and the removal of repeats share a single shuffle of the rows.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256)
    tagged = docs.select(_row_key(F.col(f"`{id_col}`"), digest).alias("key"), row)
    return tagged.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _row_key(row_id: Column, digest: Column) -> Column:
    return F.concat(digest, F.when(row_id.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), row_id.cast("string"))))
