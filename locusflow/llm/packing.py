"""Shortest-pack-first packing over the length histogram.

1. Each document becomes ids plus an end id and is cut into full pieces and one rest.
2. The histogram of rests (at most ``capacity`` bins, whatever the corpus size) is packed on
   the driver, longest length first, always into the shortest pack that has room; packs with
   the same pattern are one counted group, so the work depends on the bins only.
3. A placement says: of length L, the items ranked [lo, lo+n) go to sequences [s, s+n) at an
   offset.  Pieces get their rank within their length and look their placement up.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_bytes
from .pretokens import chunk_ids

CAPACITY = 4096
END_ID = 2
CACHED = 1_000_000
#: Rows that one window partition ranks, about; the number of buckets follows from the data.
RANKED_TOGETHER = 50_000
#: Copies of one row that are written out from one row, at most.
COPIES = 4_096


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) for a histogram of lengths.

    Groups of packs with one pattern are contiguous ranges of sequence numbers.  The open group
    that is shortest (most room) takes the next items; if too few items are left, it is split
    into the filled part and the rest.  Where no pack has room, new ones are opened; each is then the
    shortest until no further item fits, so it takes as many as it holds.  That is what one item at a
    time would give.  Numbers start at 0 and have no gaps.
    """
    placements: list[tuple[int, int, int, int, int]] = []
    open_packs: list[tuple[int, int, int, int]] = []  # (used, tie, first sequence, count)
    ties, sequences = counter(), 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                used, _, first, n = heapq.heappop(open_packs)
                take = min(n, left)
                if take < n:
                    heapq.heappush(open_packs, (used, next(ties), first + take, n - take))
                opened = [(take, used, 1)]
            else:
                each = capacity // length
                first, used = sequences, 0
                opened = [(n, used, items) for n, items in ((left // each, each), (1, left % each)) if n and items]
            for n, used, items in opened:
                for i in range(items):
                    placements.append((length, rank, n, first, used + i * length))
                    rank, left = rank + n, left - n
                if used + items * length < capacity:
                    heapq.heappush(open_packs, (used + items * length, next(ties), first, n))
                first += n
                sequences = max(sequences, first)
    return placements


def cut_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int, cached: int) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens: full pieces first, then the rest."""
    tail = end_id.to_bytes(4, "little")

    def cut(batches):
        ids = chunk_ids(vocabulary, cached)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for key, text in zip(*rows_of(batch)):
                packed = ids.text_ids(text) + tail
                total = len(packed) // 4
                for start in range(0, total, capacity):
                    piece = packed[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (key, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, out)})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return text_bytes(docs, id_col, text_col).mapInArrow(cut, schema)


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length, without bringing a length into one task.

    Rows of a length are spread over buckets by a hash; a bucket is ranked by a window and
    moved by the size of the buckets before it.  The buckets grow with the table.  Equal rows are one
    row with a count until they have their ranks, so copies of a row do not crowd a bucket either.
    """
    buckets = max(1, -(-total // RANKED_TOGETHER))
    own = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    counted = pieces.groupBy("length", *own).agg(F.count(F.lit(1)).alias("copies"))
    spread = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = sizes.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    first = spread.withColumn("i", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["length", "bucket"])
    first = first.withColumn("first", F.col("base") + F.col("i")).withColumn("last", F.col("first") + F.col("copies") - 1)
    # In two steps, so that no list of ranks is longer than COPIES.
    some = first.withColumn("first", F.explode(F.sequence("first", "last", F.lit(COPIES).cast("long"))))
    every = F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + COPIES - 1)))
    return some.withColumn("rank", every).drop("bucket", "i", "base", "first", "last", "copies")


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    cached: int = CACHED,
) -> DataFrame:
    """Packs whole documents; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document
    longer than ``capacity`` is cut into full pieces and a rest; each id lies in one piece.
    Null and empty texts are one piece holding the end id.  A null id stays null.  Repeated rows
    are packed as often as they occur.  An empty table gives no rows.  Columns other than id and
    text are ignored.  The result is the same for the same rows in any order.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, vocabulary, id_col, text_col, capacity, end_id, cached), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements = shortest_pack_first(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for length, *rest in placements:
        by_length.setdefault(length, []).append(rest)
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def place(batches):
        plan = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(order)]):
                rows = order[lo:hi]
                table = plan[int(lengths[rows[0]])]
                at = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = table[at, 2] + ranks[rows] - table[at, 0]
                offset[rows] = table[at, 3]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    numbered = ranked(pieces, sum(histogram.values()))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)
