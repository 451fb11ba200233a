"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their id counts, built once on the
driver from a bounded sample and broadcast.  Tier two is each worker's own bounded cache: a
chunk outside tier one is encoded by the library once and then remembered.  Documents never
leave their partition, so no pre-token is shuffled.

Both tiers are caches: whatever they hold, a count is the library's count of the whole text.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_bytes
from .pretokens import chunk_ids, vocabulary_path

#: Entries of the broadcast table; at most this many chunks of at most 64 bytes (about 4 MB).
FREQUENT = 32_768
#: Documents read to pick them (a warm-up of the cache, not a statistic of the result).
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 32_768
#: Entries of a worker's cache.
CACHED = 1_000_000


class FrequentTable:
    """Frequent chunks packed as one byte string with lengths, and the length in ids of each."""

    def __init__(self, chunks: list[bytes], ids: list[bytes]):
        self.blob = b" ".join(chunks)
        self.id_blob = b"".join(ids)
        self.counts = bytes(min(255, len(i) // 4) for i in ids)
        self.key = hash((self.blob, self.counts))

    def unpack(self) -> dict[bytes, bytes]:
        out, at = {}, 0
        for chunk, n in zip(self.blob.split(), self.counts):
            out[chunk] = self.id_blob[at : at + 4 * n]
            at += 4 * n
        return out


def frequent_table(docs: DataFrame, text_col: str, vocabulary: str, entries: int, sample_docs: int) -> FrequentTable:
    """Tier one: the most frequent chunks of the first ``sample_docs`` texts; empty for an empty table.

    The limit is taken partition by partition, so a large table is not scanned for it, and a text
    adds at most ``SAMPLE_BYTES``: what the driver holds is bounded.
    """
    start = F.substring(F.col(text_col).cast("binary"), 1, SAMPLE_BYTES)
    seen: Counter = Counter()
    for row in docs.select(start.alias("t")).where("t is not null").limit(sample_docs).collect():
        seen.update(c for c in bytes(row.t).split() if len(c) <= 64)
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]
    encode = chunk_ids(vocabulary_path(vocabulary), CACHED, None, "driver")
    known = [(c, encode[c]) for c, _ in best if c.isascii() or _is_text(c)]
    known = [(c, i) for c, i in known if len(i) // 4 <= 255]
    return FrequentTable([c for c, _ in known], [i for _, i in known])


def _is_text(chunk: bytes) -> bool:
    """Whole characters: a cut text may end within one."""
    try:
        chunk.decode()
    except UnicodeDecodeError:
        return False
    return True


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    frequent: int = FREQUENT,
    sample_docs: int = SAMPLE_DOCS,
    cached: int = CACHED,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A ``.json`` vocabulary is read by the ``tokenizers`` library, a ``.model`` one by
    ``sentencepiece``; no begin, end or other special token is added and nothing is truncated.
    Null text counts as empty (0 tokens); a null id stays null; repeated rows give repeated rows;
    an empty table gives an empty table; columns other than id and text are ignored.
    """
    rows = text_bytes(docs, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    if not vocabulary.endswith(".json"):
        return rows.mapInArrow(_piece_counter(vocabulary, limit), schema)
    spark = docs.sparkSession
    tier_one = spark.sparkContext.broadcast(frequent_table(docs, text_col, vocabulary, frequent, sample_docs))

    def count(batches):
        packed = tier_one.value
        ids = chunk_ids(vocabulary, cached, packed.unpack() if packed.blob else None, packed.key)
        for batch in batches:
            keys, texts = rows_of(batch)
            counts = [len(ids.text_ids(t)) // 4 for t in texts]
            yield _counted(keys, texts, counts, limit)

    return rows.mapInArrow(count, schema)


def _piece_counter(vocabulary: str, limit: int):
    def count(batches):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        for batch in batches:
            keys, texts = rows_of(batch)
            counts = [len(pieces.encode(t.decode("utf-8", "replace"))) for t in texts]
            yield _counted(keys, texts, counts, limit)

    return count


def _counted(keys, texts, counts, limit):
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(keys, pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
        }
    )
