"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame expressions only.

Sizes are counted in words.  Each source is dealt into shards by a seeded hash; within a shard
the documents, in a seeded order, form one stream that is cut into blocks of equal size.

1. Targets: sources share ``share`` times all words by weight, up to ``most`` times their size
   (water filling in closed form: sources sorted by the level at which they fill up).
2. Blocks go to sources, and a source's blocks to its shards, by the highest quotients
   target / (2k + 1).  The counts near a claim's rounded share are the only ones in doubt, so
   just these quotients are listed and ranked.
3. A shard of n blocks with quota q gives every block q div n times and, from a seeded starting
   block on, q mod n consecutive blocks once more: documents stay whole but for the two ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dealt_in_order, materialize, running_sums

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block: the unit of apportionment, so a source's error is about this small.
BLOCK = 16
#: Documents of a shard, about.  The number of shards follows from the table.
SHARD_DOCS = 4_000
#: Blocks of a shard, about, at least: the partly filled last block of a shard counts as a whole one, which
#: misses a source's target by half a block a shard.
SHARD_BLOCKS = 256
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> plus weight and target; one row per source.

    Sources by code point, null last, take the weights in turn.  A source whose target would pass
    ``most`` times its size stops there and the rest is shared by weight among the others.  Sources
    may be many (hosts): places and running sums are found part by part.
    """
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size")).first()
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    named = running_sums(dealt_in_order(sizes, by_name, whole.n, "named"), by_name, {"_turn": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))
    weighed = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("_turn")
    filling = [F.col("cap") / F.col("weight"), *by_name]
    summed = running_sums(dealt_in_order(weighed, filling, whole.n, "filling"), filling, {"_full": F.col("cap"), "_used": F.col("weight")})
    rounds, rest = divmod(whole.n, len(weights))
    everything = float(rounds * sum(weights) + sum(weights[:rest]))
    # The level at which the sources from this one on would stand, were all before it full.
    level = (F.lit(share * (whole.size or 0)) - F.col("_full")) / (F.lit(everything) - F.col("_used"))
    opened = summed.withColumn("_level", level).where(F.col("_level") * F.col("weight") <= F.col("cap"))
    first = opened.agg(F.min(F.struct(filling[0].alias("ratio"), "_level")).alias("x")).first().x
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["_level"]) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def apportion(claims: DataFrame, group: list[str], seats: str, claim: str, limit: str, out: str, order: list[str]) -> DataFrame:
    """Adds ``out``: how many of the group's ``seats`` each row gets by the highest quotients.

    Quotients are claim / (2k + 1) for the (k+1)-th seat, k < ``limit``; ties go by ``order``, a key
    of the rows.  A share rounded at the common divisor differs from the result by at most the
    rounding errors of all rows, spread by claim; only seats within that margin are listed as rows
    and ranked, part by part.
    """

    def with_totals(rows: DataFrame, **sums: Column) -> DataFrame:
        totals = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(*[v.alias(n) for n, v in sums.items()])
        if not group:
            found = totals.first()
            return rows.select("*", *[F.lit(found[n]).alias(n) for n in sums])
        same = F.lit(True)
        for g in group:
            same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        return rows.join(totals, same).drop(*[f"_g_{g}" for g in group])

    near = with_totals(claims, _total=F.sum(claim), _rows=F.count(F.lit(1)))
    part = F.when(F.col("_total") > 0, F.col(claim) / F.col("_total")).otherwise(F.lit(0.0))
    near = near.withColumn("_part_of", part).withColumn("_fair", F.col("_part_of") * F.col(seats))
    near = near.withColumn("_margin", F.ceil(F.col("_part_of") * F.col("_rows")) + 2)
    near = near.withColumn("_sure", F.least(F.col(limit), F.greatest(F.lit(0), F.floor("_fair") - F.col("_margin"))).cast("long"))
    near = near.withColumn("_most", F.least(F.col(limit), (F.ceil("_fair") + F.col("_margin")).cast("long")))
    near = materialize(near, "claims")
    if group:
        listed = near.agg(F.sum(F.col("_most") - F.col("_sure")).alias("n")).first().n or 0
        near = with_totals(near, _held=F.sum("_sure"))
    else:
        sums = near.agg(F.sum(F.col("_most") - F.col("_sure")).alias("n"), F.sum("_sure").alias("held")).first()
        listed, near = sums.n or 0, near.withColumn("_held", F.lit(sums.held))
    seat = near.where(F.col("_most") > F.col("_sure")).select(
        *dict.fromkeys([*group, *order, claim]), (F.col(seats) - F.col("_held")).alias("_doubtful"),
        F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"),
    )
    ranking = [(F.col(claim) / (2 * F.col("_k") + 1)).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    dealt = dealt_in_order(seat, [*[F.col(g).asc_nulls_last() for g in group], *ranking], listed, "seats")
    placed = running_sums(dealt, ranking, {"_place": F.lit(1)}, tuple(group))
    won = placed.where(F.col("_place") < F.col("_doubtful")).groupBy(*[F.col(c).alias(f"_w_{c}") for c in order]).agg(F.count(F.lit(1)).alias("_won"))
    same = F.lit(True)
    for c in order:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return near.join(won, same, "left").select(*claims.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """doc_id, source, size and ``draw``, the seeded place of a document in its stream."""
    return [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    ]


def source_shards(sized: DataFrame, shard_docs: int, block: int) -> DataFrame:
    """(_of, shards), one row per source: as many as the table has of ``shard_docs`` documents, as far as the
    source's own words make shards of ``SHARD_BLOCKS`` blocks."""
    most = max(1, -(-sized.count() // shard_docs))
    own = F.floor(F.sum("size") / (SHARD_BLOCKS * block))
    shards = sized.groupBy(F.col("source").alias("_of")).agg(F.least(F.lit(most), F.greatest(F.lit(1), own)).cast("long").alias("shards"))
    # Written out so that its true size decides the join's form: documents are not shuffled for a few sources.
    return materialize(shards, "shards")


def shard_quotas(
    sized: DataFrame, shards: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int, seed: int
) -> DataFrame:
    """One row per source and shard: what is read of its stream.

    ``passes`` whole readings, then the words [begin, end) and, where that runs past the last
    block, [0, wrapped).
    """
    shard_sizes = materialize(_dealt(sized, shards, seed).groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "shard-sizes")
    sources = shard_sizes.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    seats = round(float(targets.agg(F.sum("target").alias("n")).first().n or 0) / block)
    claims = targets.withColumn("seats", F.lit(seats).cast("long"))
    claims = claims.withColumn("room", F.ceil(F.col("source_size") / block) * most)
    by_source = apportion(claims, [], "seats", "target", "room", "source_blocks", ["source"])
    joined = shard_sizes.join(
        by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    joined = joined.withColumn("blocks", F.ceil(F.col("shard_size") / block)).withColumn("shard_room", F.col("blocks") * most)
    joined = joined.select("source", "shard", "shard_size", "source_size", "target", "source_blocks", "blocks", "shard_room")
    quotas = apportion(joined, ["source"], "source_blocks", "shard_size", "shard_room", "quota", ["source", "shard"])

    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), F.greatest(F.col("blocks"), F.lit(1)))
    extra = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(F.lit(0))
    passes = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))
    return quotas.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "source_size",
        "target",
        passes.cast("long").alias("passes"),
        (start * block).alias("begin"),
        ((start + extra) * block).alias("end"),
        (F.greatest(F.lit(0), start + extra - F.col("blocks")) * block).alias("wrapped"),
    )


def _dealt(sized: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """Adds ``shard``, a document's place among the shards of its source."""
    joined = sized.join(shards, F.col("source").eqNullSafe(F.col("_of")))
    return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("draw")), F.col("shards"))).drop("_of", "shards")


def _stream_key(source: Column, shard: Column) -> Column:
    """One column that names a shard, null sources included."""
    return F.concat_ws(":", shard.cast("string"), source.cast("string"), F.when(source.isNull(), F.lit("null")).otherwise(F.lit("")))


def _spans(sized: DataFrame, quotas: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """Adds to each document what is read of it; other columns of ``sized`` pass through.

    The streams and the quotas share one key, so documents are shuffled once.
    """
    dealt = _dealt(sized, shards, seed).withColumn("_stream", _stream_key(F.col("source"), F.col("shard")))
    stream = Window.partitionBy("_stream").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    keyed = quotas.withColumn("_stream", _stream_key(F.col("_source"), F.col("_shard"))).drop("_source", "_shard")
    placed = placed.join(materialize(keyed, "quotas"), "_stream")

    def inside(value: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), value - F.col("at"))).cast("long")

    return placed.withColumns(
        {"first_from": inside(F.col("begin")), "first_to": inside(F.col("end")), "second_from": F.lit(0).cast("long"), "second_to": inside(F.col("wrapped"))}
    ).drop("shard", "at", "_stream", "begin", "end", "wrapped", "draw")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken and what is taken.

    ``passes`` counts whole readings of the text; the words [first_from, first_to) and
    [second_from, second_to) are read once more (empty where equal).  taken is their sum and at
    most ``most`` times size.  Null texts have size 0 and are never taken.  A null source is a
    source of its own, the last in order.  Null ids stay null; repeated rows are separate documents
    of equal rank, so they may be taken differently.  An empty table gives no rows.  Columns other
    than id, text and source are ignored.  Reruns on the same rows agree.
    """
    sized = materialize(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "sizes")
    shards = source_shards(sized, shard_docs, block)
    quotas = shard_quotas(sized, shards, weights, share, most, block, seed)
    taken = F.col("passes") * F.col("size") + (F.col("first_to") - F.col("first_from")) + F.col("second_to")
    return _spans(sized, quotas, shards, seed).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "first_from", "first_to", "second_from", "second_to"
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_col: str | None = "n_chars",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """The mixture itself: rows of ``docs``, all columns, as often as they are taken.

    A document read in part gives a row whose text is the words read, joined by spaces, and whose
    ``length_col`` is that text's length; whole readings keep the row as it is.  Documents that are
    not taken, those without words among them, give no row.  Otherwise as :func:`mix`.
    """
    names = docs.columns
    sized = materialize(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "sizes")
    shards = source_shards(sized, shard_docs, block)
    quotas = shard_quotas(sized, shards, weights, share, most, block, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    read = _spans(docs.select(*_sized(docs, id_col, text_col, source_col, seed), row), quotas, shards, seed)
    text, size = F.col("row")[text_col], F.col("size")

    def part(start: str, end: str) -> Column:
        words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
        n = F.col(end) - F.col(start)
        cut = F.array_join(F.slice(words, (F.col(start) + 1).cast("int"), n.cast("int")), " ")
        return F.when(n >= size, F.array(text)).when(n > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))

    whole = F.array_repeat(text, F.col("passes").cast("int"))
    readings = F.concat(whole, part("first_from", "first_to"), part("second_from", "second_to"))
    rows = read.where("size > 0").select("row", F.explode(readings).alias("_read"))
    same = F.col("_read") == text

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_read").alias(c)
        if c == length_col:
            kind = docs.schema[c].dataType
            return F.when(same, F.col("row")[c]).otherwise(F.length("_read").cast(kind)).alias(c)
        return F.col("row")[c].alias(c)

    return rows.select(*[column(c) for c in names])
