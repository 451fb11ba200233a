"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

1. Equal vectors become one class with the few smallest ids, by partial lists per partition, so a
   vector that fills a third of the table is one indexed row.
2. Trees are fitted on a bounded sample: a node splits at the median of a random projection.
3. Every class is dropped down every tree; its leaf gets a copy of its vector.
4. A query walks all trees through one queue ordered by how far it lies from the splits taken
   against it (squared margins, summed along the path), until that passes its search radius.
5. Within a leaf the query is scored against all of the leaf's vectors in double precision and
   the best few go on; the best of all leaves are the result.

Leaves of many rows are worked off in blocks, so no task holds an unbounded leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES = 8
#: Vectors the trees are fitted on, at most.
SAMPLE = 20_000
#: Indexed rows of a leaf, about.
LEAF = 200
#: Sampled vectors a query's radius is estimated from, at most: the squared distance to the last of its
#: nearest ones among them is never less than to those of the whole table.
REFERENCE = 8_000
#: A query's search ends at leaves whose summed squared margins pass this part, for each level of a
#: tree, of the squared radius' share of one dimension.  It is the same for every table size: vectors
#: that cluster end early, vectors without structure are searched far, because their neighbours are
#: hardly nearer than other rows.
REACH = 0.06
NEAREST = 5
BLOCK = 4_096
SEED = 11


# ---------------------------------------------------------------- forest


@dataclass
class Forest:
    """All trees in flat arrays: an inner node has a direction, an offset and two children.

    Leaves are numbered across trees.  ``children`` holds node numbers, or -1 - leaf.
    """

    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int

    def leaf_of(self, vectors: np.ndarray, root: int) -> np.ndarray:
        at = np.full(len(vectors), root)
        while (inner := np.flatnonzero(at >= 0)).size:
            nodes = at[inner]
            margin = np.einsum("ij,ij->i", vectors[inner], self.directions[nodes]) - self.offsets[nodes]
            at[inner] = self.children[nodes, (margin > 0).astype(int)]
        return -1 - at

    def probe(self, vector: np.ndarray, filled: np.ndarray, reach: float) -> list[int]:
        """Leaves within ``reach`` of a query, nearest first, through one queue over all trees."""
        queue = [(0.0, i, root) for i, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found, tie = [], len(queue)
        while queue:
            distance, _, node = heapq.heappop(queue)
            if node < 0:
                if filled[-1 - node]:
                    found.append(-1 - node)
                continue
            margin = float(vector @ self.directions[node] - self.offsets[node])
            for side, away in ((0, margin), (1, -margin)):
                passed = distance + max(0.0, away) ** 2
                if passed <= reach:
                    heapq.heappush(queue, (passed, tie, int(self.children[node, side])))
                    tie += 1
        return found

    def levels(self) -> float:
        """Splits above a leaf, on average, if all leaves lay at one depth."""
        return float(np.log2(max(2.0, self.leaves / len(self.roots))))


def fit_forest(sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """Trees over unit vectors; a leaf holds at most ``leaf`` sampled rows (equal projections aside)."""
    draw = np.random.default_rng(seed)
    directions, offsets, children, roots, leaves = [], [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            a, b = draw.choice(len(rows), 2, replace=False)
            for direction in (sample[rows[a]] - sample[rows[b]], draw.standard_normal(sample.shape[1])):
                length = np.linalg.norm(direction)
                if length == 0:
                    continue
                along = sample[rows] @ (direction / length)
                middle = float(np.median(along))
                right = along > middle
                if right.any() and not right.all():
                    node = len(directions)
                    directions.append(direction / length)
                    offsets.append(middle)
                    children.append([0, 0])
                    children[node] = [grow(rows[~right]), grow(rows[right])]
                    return node
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    dim = sample.shape[1]
    return Forest(np.array(directions).reshape(-1, dim), np.array(offsets), np.array(children, int).reshape(-1, 2), roots, leaves)


# ---------------------------------------------------------------- stages


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows that take part; v is array<float> if the table has floats, else array<double>.

    Left out: null ids, null, empty or zero vectors, vectors with null or non-finite components,
    and vectors whose length is not the most common one (ties: the greater length).
    """
    kept = vectors.schema[vector_col].dataType.elementType.typeName()
    v = F.col(vector_col) if kept == "float" else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths.d if lengths else -1))


def classes_of(rows: DataFrame, ids: int) -> DataFrame:
    """(class_id, ids, v) of distinct vectors: the ``ids`` smallest distinct ids of each, class_id the first.

    ``v`` holds the components' bytes, floats as floats and all else as doubles.
    -0.0 and 0.0 are one value.  Lists are cut to length per partition and again when merged, so a
    hot vector costs a few numbers per partition.
    """

    def cut(batches):
        seen: dict[bytes, set[int]] = {}

        def batch():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([sorted(held)[:ids] for held in seen.values()], pa.list_(pa.int64()))], ["v", "ids"]
            )
            seen.clear()
            return out

        for rows in batches:
            if not rows.num_rows:
                continue
            values = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) + 0.0
            for key, vector in zip(rows.column(0).to_pylist(), values):
                held = seen.setdefault(vector.tobytes(), set())
                held.add(key)
                if len(held) > 4 * ids:
                    seen[vector.tobytes()] = set(sorted(held)[:ids])
            if len(seen) > 50_000:
                yield batch()
        yield batch()

    partial = rows.select("vec_id", "v").mapInArrow(cut, "v binary, ids array<long>")
    merged = partial.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids"))
    return merged.select(F.element_at("ids", 1).alias("class_id"), "ids", "v")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def squared_radius(units: np.ndarray, reference: np.ndarray, nearest: int) -> np.ndarray:
    """Squared distance of each unit vector to the last of its ``nearest`` reference vectors, itself left out."""
    if len(reference) <= nearest:
        return np.full(len(units), 4.0)
    cosines = units @ reference.T
    cosines[cosines > 1 - 1e-12] = -1.0
    return np.maximum(0.0, 2.0 - 2.0 * np.partition(cosines, -nearest, axis=1)[:, -nearest])


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries: str = "vec_id % 50 = 0",
    nearest: int = NEAREST,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    reach: float = REACH,
    reference: int = REFERENCE,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows found, by cosine, itself left out.

    Ties go to the smaller vec_id; if there are fewer candidates, all found are returned.  Rows
    with null, zero or non-finite vectors and null ids take no part.  Rows that repeat an id with
    equal vectors are one row, as query and as candidate; with different vectors the id may appear
    once for each.  An empty table gives no rows.  Columns other than id and vector are ignored.
    ``reach`` trades cost for recall: a great number searches every leaf and is exact.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    kind = "f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "f8"
    classes = materialize(classes_of(rows, nearest + 1), "classes")
    total = classes.count()
    share = min(1.0, sample / max(1, total))
    # The sample is bounded by the draw and, against an unlucky one, by a limit.
    drawn = classes.where(F.pmod(F.xxhash64("class_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * sample)
    held = sorted((r.class_id, bytes(r.v)) for r in drawn.select("class_id", "v").collect())
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    if not held:
        held = [(r.class_id, bytes(r.v)) for r in classes.limit(sample).collect()]
    units = _unit(np.array([np.frombuffer(v, kind) for _, v in held], np.float64))
    forest = fit_forest(units, trees, max(2, int(leaf * len(units) / total)), seed)
    near_sample = np.ascontiguousarray(units[:: max(1, -(-len(units) // reference))])
    shared = spark.sparkContext.broadcast((forest, near_sample))

    def drop(batches):
        forest = shared.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                unit = _unit(_matrix(part.column("v"), kind))
                for root in forest.roots:
                    leaves = forest.leaf_of(unit, root)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaves, pa.int32()), part.column("class_id"), part.column("v")], ["leaf", "class_id", "v"]
                    )

    # Placing is cheap and sure to give the same again, so only the leaves' sizes are gathered here:
    # one number a leaf, and leaves are bounded by the sample.
    placed = classes.select("class_id", "v").mapInArrow(drop, "leaf int, class_id long, v binary")
    sizes = np.zeros(forest.leaves, np.int64)
    for r in classes.select("class_id", "v").mapInArrow(_leaf_sizes(shared, kind), "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r.leaf] = r.n
    blocks = max(1, -(-int(sizes.max()) // block))
    shared_sizes = spark.sparkContext.broadcast(sizes > 0)

    # A query's class is found by its vector; the class is searched once for all queries in it.
    keyed = rows.where(F.expr(queries)).select(F.col("vec_id").alias("query_id"), "v").mapInArrow(_as_bytes, "query_id long, v binary")
    asking = keyed.distinct().join(classes.select("class_id", "v"), "v").select("query_id", "class_id")
    asking = materialize(asking, "queries")
    asked = classes.join(asking.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "v")

    def walk(batches):
        (forest, near_sample), filled = shared.value, shared_sizes.value
        scale = reach * forest.levels() / near_sample.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                units = _unit(_matrix(part.column(1), kind))
                limits = scale * squared_radius(units, near_sample, nearest)
                leaves = [forest.probe(vector, filled, limit) for vector, limit in zip(units, limits)]
                counts = [len(found) for found in leaves]
                which = pa.array(np.repeat(np.arange(len(leaves)), counts))
                columns = [pa.array(np.concatenate([*leaves, []]).astype(np.int32)), part.column(0).take(which), part.column(1).take(which)]
                out = pa.RecordBatch.from_arrays(columns, ["leaf", "class_id", "v"])
                for at in range(0, out.num_rows, 20_000):
                    yield out.slice(at, 20_000)

    probes = asked.mapInArrow(walk, "leaf int, class_id long, v binary")
    own_block = F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")
    members = placed.select("leaf", own_block.alias("block"), F.lit(False).alias("asks"), "class_id", "v")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    askers = probes.select("leaf", all_blocks.alias("block"), F.lit(True).alias("asks"), "class_id", "v")
    together = members.unionByName(askers).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")
    found = together.mapInArrow(_rerank(nearest + 1, kind), "class_id long, near long, score double")
    found = found.dropDuplicates(["class_id", "near"])
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "near")
    few = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= nearest + 1)
    named = few.join(classes.select(F.col("class_id").alias("near"), "ids"), "near")
    named = named.select("class_id", "score", F.explode("ids").alias("vec_id"))
    # Equal vectors share a score; the ids in order of score and id, one more than asked for.
    by_class = Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    lists = (
        named.withColumn("i", F.row_number().over(by_class)).where(F.col("i") <= nearest + 1)
        .groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id", "score"))).alias("near"))
    )
    answered = asking.join(lists, "class_id")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    out = answered.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _leaf_sizes(shared, kind: str):
    def count(batches):
        forest = shared.value[0]
        sizes = np.zeros(forest.leaves, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                unit = _unit(_matrix(batch.slice(at, 2_048).column("v"), kind))
                for root in forest.roots:
                    sizes += np.bincount(forest.leaf_of(unit, root), minlength=forest.leaves)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sizes[used])], ["leaf", "n"])

    return count


def _as_bytes(batches):
    for rows in batches:
        if rows.num_rows:
            values = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) + 0.0
            packed = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), packed], ["query_id", "v"])


def _rerank(most: int, kind: str, held_queries: int = 50_000, together: int = 256):
    """Scores the queries of each (leaf, block), which follow its members, against those members.

    A matrix product of ``together`` queries finds the members that may be among the best; these are
    scored one by one in double precision, always by the same sum, so a pair's score does not depend on
    the leaf it is met in.  The best few of a query are kept over the leaves of a partition and given
    out at its end, or when ``held_queries`` are held.
    """

    def score(batches):
        at, members, vectors, matrix = None, [], [], None
        keys = lengths = units = None
        asking: list[tuple[int, bytes]] = []
        best: dict[int, dict[int, float]] = {}

        def batch():
            out = [(key, near, value) for key, found in best.items() for near, value in found.items()]
            best.clear()
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["class_id", "near", "score"])

        def answer():
            if not asking:
                return
            queries = np.frombuffer(b"".join(raw for _, raw in asking), kind).reshape(len(asking), -1).astype(np.float64)
            about = _unit(queries) @ units.T
            for row, (key, _) in enumerate(asking):
                if about.shape[1] > most:  # rounding of the product is far below the slack
                    some = np.flatnonzero(about[row] >= np.partition(about[row], -most)[-most] - 1e-9)
                else:
                    some = np.arange(about.shape[1])
                query = queries[row]
                scores = np.einsum("ij,j->i", matrix[some], query) / (np.sqrt(np.einsum("j,j->", query, query)) * lengths[some])
                found = best.setdefault(key, {})
                found.update(zip(keys[some].tolist(), scores.tolist()))
                if len(found) > most:
                    best[key] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
            asking.clear()

        for rows in batches:
            for leaf, part, asks, key, raw in zip(*(rows.column(i).to_pylist() for i in range(5))):
                if (leaf, part) != at:
                    answer()
                    at, members, vectors, matrix = (leaf, part), [], [], None
                if not asks:
                    members.append(key)
                    vectors.append(raw)
                    continue
                if not members:
                    continue
                if matrix is None:
                    matrix = np.frombuffer(b"".join(vectors), kind).reshape(len(members), -1).astype(np.float64)
                    keys, units = np.array(members), _unit(matrix)
                    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
                asking.append((key, raw))
                if len(asking) == together:
                    answer()
            if len(best) > held_queries:
                answer()
                yield batch()
        answer()
        yield batch()

    return score
