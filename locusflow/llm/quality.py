"""Quality classifier by co-training.

Two views of a document never see each other's input: the text view reads the content, the
metadata view language, source and length.  Each is a logistic model fitted on labelled rows;
over some rounds each view labels the unlabelled rows it is sure about for the other view to
learn from.  Both views are calibrated on labelled rows kept aside and combined there.

Fitting uses bounded samples (``LABELLED`` labelled and ``POOL`` unlabelled rows, drawn by a hash
of the id).  Scoring covers every document and its whole text, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 8_000
POOL = 8_000
ROUNDS = 3
#: Calibrated probability from which a view passes a pseudo-label on.
SURE = 0.97
#: Pseudo-labels of a class a view passes on in a round, at most.
EXCHANGED = 500
#: Part of the labelled rows kept aside for calibration.
ASIDE = 4
KEEP = 0.5
SEED = 23
#: Rows that a fit holds in double precision at once.
BLOCK = 512

# ---------------------------------------------------------------- views

_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _SIGN, _HIGH = range(8)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _SIGN, np.int64)
    table[97:123], table[65:91], table[48:58], table[128:] = _LETTER, _UPPER, _DIGIT, _HIGH
    table[[32, 9]], table[[10, 13]], table[[ord(c) for c in ".,;:'\"()-"]] = _SPACE, _LINE, _POINT
    return table


_CLASSES = _byte_classes()
#: Printable ASCII one by one, all other bytes in eight groups.
_BINS = np.where((np.arange(256) >= 32) & (np.arange(256) < 127), np.arange(256) - 32, 95 + (np.arange(256) >> 5)).astype(np.int64)
#: Buckets that lower-cased words are hashed to.
WORD_BUCKETS = 256
TEXT_WIDTH = 103 + 64 + 9 + WORD_BUCKETS
META_WIDTH = 16 + 64 + 12 + 4


def text_features(text: bytes) -> np.ndarray:
    """Frequencies of bytes, byte-class pairs and hashed words, and a few shape measures, of the whole text."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    if not text:
        out[175] = 1
        return out
    values = np.frombuffer(text, np.uint8)
    out[:103] = np.sqrt(np.bincount(_BINS[values], minlength=103) / len(values))
    classes = _CLASSES[values]
    pairs = np.bincount(classes[:-1] * 8 + classes[1:], minlength=64)
    out[103:167] = np.sqrt(pairs / max(1, len(values) - 1))
    words, lines = text.split(), text.split(b"\n")
    starts = np.bincount(classes, minlength=8)
    out[167:176] = (
        np.log1p(len(text)) / 10,
        np.log1p(len(words)) / 10,
        (len(text) - starts[_SPACE] - starts[_LINE]) / (10 * max(1, len(words))),
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        starts[_UPPER] / max(1, starts[_UPPER] + starts[_LETTER]),
        len(zlib.compress(text, 1)) / (len(text) + 20),
        len(words) <= 5,
        0,
    )
    if words:
        found = Counter(text.lower().split())
        places = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in found), np.int64, len(found))
        uses = np.fromiter(found.values(), np.float64, len(found))
        out[176:] = np.sqrt(np.bincount(places, uses, WORD_BUCKETS) / len(words))
    return out


def _hashed(name: str, value, width: int) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % width


def metadata_features(lang, source, n_chars) -> np.ndarray:
    """Hashed language and source, and the length as level and curve; nulls have marks of their own."""
    out = np.zeros(META_WIDTH, np.float32)
    if lang is None:
        out[92] = 1
    else:
        out[_hashed("lang", lang, 16)] = 1
    if source is None:
        out[93] = 1
    else:
        out[16 + _hashed("source", source, 64)] = 1
    if n_chars is None or n_chars < 0:
        out[94] = 1
    else:
        size = np.log2(1.0 + n_chars)
        out[80 + min(11, int(size / 1.5))] = 1
        out[95] = size / 20
    return out


# ---------------------------------------------------------------- models


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    width = x.shape[1] + 1
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(width)
    for _ in range(steps):
        slope, curve = -penalty * beta, np.diag(penalty)
        for at in range(0, len(x), BLOCK):
            rows = slice(at, at + BLOCK)
            design = _with_intercept(x[rows])
            p = _sigmoid(design @ beta)
            slope += design.T @ (weight[rows] * (y[rows] - p))
            curve += (design * (weight[rows] * p * (1 - p) + 1e-9)[:, None]).T @ design
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 8.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _with_intercept(x: np.ndarray) -> np.ndarray:
    out = np.ones((x.shape[0], x.shape[1] + 1))
    out[:, :-1] = x
    return out


def _margin(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        out[at : at + BLOCK] = x[at : at + BLOCK].astype(np.float64) @ beta[:-1] + beta[-1]
    return out


@dataclass(frozen=True)
class CoTrained:
    """Both views, their calibrations (slope, intercept) and the combination of their logits."""

    text: np.ndarray
    meta: np.ndarray
    text_calibration: np.ndarray
    meta_calibration: np.ndarray
    combination: np.ndarray

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        t = _margin(_margin(texts, self.text)[:, None], self.text_calibration)
        m = _margin(_margin(metas, self.meta)[:, None], self.meta_calibration)
        return _sigmoid(t), _sigmoid(m), _sigmoid(_margin(np.column_stack([t, m]), self.combination))


def co_train(
    texts: np.ndarray, metas: np.ndarray, labels: np.ndarray, aside: np.ndarray, pool_texts: np.ndarray, pool_metas: np.ndarray,
    rounds: int = ROUNDS, sure: float = SURE, exchanged: int = EXCHANGED, ridge: float = 1.0,
) -> CoTrained:
    """Fits both views on the rows not ``aside`` and lets them label the pool for each other."""
    views = (texts, metas)
    pools = (pool_texts, pool_metas)
    learn = ~aside
    extra: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0))] * 2
    fitted: list[np.ndarray] = []
    calibrated: list[np.ndarray] = []
    for turn in range(rounds + 1):
        fitted, calibrated = [], []
        for v in (0, 1):
            rows, pseudo = extra[v]
            x = np.concatenate([views[v][learn], pools[v][rows]])
            y = np.concatenate([labels[learn], pseudo])
            weight = np.concatenate([np.ones(int(learn.sum())), np.full(len(rows), 0.5)])
            beta = fit_logistic(x, y, weight, ridge)
            fitted.append(beta)
            calibrated.append(fit_logistic(_margin(views[v][aside], beta)[:, None], labels[aside], np.ones(int(aside.sum())), 0.1))
        if turn == rounds:
            break
        for v in (0, 1):  # what this view is sure about teaches the other one
            p = _sigmoid(_margin(_margin(pools[v], fitted[v])[:, None], calibrated[v]))
            order = np.argsort(p, kind="stable")
            low, high = order[:exchanged], order[::-1][:exchanged]
            low, high = low[p[low] <= 1 - sure], high[p[high] >= sure]
            rows, pseudo = extra[1 - v]
            fresh = np.concatenate([low, high]).astype(int)
            marks = np.concatenate([np.zeros(len(low)), np.ones(len(high))])
            new = ~np.isin(fresh, rows)
            extra[1 - v] = (np.concatenate([rows, fresh[new]]), np.concatenate([pseudo, marks[new]]))
    t = _margin(_margin(texts[aside], fitted[0])[:, None], calibrated[0])
    m = _margin(_margin(metas[aside], fitted[1])[:, None], calibrated[1])
    both = fit_logistic(np.column_stack([t, m]), labels[aside], np.ones(int(aside.sum())), 0.1)
    return CoTrained(fitted[0], fitted[1], calibrated[0], calibrated[1], both)


# ---------------------------------------------------------------- operators


@dataclass(frozen=True)
class Columns:
    id: str = "doc_id"
    text: str = "text"
    lang: str = "lang"
    source: str = "source"
    n_chars: str = "n_chars"


def _views(docs: DataFrame, c: Columns) -> list:
    """Both views' columns; a metadata column the table does not have counts as null."""

    def metadata(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").cast(kind) if name in docs.columns else F.lit(None).cast(kind)

    return [
        F.col(f"`{c.id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{c.text}`").cast("binary"), F.lit(b"")).alias("text"),
        metadata(c.lang, "string").alias("lang"),
        metadata(c.source, "string").alias("source"),
        metadata(c.n_chars, "double").alias("n_chars"),
    ]


def _feature_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = np.array([text_features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, TEXT_WIDTH)
    lists = (batch.column(n).to_pylist() for n in ("lang", "source", "n_chars"))
    metas = np.array([metadata_features(*m) for m in zip(*lists)], np.float32).reshape(-1, META_WIDTH)
    return texts, metas


def _features(batches):
    for batch in batches:
        texts, metas = _feature_rows(batch)
        columns = [batch.column("doc_id"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (texts, metas))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "m"])


def drawn_ids(docs: DataFrame, labels: DataFrame, columns: Columns, label_col: str, labelled: int, pool: int, seed: int) -> tuple[dict[int, int], list[int]]:
    """Labels of at most ``labelled`` ids that ``docs`` holds, and at most ``pool`` ids without a label, both by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = docs.select(F.col(f"`{columns.id}`").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    draw = F.xxhash64("doc_id", F.lit(seed))
    matched = ids.join(known, "doc_id", "left").withColumn("unknown", F.col("y").isNull())
    first = matched.where("not unknown").orderBy(draw, "doc_id").limit(labelled)
    others = matched.where("unknown").orderBy(draw, "doc_id").limit(pool)
    rows = first.unionByName(others).select("doc_id", "y").collect()
    return {r.doc_id: r.y for r in rows if r.y is not None}, [r.doc_id for r in rows if r.y is None]


def fit(
    docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), label_col: str = "quality",
    labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, seed: int = SEED,
) -> CoTrained | None:
    """Co-trains on bounded samples; None if the labelled rows found do not hold both classes.

    Of repeated labels of an id the least counts; null ids and labels are ignored.  Of rows that
    repeat an id the one of least features (as bytes) is learnt from, so reruns agree.
    """
    spark = docs.sparkSession
    marked, others = drawn_ids(docs, labels, columns, label_col, labelled, pool, seed)
    wanted = spark.createDataFrame([(i,) for i in sorted({*marked, *others})], "doc_id long")
    # At most labelled + pool ids, so the broadcast is bounded by the parameters, and so is what
    # comes back: one row per id.
    rows = docs.select(*_views(docs, columns)).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(_features, "doc_id long, t binary, m binary")
    least = rows.groupBy("doc_id").agg(F.min(F.struct("t", "m")).alias("x"))
    features = least.select("doc_id", "x.t", "x.m").toArrow()  # as Arrow: no object per row and field
    found = {i: at for at, i in enumerate(features.column("doc_id").to_pylist())}
    taught = sorted(i for i in marked if i in found)
    y = np.array([float(marked[i] > 0) for i in taught])
    # The rows aside follow a hash of the id, so that they are alike in every run.
    aside = np.array([zlib.crc32(f"{seed}:{i}".encode()) % ASIDE == 0 for i in taught], bool)
    if len(taught) < 8 or len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return None

    def stacked(keys, name, width):
        out = np.empty((len(keys), width), np.float32)
        column = features.column(name).combine_chunks()
        for at, k in enumerate(keys):
            out[at] = np.frombuffer(column[found[k]].as_buffer(), np.float32)
        return out

    spare = sorted(i for i in others if i in found)
    return co_train(
        stacked(taught, "t", TEXT_WIDTH), stacked(taught, "m", META_WIDTH), y, aside,
        stacked(spare, "t", TEXT_WIDTH), stacked(spare, "m", META_WIDTH), rounds,
    )


def classify(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), label_col: str = "quality", keep: float = KEEP, **fitting) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, quality_score, keep.

    Scores are calibrated probabilities of good quality; a document is kept from ``keep`` on.  Null
    text counts as empty; null metadata have features of their own, and a metadata column that is
    missing counts as null; null ids stay null; repeated rows stay.  Without labelled rows of both classes there is nothing to judge by: scores are null
    and every document is kept.  An empty table gives no rows.  Other columns are ignored.
    """
    model = fit(docs, labels, columns, label_col, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                yield _scored(part, shared.value, keep)

    schema = "doc_id long, text_score double, meta_score double, quality_score double, keep boolean"
    return docs.select(*_views(docs, columns)).mapInArrow(score, schema)


def _scored(part: pa.RecordBatch, model: CoTrained | None, keep: float) -> pa.RecordBatch:
    if model is None:
        scores = [pa.nulls(part.num_rows, pa.float64())] * 3
        kept = np.ones(part.num_rows, bool)
    else:
        found = model.scores(*_feature_rows(part))
        scores, kept = [pa.array(s) for s in found], found[2] >= keep
    names = ["doc_id", "text_score", "meta_score", "quality_score", "keep"]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *scores, pa.array(kept)], names)


def accepted(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), label_col: str = "quality", keep: float = KEEP, **fitting) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`classify` keeps; rows pass through, nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, columns, label_col, **fitting))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(*_views(docs, columns)).alias("view"),
    )

    def choose(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                view = pa.RecordBatch.from_struct_array(part.column("view"))
                mask = _scored(view, shared.value, keep).column("keep")
                yield pa.RecordBatch.from_struct_array(part.column("row").filter(mask))

    return packed.mapInArrow(choose, docs.schema)

