"""Subword lattice likelihood.

An existing subword vocabulary gives the pieces and the first of their unigram weights.  The
weights are then replaced by expected counts over all segmentations of all distinct training
words.  Training words are edges of the lattice too, as whole-word pieces: their counts less an
absolute discount, whose mass goes to the paths of subword pieces.  A word's probability is the
sum over all paths, found by a forward recursion in log space; a text's is the product over its
words and an end.  Byte pieces make every text scorable.

Training documents may carry a class (their language).  Each class then has a model of its own that
leaves its discounted mass to the overall one, and a text's probability is the sum over classes; the
class of the scored text is not looked at.  Classes beyond the most frequent ones and null are one
class together.

Words are counted by partial counts per partition and one grouped sum.  For the word-level base
score, frequent words come from a broadcast table of bounded size and all others from a join.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_bytes
from .pretokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
#: Words whose counts are broadcast, at most (about 24 bytes each); the rest is joined.
FREQUENT_WORDS = 100_000
#: Longest word a frequent table holds, so that its size is bounded in bytes too.
FREQUENT_BYTES = 64
#: Distinct words a partition counts before it hands partial counts on.
PARTIAL = 300_000
ROUNDS = 1
SMOOTHING = 0.1
#: Classes with a model of their own, at most: the most frequent ones of the training documents.  All
#: others share one.  It bounds the width of the counts and matters only for columns of more values.
CLASSES = 64
#: Mark of a word's start, as the vocabulary writes it.
START = "▁".encode()
#: The end of a text, among words; it cannot be a word.
END_WORD = b""
#: Words of more bytes are worked off one by one, along the word instead of across words.
LONG = 512
#: Starts of a long word whose pieces are held at once.
STRETCH = 16_384
#: Texts that are taken out of a batch at once.
TOGETHER = 512
#: Bytes of text a task holds words of before it hands them on or starts anew.
HELD_BYTES = 64_000_000
_models: dict = {}


def is_held_out(doc_id) -> bool:
    """crc32 of the id as text leaves the held-out remainder; a null id never does."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


# ---------------------------------------------------------------- lattice


@dataclass
class Lattice:
    """Pieces (byte strings) in a transition table, with their natural-log weights."""

    step: np.ndarray  # (nodes, 256): next node, 0 for none; node 1 is the root
    weight: np.ndarray  # per node: log weight of the piece ending there, -inf if none
    piece: np.ndarray  # per node: index of that piece, -1 if none

    @classmethod
    def of(cls, pieces: list[bytes], log_weights: np.ndarray) -> "Lattice":
        children: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            node = 1
            for b in piece:
                following = children[node].get(b)
                if following is None:
                    following = children[node][b] = len(children)
                    children.append({})
                node = following
            ends[node] = i
        step = np.zeros((len(children), 256), np.int32 if len(children) > 65_535 else np.uint16)
        for node, out in enumerate(children):
            for b, following in out.items():
                step[node, b] = following
        weight, piece = np.full(len(children), -np.inf), np.full(len(children), -1, np.int32)
        for node, i in ends.items():
            weight[node], piece[node] = log_weights[i], i
        return cls(step, weight, piece)

    def reweighted(self, log_weights: np.ndarray) -> "Lattice":
        weight = np.where(self.piece >= 0, log_weights[np.maximum(self.piece, 0)], -np.inf)
        return Lattice(self.step, weight, self.piece)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability summed over all segmentations."""
        out = np.empty(len(words))
        for rows, chars in self._by_length(words):
            out[rows] = self._forward_long(chars[0])[-1] if chars.shape[1] > LONG else self._forward(chars)[:, -1]
        return out

    @staticmethod
    def _by_length(words: list[bytes], most: int = 20_000):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            each = 1 if n > LONG else max(1, min(most, 2_000_000 // (n + 1)))
            for at in range(0, len(same), each):
                rows = same[at : at + each]
                yield rows, np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), n)

    def _edges(self, chars: np.ndarray, start: int):
        """(end, rows, nodes) of the pieces that begin at ``start``, for rows still on a path."""
        rows = np.arange(len(chars))
        nodes = np.ones(len(chars), np.int64)
        for end in range(start + 1, chars.shape[1] + 1):
            nodes = self.step[nodes, chars[rows, end - 1]].astype(np.int64)
            on = nodes > 0
            if not on.all():
                rows, nodes = rows[on], nodes[on]
            if not len(rows):
                return
            complete = self.piece[nodes] >= 0
            if complete.any():
                yield end, rows[complete], nodes[complete]

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        words, n = chars.shape
        alpha = np.full((words, n + 1), -np.inf)
        alpha[:, 0] = 0.0
        for start in range(n):
            for end, rows, nodes in self._edges(chars, start):
                alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, start] + self.weight[nodes])
        return alpha

    def _arcs(self, chars: np.ndarray, low: int, high: int):
        """(starts, ends, nodes) of the pieces of one word that begin in [low, high), by start."""
        starts = np.arange(low, high)
        nodes = np.ones(high - low, np.int64)
        found = []
        for length in range(1, len(chars) - low + 1):
            inside = starts + length <= len(chars)
            starts, nodes = starts[inside], nodes[inside]
            nodes = self.step[nodes, chars[starts + length - 1]].astype(np.int64)
            on = nodes > 0
            starts, nodes = starts[on], nodes[on]
            if not len(starts):
                break
            complete = self.piece[nodes] >= 0
            found.append((starts[complete], starts[complete] + length, nodes[complete]))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        order = np.argsort(parts[0], kind="stable")
        return tuple(x[order] for x in parts)

    def _forward_long(self, chars: np.ndarray) -> np.ndarray:
        """The forward recursion of one word: linear in its bytes, with the pieces of a stretch at a time."""
        alpha = [-math.inf] * (len(chars) + 1)
        alpha[0] = 0.0
        for low in range(0, len(chars), STRETCH):
            starts, ends, nodes = self._arcs(chars, low, min(low + STRETCH, len(chars)))
            for start, end, weight in zip(starts.tolist(), ends.tolist(), self.weight[nodes].tolist()):
                alpha[end] = _log_add(alpha[end], alpha[start] + weight)
        return np.array(alpha)

    def _backward_long(self, chars: np.ndarray) -> np.ndarray:
        beta = [-math.inf] * (len(chars) + 1)
        beta[-1] = 0.0
        for low in range((len(chars) - 1) // STRETCH * STRETCH, -1, -STRETCH):
            starts, ends, nodes = self._arcs(chars, low, min(low + STRETCH, len(chars)))
            for start, end, weight in zip(starts[::-1].tolist(), ends[::-1].tolist(), self.weight[nodes[::-1]].tolist()):
                beta[start] = _log_add(beta[start], beta[end] + weight)
        return np.array(beta)

    def expected_counts(self, words: list[bytes], counts: np.ndarray, pieces: int) -> np.ndarray:
        """Expected uses of each piece over all segmentations, weighted by the words' counts.

        Uses are added up as the backward recursion passes them: no list of a word's pieces is held.
        """
        total = np.zeros(pieces)
        for which, chars in self._by_length(words):
            if chars.shape[1] > LONG:
                total += counts[which[0]] * self._expected_long(chars[0], pieces)
                continue
            alpha = self._forward(chars)
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = 0.0
            whole = alpha[:, -1]
            for start in range(chars.shape[1] - 1, -1, -1):
                for end, rows, nodes in self._edges(chars, start):
                    through = self.weight[nodes] + beta[rows, end]
                    beta[rows, start] = np.logaddexp(beta[rows, start], through)
                    share = np.exp(alpha[rows, start] + through - whole[rows]) * counts[which][rows]
                    np.add.at(total, self.piece[nodes], share)
        return total

    def _expected_long(self, chars: np.ndarray, pieces: int) -> np.ndarray:
        alpha, beta = self._forward_long(chars), self._backward_long(chars)
        total = np.zeros(pieces)
        for low in range(0, len(chars), STRETCH):
            starts, ends, nodes = self._arcs(chars, low, min(low + STRETCH, len(chars)))
            share = np.exp(alpha[starts] + self.weight[nodes] + beta[ends] - alpha[-1])
            total += np.bincount(self.piece[nodes], share, pieces)
        return total


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def vocabulary_pieces(vocabulary: str) -> tuple[list[bytes], np.ndarray]:
    """The distinct surfaces of a sentencepiece vocabulary with its own scores, and every byte.

    Control and unknown pieces stand for no text and are left out; a byte piece and a one-byte
    piece share a surface and are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        surface = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode()
        scores[surface] = max(scores.get(surface, -np.inf), model.get_score(i))
    for b in range(256):
        scores.setdefault(bytes([b]), min(scores.values()))
    surfaces = sorted(scores)
    return surfaces, np.array([scores[s] for s in surfaces])


# ---------------------------------------------------------------- training


def class_names(docs: DataFrame, id_col: str, class_col: str | None, most: int = CLASSES) -> tuple[list[str], bool]:
    """The most frequent classes of the training documents, none if there is no such column; whether others, null among them, remain."""
    if class_col is None or class_col not in docs.columns:
        return [], False
    crc = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))
    training = docs.where(~F.coalesce(crc == HELD_OUT, F.lit(False)))
    sizes = training.groupBy(F.col(class_col).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.col("name").isNull(), F.desc("n"), "name").limit(most + 1).collect()
    names = [r.name for r in first[:most] if r.name is not None]
    return names, len(first) > len(names)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, classes: tuple[str, ...] = (),
    rest: bool = False, partial: int = PARTIAL,
) -> DataFrame:
    """(word, c, c0, c1, ...) over all training documents: in all, by class and, if ``rest``, for all other classes.

    The end of a text counts once per document, as b''.
    """
    own = F.array_position(F.array(*[F.lit(n) for n in classes]), F.col(class_col).cast("string")) if classes else F.lit(0)

    def count(batches):
        seen: dict[int, Counter] = {}
        held = 0

        def batch():
            nonlocal held
            held = 0
            sizes = [len(found) for found in seen.values()]
            words = pa.array(itertools.chain.from_iterable(seen.values()), pa.binary(), size=sum(sizes))
            counts = np.fromiter(itertools.chain.from_iterable(found.values() for found in seen.values()), np.int64, sum(sizes))
            groups = pa.array(np.repeat(np.array(list(seen), np.int32), sizes), pa.int32())
            seen.clear()
            return pa.RecordBatch.from_arrays([words, groups, pa.array(counts)], ["word", "class", "c"])

        for rows in batches:
            for at in range(0, rows.num_rows, TOGETHER):
                part = rows.slice(at, TOGETHER)
                for key, text, group in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if not is_held_out(key):
                        counter = seen.setdefault((group or 0) - 1, Counter())
                        counter.update(text.lower().split())
                        counter[END_WORD] += 1
                        held += len(text)
                        if held > HELD_BYTES or sum(map(len, seen.values())) > partial:
                            yield batch()
        yield batch()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), own.cast("int").alias("class"))
    partials = texts.mapInArrow(count, "word binary, class int, c long")
    groups = [*range(len(classes)), *([-1] if rest else [])]
    by_class = [F.sum(F.when(F.col("class") == g, F.col("c")).otherwise(F.lit(0))).alias(f"c{i}") for i, g in enumerate(groups)]
    return partials.groupBy("word").agg(F.sum("c").alias("c"), *by_class)


@dataclass(frozen=True)
class PieceModel:
    """Natural-log weights of the vocabulary's surfaces; its size is bounded by the vocabulary."""

    vocabulary: str
    log_weights: np.ndarray

    def lattice(self) -> Lattice:
        key = (self.vocabulary, hash(self.log_weights.tobytes()))
        if key not in _models:
            _models.clear()
            _models[key] = Lattice.of(vocabulary_pieces(self.vocabulary)[0], self.log_weights)
        return _models[key]


def train_pieces(counts: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> PieceModel:
    """Unigram weights of the vocabulary's pieces from all distinct training words.

    The first weights come from the vocabulary's scores, read as ranks: the n-th best piece starts
    at a weight proportional to 1 / (n + 2).  Each round replaces the weights by the smoothed
    expected counts over all segmentations.  A word counts once, as the discount gives the paths
    the same mass for each.  Only one number per piece comes to the driver.
    """
    surfaces, scores = vocabulary_pieces(vocabulary)
    places = np.empty(len(scores))
    places[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    start = -np.log(places + 2.0)
    model = PieceModel(vocabulary, start - np.logaddexp.reduce(start))
    words = counts.where(F.col("word") != F.lit(END_WORD)).select("word")
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(model)

        def expect(batches):
            model = shared.value
            lattice, total = model.lattice(), np.zeros(len(model.log_weights))
            for batch in batches:
                found = batch.column("word").to_pylist()
                for at in range(0, len(found), 20_000):
                    part = [START + w for w in found[at : at + 20_000]]
                    total += lattice.expected_counts(part, np.ones(len(part)), len(total))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used])})

        found = words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = np.full(len(surfaces), smoothing)
        for row in found:
            used[row.piece] += row.n
        model = PieceModel(vocabulary, np.log(used / used.sum()))
        shared.unpersist()
    return model


def frequent_words(counts: DataFrame, most: int = FREQUENT_WORDS) -> dict[bytes, tuple[int, ...]]:
    """The counts of the most frequent words, at most ``most``: all whose count reaches a level found from a histogram."""
    short = counts.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("word") != F.lit(END_WORD)))
    level = F.floor(F.log2("c") * 8).cast("int")
    histogram = sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level)
    held, lowest = 0, None
    for row in histogram:
        if held + row.n > most:
            break
        held, lowest = held + row.n, row.level
    if lowest is None:
        return {}
    return {bytes(r[0]): tuple(r[1:]) for r in short.where(level >= lowest).collect()}


@dataclass(frozen=True)
class WordModel:
    """Discounted word counts of one population: size, discount, and the mass left to what it backs off to."""

    tokens: int
    discount: float
    spare: float

    @classmethod
    def of(cls, tokens: int, distinct: int, once: int, twice: int) -> "WordModel":
        discount = once / (once + 2 * twice) if once and twice else 0.5
        return cls(tokens, discount, discount * distinct / tokens if tokens else 1.0)

    def log_likelihood(self, counts: np.ndarray, backed_off: np.ndarray) -> np.ndarray:
        """Natural log of word probabilities from counts and the log probabilities backed off to."""
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - self.discount, 0.0) / max(self.tokens, 1))
        return np.logaddexp(whole, np.log(self.spare) + backed_off)

    def log10_column(self, count, backed_off):
        """The same, base 10, as a column; apart for unseen words, whose probability may be below a double's range."""
        whole = F.greatest(F.coalesce(count, F.lit(0)) - F.lit(float(self.discount)), F.lit(0.0)) / F.lit(float(max(self.tokens, 1)))
        left = F.lit(float(np.log10(self.spare))) + backed_off
        return F.when(whole > 0, F.log10(whole + F.pow(F.lit(10.0), left))).otherwise(left)


# ---------------------------------------------------------------- scoring


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = "lang",
    vocabulary: str = VOCABULARY,
    rounds: int = ROUNDS,
    smoothing: float = SMOOTHING,
    frequent: int = FREQUENT_WORDS,
    most_classes: int = CLASSES,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of the lower-cased words and an end: base_score by
    smoothed word counts, score by the lattice.  Null text counts as empty: only the end is scored.
    A null id is a training row.  Repeated rows count and are scored as often as they occur.  Null
    and classes beyond the most frequent ones are one class, whose prior is their share; a table without
    the class column has no classes.  An empty table gives no rows; without training rows every word
    is scored by the subword paths alone, with even smoothed weights.  Columns other than id, text
    and class are ignored.
    """
    spark = docs.sparkSession
    classes, rest = class_names(docs, id_col, class_col, most_classes)
    rest = rest and bool(classes)
    counts = materialize(word_counts(docs, id_col, text_col, class_col, tuple(classes), rest), "words")
    columns = ["c", *(f"c{i}" for i in range(len(classes) + rest))]

    def many(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    facts = counts.agg(
        *itertools.chain.from_iterable(
            (
                many(F.col(c) > 0, F.col(c)),
                many(F.col(c) > 0, F.lit(1)),
                many(F.col(c) == 1, F.lit(1)),
                many(F.col(c) == 2, F.lit(1)),
                many(F.col("word") == F.lit(END_WORD), F.col(c)),
            )
            for c in columns
        )
    ).first()
    found = [tuple(facts[5 * i : 5 * i + 5]) for i in range(len(columns))]
    overall, own = WordModel.of(*found[0][:4]), [WordModel.of(*f[:4]) for f in found[1:]]
    seen, distinct, ends = found[0][0], found[0][1], found[0][4]
    # Prior of a class: its share of the training documents; a plain model is one class with all counts.
    total_ends = sum(f[4] for f in found[1:])
    priors = [f[4] / total_ends for f in found[1:]] if own else [1.0]
    model = train_pieces(counts, vocabulary, rounds, smoothing)
    shared = spark.sparkContext.broadcast((model, frequent_words(counts.select("word", *columns), frequent)))
    floor = seen + 0.5 * (distinct + 1)

    def base(c):
        return np.log10((c + 0.5) / floor)

    def by_class(rows, paths):
        """log10 probabilities (words x classes) from counts (words x columns) and subword paths."""
        back = overall.log_likelihood(rows[:, 0], paths)
        parts = [m.log_likelihood(rows[:, i + 1], back) for i, m in enumerate(own)] or [back]
        return np.stack(parts, 1) / np.log(10)

    # The end has no subword path; without training rows it has even odds.
    end_row = np.array([[f[4] for f in found]], float)
    end_scores = by_class(end_row, np.array([np.log(0.5) if not ends else -np.inf]))[0]
    width = len(columns)

    def first_pass(batches):
        model, table = shared.value
        lattice = model.lattice()
        missing = (-1,) * width
        number = 0

        def start():
            return {}, [], np.empty((0, width)), np.empty(0), np.empty((0, len(priors)))

        places, lists, known, paths, likely = start()
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                keys, texts = rows_of(batch.slice(at, TOGETHER))
                if len(lists) > PARTIAL or held > HELD_BYTES:
                    places, lists, known, paths, likely = start()
                    held = 0
                documents = []
                for text in texts:
                    words = text.lower().split()
                    indices = np.empty(len(words), np.int64)
                    for i, w in enumerate(words):
                        place = places.get(w)
                        if place is None:
                            place = places[w] = len(lists)
                            lists.append(w)
                            held += len(w)
                        indices[i] = place
                    documents.append(indices)
                fresh = lists[len(known) :]
                if fresh:
                    rows = np.array([table.get(w, missing) for w in fresh], float).reshape(-1, width)
                    way = lattice.log_probability([START + w for w in fresh])
                    known, paths = np.concatenate([known, rows]), np.concatenate([paths, way])
                    likely = np.concatenate([likely, by_class(np.maximum(rows, 0), way)])
                out = []
                for key, indices in zip(keys, documents):
                    c = known[indices, 0]
                    hot = c >= 0
                    rare, times = np.unique(indices[~hot], return_counts=True)
                    basis = float(base(c[hot]).sum()) + float(base(ends))
                    totals = (likely[indices[hot]].sum(0) + end_scores).tolist()
                    header = (number, key, is_held_out(key), len(indices) + 1, int(hot.sum()) + (ends > 0), basis, totals)
                    out.append((header, [lists[i] for i in rare.tolist()], times, paths[rare] / np.log(10)))
                    number += 1
                yield _scored(out)

    schema = (
        "number long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_score double, "
        "hot_likely array<double>, words array<binary>, times array<long>, paths array<double>"
    )
    passed = text_bytes(docs, id_col, text_col).mapInArrow(first_pass, schema)
    row = F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("number")
    # One stream of rows: a document's header under a key that no word has (words hold no space),
    # which spreads the headers, and one row per rare word.
    carried = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "hot_known": "long", "hot_score": "double", "hot_likely": "array<double>"}
    key = F.concat(F.lit(b" "), row.cast("string").cast("binary"))
    header = F.struct(key.alias("word"), F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("paths"), *carried)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in carried.items()]
    rare = F.transform(
        F.arrays_zip("words", "times", "paths"),
        lambda x: F.struct(x["words"].alias("word"), x["times"].alias("times"), x["paths"].alias("paths"), *nothing),
    )
    counted = passed.select(row.alias("row"), F.inline(F.concat(F.array(header), rare))).join(counts, "word", "left")
    back = overall.log10_column(F.col("c"), F.col("paths"))
    parts = [m.log10_column(F.col(f"c{i}"), back) for i, m in enumerate(own)] or [back]
    known = F.coalesce("c", F.lit(0))
    summed = counted.groupBy("row").agg(
        *[F.max(n).alias(n) for n in carried],
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("rare_known"),
        F.sum(F.col("times") * F.log10((known + 0.5) / F.lit(float(floor)))).alias("rare_base"),
        *[F.sum(F.col("times") * part).alias(f"l{i}") for i, part in enumerate(parts)],
    )
    # The sum over classes in log space: the best class is taken out first.
    weighed = F.array(*[F.lit(float(np.log10(p))) + F.element_at("hot_likely", i + 1) + F.col(f"l{i}") for i, p in enumerate(priors)])
    best = F.array_max("_w")
    mixed = best + F.log10(F.aggregate(F.col("_w"), F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - F.array_max(F.col("_w")))))
    return summed.withColumn("_w", weighed).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.col("rare_known")).alias("n_known"),
        F.lit(seen).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.col("rare_base")).alias("base_score"),
        mixed.alias("score"),
    )


def _scored(out) -> pa.RecordBatch:
    """Documents' headers with lists of their rare words, as often as each occurs, and its subword paths (log10)."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(o[1]) for o in out])]), pa.int32())
    words = pa.ListArray.from_arrays(offsets, pa.array([w for o in out for w in o[1]], pa.binary()))
    times = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([o[2] for o in out]), pa.int64()))
    paths = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([o[3] for o in out]), pa.float64()))
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
    names = ["number", "doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "hot_likely"]
    columns = [pa.array([o[0][i] for o in out], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*columns, words, times, paths], [*names, "words", "times", "paths"])
