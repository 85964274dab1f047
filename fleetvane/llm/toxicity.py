"""Operator 6: toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel compares two words by their common subsequences of three characters. A subsequence that is stretched over
`span` characters, up to five, weighs DECAY ** span, so that up to two characters inserted between an insult's letters
only lower its likeness; runs of single characters ("i d i o t") are joined to words first. The kernel is normalised and
raised to a power. A sentence's kernel is the sum over its words, so a sentence's Nyström features are the sum of its
words' features, and the linear machine on them gives each word a share of the margin. That share is kept per word.

The machine is trained on labelled sentences: those of harmless documents are negative; of a toxic document, the sentences
that the machine itself rates toxic, the best one at least, are positive (three rounds). A logistic function of the
sentences' margins gives a document's score.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvane.llm.common import by_slices, held, texts_of

#: Bounds of the sample of labelled documents that the model is fit on: so many toxic and so many harmless ones.
SAMPLE_TOXIC, SAMPLE_HARMLESS = 1000, 2000
#: LANDMARKS, INSULT, POWER, LEAST_KERNEL and MOST_WEIGHT were chosen by four folds of the rows that aren't held out.
LANDMARKS, BACKGROUND = 128, 8
#: Least length of a word's beginning that may be a landmark; a word's value from which it counts as an insult.
LEAST_STEM, INSULT = 3, 1.5
DECAY, POWER, SPAN = 0.7, 6, 5
#: A word whose normalised kernel is below this with all landmarks has kernel zero with them. Landmarks that share a bound.
LEAST_KERNEL, GROUPED = 0.45, 8
THRESHOLD = 0.7
#: Times that a toxic document weighs a harmless one in the last step, at most.
MOST_WEIGHT = 6.0
#: Numbers that a document is judged by, a constant among them.
FEATURES = 9
MOST_WORDS = 600_000
SCORES = "doc_id long, held_out boolean, score double, predicted int"

_edges = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"
#: The two later characters of a subsequence, as offsets from its first.
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_WEIGHTS = np.array([DECAY ** (j + 1) for _, j in _OFFSETS], np.float32)


def words_of(text: str) -> list[str]:
    """Lower-case words with their punctuation; "." stands for the end of each line. Runs of three or more single letters or digits are added as joined words."""
    words = text.lower().replace("\n", " . ").split()
    one = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if len(words) > 2 and (one[:-2] & one[1:-1] & one[2:]).any():
        runs = ["".join(run) for single, run in groupby(words, lambda w: len(w) == 1 and w.isalnum()) if single]
        words += [run for run in runs if len(run) > 2]
    return words


def _mixed(codes: np.ndarray) -> np.ndarray:
    """20 bits of a hash of each code."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all weighted subsequences, (words, positions x offsets), 0 where there is none, and the words' norms."""
    width = max(max(map(len, words)), 3)
    points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)
    codes = np.zeros((len(words), width, len(_OFFSETS)), np.int64)
    for k, (i, j) in enumerate(_OFFSETS):
        if j < width:
            a, b, c = (x.astype(np.int64) for x in (points[:, :-j], points[:, i : i - j], points[:, j:]))
            codes[:, : width - j, k] = np.where(c > 0, (a << 42) | (b << 21) | c, 0)
    norms = np.sqrt((codes > 0).sum(axis=1) @ _WEIGHTS**2)
    return codes.reshape(len(words), -1), norms


class Landmarks:
    """Nyström landmarks: words whose kernel with any word is looked up by subsequence."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, norms = subsequences(words)
        weights = np.tile(_WEIGHTS, codes.shape[1] // len(_OFFSETS))
        row, at = np.nonzero(codes)
        self.found, index = np.unique(codes[row, at], return_inverse=True)
        self.table = np.zeros((len(self.found) + 1, len(words)), np.float32)
        np.add.at(self.table, (index + 1, row), weights[at] / np.maximum(norms[row], 1e-9))
        # Landmarks that are alike stand together, so that a group's largest weights bound each of its kernels closely.
        alike = self.table[:, sorted(range(len(words)), key=words.__getitem__)]
        self.groups = np.maximum.reduceat(alike, np.arange(0, len(words), GROUPED), axis=1)
        # Whole codes are told apart by search; a table of a few of their bits sorts out most of the unknown ones first.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_mixed(self.found)] = True

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table of the codes, 0 of unknown ones."""
        flat = codes.ravel()
        out = np.zeros(len(flat), np.int32)
        known = np.flatnonzero(self.maybe[_mixed(flat)])
        at = np.minimum(np.searchsorted(self.found, flat[known]), max(len(self.found) - 1, 0))
        if len(self.found):
            out[known] = np.where(self.found[at] == flat[known], at + 1, 0)
        return out.reshape(codes.shape)

    def _sums(self, table: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that have a known subsequence, and the weighted sums of their rows of the table."""
        row, col = np.nonzero(at)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros((0, table.shape[1]), np.float32)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        return row[first], np.add.reduceat(table[at[row, col]] * weight[col, None], first, axis=0)

    def kernel(self, words: list[str]) -> np.ndarray:
        """(words, landmarks). Words are taken in the order of their length, in blocks of bounded size."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            block = order[start : start + 6000]
            stop = start + max(1, int(((np.arange(len(block)) + 1) * sizes[block] <= 60_000).sum()))
            rows = order[start:stop]
            codes, norms = subsequences([words[i] for i in rows.tolist()])
            at, weight = self.place(codes), np.tile(_WEIGHTS, codes.shape[1] // len(_OFFSETS))
            near = self._sums(self.groups, at, weight)
            near = near[0][(near[1].max(axis=1, initial=0) >= LEAST_KERNEL * norms[near[0]])]
            first, sums = self._sums(self.table, at[near], weight)
            sums = sums / np.maximum(norms[near[first]], 1e-9)[:, None]
            out[rows[near[first]]] = np.where(sums.max(axis=1, keepdims=True, initial=0) >= LEAST_KERNEL, sums, 0) ** POWER
            start = stop
        return out


@dataclass
class Model:
    """landmarks and their weights give a word's share of its sentence's margin; document, the logistic function on features()."""

    landmarks: list[str]
    alpha: np.ndarray
    bias: float
    document: np.ndarray


def _chosen(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Landmarks: words and beginnings of words that occur in a larger share of toxic documents than of harmless ones, by how sure that is, and some common words.

    Of a family, where one begins the other, the surest is taken, and the longer of equals; then others of the families.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    whole: Counter = Counter()
    for text, label in zip(texts, toxic, strict=True):
        words = {w for w in (x.strip(_edges) for x in words_of(text)) if len(w) >= LEAST_STEM}
        whole.update(words)
        counts[int(label)].update(words.union(*({w[:n] for n in range(LEAST_STEM, min(len(w), 12))} for w in words)))
    n0, n1 = max(int((toxic == 0).sum()), 1), max(int((toxic == 1).sum()), 1)
    sure = {w: (c / n1 - counts[0][w] / n0) / np.sqrt((c + counts[0][w] + 1) / (n0 + n1)) for w, c in counts[1].items() if c >= (2 if n1 > 20 else 1)}
    ranked = sorted((w for w in sure if sure[w] > 0), key=lambda w: (-sure[w], -len(w), w))
    first: list[str] = []
    for w in ranked[: 50 * LANDMARKS]:
        if not any(w.startswith(x) or x.startswith(w) for x in first):
            first.append(w)
    room = LANDMARKS - BACKGROUND
    stems, taken = first[: room // 3], set(first[: room // 3])
    marks = stems + [w for w in ranked if w in whole and w not in taken][: room - len(stems)]
    common = [w for w, _ in sorted(whole.items(), key=lambda x: (-x[1], x[0])) if w not in set(marks)]
    return marks + common[:BACKGROUND]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of the linear machine with squared hinge loss, by Newton's method on the rows within the margin, in blocks of rows."""
    d = x.shape[1] + 1
    w, active = np.zeros(d), weight > 0
    for _ in range(rounds):
        gram, right = np.diag([*[1.0] * (d - 1), 1e-6]), np.zeros(d)
        for i in range(0, len(x), 20_000):
            at = active[i : i + 20_000]
            xb = np.hstack([x[i : i + 20_000][at], np.ones((int(at.sum()), 1), x.dtype)]).astype(np.float64)
            a = xb * (c * weight[i : i + 20_000][at])[:, None]
            gram += a.T @ xb
            right += a.T @ y[i : i + 20_000][at]
        w = np.linalg.solve(gram, right)
        now = (weight > 0) & (y * (x @ w[:-1] + w[-1]) < 1)
        if (now == active).all():
            break
        active = now
    return w


class Scorer:
    """Margins of words and documents; words' values are kept up to a number of words."""

    def __init__(self, model: Model):
        self.model, self.landmarks = model, Landmarks(model.landmarks)
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.value, self.ends = np.zeros(0), np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        if len(self.place) + len(words) > MOST_WORDS and self.place:
            self._empty()
        bare = [w.strip(_edges) for w in words]
        value = np.zeros(len(words))
        for i in range(0, len(words), 50_000):
            value[i : i + 50_000] = self.landmarks.kernel(bare[i : i + 50_000]) @ self.model.alpha
        self.place.update(zip(words, range(len(self.value), len(self.value) + len(words)), strict=True))
        self.value = np.concatenate([self.value, value])
        self.ends = np.concatenate([self.ends, np.fromiter((w[-1] in ".!?" for w in words), bool, len(words))])

    def features(self, texts: list[str]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        new = set().union(*lists)
        if len(new.difference(self.place)) + len(self.place) > MOST_WORDS:
            self._empty()
        if rest := list(new.difference(self.place)):
            self._learn(rest)
        for i, words in enumerate(lists):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                value, ends = self.value[at], self.ends[at]
                starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
                margins = np.add.reduceat(value, starts) + self.model.bias
                top = np.sort(value)[-3:][::-1]
                out[i, 1 : 1 + len(top)] = np.clip(top, 0, 3)
                out[i, 4] = np.log1p(np.maximum(margins, 0).sum())
                out[i, 5] = np.log1p((margins > 0).sum())
                out[i, 6] = np.log1p(np.maximum(value, 0).sum())
                out[i, 7] = np.log1p((value > INSULT).sum())
                out[i, 8] = np.log1p(100 * (value > INSULT).sum() / len(words))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.document, -500, 500)))


def _sums(share: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of share over the sentences between the bounds."""
    return np.add.reduceat(share[words[bounds[0] : bounds[-1]]], bounds[:-1] - bounds[0], axis=0)


@held
def _scorer(landmarks: tuple[str, ...], alpha: bytes, bias: float, document: bytes) -> Scorer:
    """One scorer for all tasks of a Python worker: what is known about words is kept."""
    return Scorer(Model(list(landmarks), np.frombuffer(alpha), bias, np.frombuffer(document)))


def scorer_of(model: Model | None) -> Scorer | None:
    return _scorer(tuple(model.landmarks), model.alpha.tobytes(), model.bias, model.document.tobytes()) if model else None


def fit(rows: list[tuple[str, int]], c: float = 1.0) -> Model | None:
    """The model from (text, label) rows; None without rows of both labels."""
    texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows], np.int64)
    if not toxic.any() or toxic.all():
        return None
    marks = Landmarks(_chosen(texts, toxic))
    own = marks.kernel(marks.words).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-3))
    place: dict[str, int] = {}
    flat, starts, of = array("q"), array("q"), array("q")
    for i, text in enumerate(texts):
        new = True
        for w in [*words_of(text), "."]:
            if new:
                starts.append(len(flat))
                of.append(i)
            flat.append(place.setdefault(w, len(place)))
            new = w[-1] in ".!?"
    known = [w.strip(_edges) for w in place]
    # Most words have no kernel with any landmark; they share the first row, of zeros.
    row_of, shares, made = np.zeros(len(known), np.int64), [np.zeros((1, len(marks.words)), np.float32)], 1
    for i in range(0, len(known), 20_000):
        kernel = marks.kernel(known[i : i + 20_000])
        near = np.flatnonzero(kernel.any(axis=1))
        row_of[i + near] = made + np.arange(len(near))
        made += len(near)
        shares.append(kernel[near] @ half.astype(np.float32))
    share = np.concatenate(shares)
    bounds = np.append(np.frombuffer(starts, np.int64), len(flat))
    rows_of_text = row_of[np.frombuffer(flat, np.int64)]
    x = np.concatenate([_sums(share, rows_of_text, bounds[i : i + 2001]) for i in range(0, len(starts), 2000)])
    doc = np.frombuffer(of, np.int64)
    bad = toxic[doc] == 1
    positive = bad.copy()
    for _ in range(3):
        keep = positive | ~bad
        y = np.where(positive, 1.0, -1.0)
        weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~bad).sum(), 1)) * keep * keep.sum()
        w = _svm(x, y, weight, c)
        margin = x @ w[:-1] + w[-1]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, margin)
        positive = bad & ((margin > 0) | (margin >= best[doc]))
    model = Model(marks.words, half @ w[:-1], float(w[-1]), np.zeros(FEATURES))
    scorer, f = Scorer(model), np.zeros((len(texts), FEATURES))
    for i in range(0, len(texts), 256):
        f[i : i + 256] = scorer.features(texts[i : i + 256])
    # Both classes weigh alike (the rarer one up to MOST_WEIGHT times its share), so that few toxic labels don't mean low scores.
    beta, weigh = np.zeros(FEATURES), np.where(toxic == 1, min(MOST_WEIGHT, max((toxic == 0).sum() / toxic.sum(), 1.0)), 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        step = np.linalg.solve((f * (weigh * p * (1 - p))[:, None]).T @ f + np.diag([1e-6] + [0.05] * (FEATURES - 1)), f.T @ (weigh * (toxic - p)) - np.array([0] + [0.05] * (FEATURES - 1)) * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    model.document = beta
    return model


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from a bounded sample of labelled documents that are not held out, by a hash of their id. Of contrary labels the toxic one holds."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~is_held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # Labels of documents that aren't there must not use up the sample.
    usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_HARMLESS))]
    chosen = F.broadcast(parts[0].union(parts[1]))
    sample = texts.join(chosen, "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "toxic").limit(SAMPLE_TOXIC + SAMPLE_HARMLESS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (model.landmarks, model.alpha.tolist(), model.bias, model.document.tolist())], ["landmarks", "alpha", "bias", "document"])

    # The sample is bounded; one task fits the model on it.
    row = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "toxic").mapInArrow(run, "landmarks array<string>, alpha array<double>, bias double, document array<double>").first()
    return Model(row.landmarks, np.array(row.alpha), row.bias, np.array(row.document)) if row else None


def toxicity_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null text is empty and gets the score of a text without words. Without a model every score is 0. Repeated rows keep
    one row each; a null doc_id is not held out.
    """

    def make():
        scorer = scorer_of(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = scorer.scores(texts_of(batch, "text")) if scorer else np.zeros(batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return each

    held = F.coalesce(is_held_out(), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(by_slices(256, make), SCORES)


def keep_harmless(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. Without a model nothing can be told harmless: documents then raise an error.

    A null text is judged as an empty one and stays, as do null ids; repeated rows are judged each on their own, and an empty table gives no rows.
    """
    if model is None and docs.take(1):
        raise ValueError("no toxicity model: among the labelled documents that are not held out a class is missing")

    def make():
        scorer = scorer_of(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scorer.scores(texts_of(batch, "text")) < THRESHOLD)) if scorer else batch

        return each

    return docs.mapInArrow(by_slices(256, make), docs.schema)
