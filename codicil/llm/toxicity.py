"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; the model of a category also
sees the probabilities of the categories before it.  While training, those
probabilities are out-of-fold: each row gets them from models that did not see it.

A document's features are its words and their beginnings (``PREFIXES`` letters), over
the whole text: that they occur, occur twice or four times, or make up a hundredth or a
thirtieth of the words.  Each model is a logistic regression
with an L1 penalty, so most weights are exactly zero and long clean texts do not
drift.  Training uses a bounded sample of labelled rows (``max_labelled``: up to half of
them with the last category and as many without, chosen by a hash of the id; weighted by
the numbers of all labels, so that probabilities do not move with the input's size); features are screened in Spark by their chi-square statistic, so
the driver holds at most ``max_labelled`` rows of at most ``max_features`` indices a
category.  Scoring is one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.shared import stage

PREFIXES = (3, 4, 5, 6)
FOLDS = 3
MAX_LABELLED = 8_000
MAX_FEATURES = 1_500
PENALTY = 1e-4
STEPS = 200
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _bases(word: str) -> list[int]:
    """Hashes of a word and its beginnings (60 bits, so clashes are rare)."""
    names = [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh64_intdigest(n) >> 4 for n in names]


def _levels(counts: dict[int, int], words: int) -> list[int]:
    """Features: each base that occurs, and the levels that its number and its rate reach."""
    out = []
    for base, n in counts.items():
        out.append(base * 8)
        if n > 1:
            out += [base * 8 + i for i, reached in enumerate((True, n >= 4, n * 100 >= words, n * 30 >= words), 1) if reached]
    return out


def _features(text: str | None) -> list[int]:
    words, counts = _words(text), Counter()
    for word, n in words.items():
        for base in _bases(word):
            counts[base] += n
    return _levels(counts, words.total())


@dataclass
class Linear:
    """Weights by feature, the intercept, and the weights of the earlier categories."""

    intercept: float = -20.0
    weights: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    def probabilities(self, present: Iterable[int]) -> list[float]:
        own, out = sorted(present), []
        for model in self.models:
            score = model.intercept + sum(model.weights.get(f, 0.0) for f in own) + sum(w * p for w, p in zip(model.earlier, out, strict=True))
            out.append(float(_sigmoid(score)))
        return out

    def active(self) -> set[int]:
        return {f for m in self.models for f, w in m.weights.items() if w}


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Sparse 0/1 rows with dense columns behind them."""

    def __init__(self, rows: list[list[int]], width: int, dense: np.ndarray) -> None:
        self.height, self.width, self.dense = len(rows), width, dense
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.height) + self.dense @ w[self.width :]

    def turned_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.row], self.width), self.dense.T @ r])

    def take(self, mask: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        place = np.cumsum(mask) - 1
        keep = mask[self.row]
        out.height, out.width, out.dense = int(mask.sum()), self.width, self.dense[mask]
        out.row, out.column = place[self.row[keep]], self.column[keep]
        return out


def _fit(x: _Rows, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """L1 logistic regression on weighted rows by accelerated proximal gradient; last dense column: intercept, not penalised."""
    weight = weight / weight.mean()
    size = x.width + x.dense.shape[1]
    w = z = np.zeros(size)
    probe = np.ones(size) / np.sqrt(size)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.turned_times(weight * x.times(probe))
        scale = np.linalg.norm(probe)
        probe = probe / max(scale, 1e-12)
    rate, momentum = 4.0 * x.height / max(scale * 1.05, 1e-12), 1.0
    shrink = np.full(size, rate * penalty)
    shrink[-1] = 0.0
    for _ in range(steps):
        step = z - rate * x.turned_times(weight * (_sigmoid(x.times(z)) - y)) / x.height
        new = np.sign(step) * np.maximum(np.abs(step) - shrink, 0.0)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / grown * (new - w), new, grown
    return w


def train(rows: list[tuple[int, list[int], list[list[int]]]], chosen: list[list[int]], names: list[str], folds: int = FOLDS, penalty: float = PENALTY, steps: int = STEPS, weights: tuple[float, float] = (1.0, 1.0)) -> Chain:
    """``rows``: (fold, answers by category, indices of present features by category); ``weights`` of rows without and with the last category."""
    weight = np.array([weights[r[1][-1]] for r in rows], float)
    fold = np.array([r[0] for r in rows])
    earlier, models = np.empty((len(rows), 0)), []
    for k, features in enumerate(chosen):
        y = np.array([r[1][k] for r in rows], float)
        if not len(rows) or y.min() == y.max():
            models.append(Linear(20.0 if len(rows) and y[0] else -20.0, {}, [0.0] * k))
            earlier = np.column_stack([earlier, y])
            continue
        x = _Rows([r[2][k] for r in rows], len(features), np.column_stack([earlier, np.ones(len(rows))]))
        w = _fit(x, y, weight, penalty, steps)
        out_of_fold = np.empty(len(rows))
        for f in range(folds):
            seen, held = fold != f, fold == f
            if held.any() and seen.any():
                out_of_fold[held] = _sigmoid(x.take(held).times(_fit(x.take(seen), y[seen], weight[seen], penalty, steps)))
            else:
                out_of_fold[held] = np.average(y, weights=weight)
        n = len(features)
        models.append(Linear(float(w[-1]), {f: float(v) for f, v in zip(features, w[:n], strict=True) if v}, [float(v) for v in w[n:-1]]))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(names, models)


def fit(
    documents: DataFrame, labels: DataFrame, categories: dict[str, Column], id_column: str = "doc_id", text_column: str = "text",
    max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, folds: int = FOLDS,
) -> Chain:
    """Trains the chain; ``categories`` maps names, in the chain's order, to boolean columns of ``labels``.

    Rows of ``labels`` with a null id or answer are not used; of several rows for one
    id one is used.  A category whose answers are all alike is predicted so; without
    labelled rows every probability is about 0.
    """
    names = list(categories)
    answers = [c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]
    ids = F.col(id_column).cast("long")
    picked = labels.select(ids.alias("label_id"), *answers).dropna()
    picked = picked.groupBy("label_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    last, order = F.col(f"y{len(names) - 1}"), [F.xxhash64("label_id"), F.col("label_id")]
    labelled = {r["y"]: r["n"] for r in picked.groupBy(last.alias("y")).agg(F.count("*").alias("n")).collect()}  # two rows
    weights = tuple(max(labelled.get(answer, 0) / max(max_labelled // 2, 1), 1.0) for answer in (0, 1))
    halves = [picked.where(last == answer).orderBy(*order).limit(max_labelled // 2) for answer in (1, 0)]  # the documented bound
    picked = halves[0].unionAll(halves[1])
    texts = documents.select(ids.alias("id"), F.col(text_column).cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("id") == F.col("label_id")).drop("label_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [sorted(_features(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64())), *part.columns[2:]], names=["id", "present", *part.schema.names[2:]])

    schema = "id long, present array<long>, " + ", ".join(f"y{k} int" for k in range(len(names)))
    sample = stage(joined.mapInArrow(featurise, schema).dropDuplicates(["id"]), "labelled")
    totals = sample.agg(F.count("*"), *[F.coalesce(F.sum(f"y{k}"), F.lit(0)) for k in range(len(names))]).first()
    counts = sample.select(F.explode("present").alias("f"), *[f"y{k}" for k in range(len(names))]).groupBy("f")
    counts = counts.agg(F.count("*").alias("n"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names))]).where("n >= 4")
    counts = stage(counts, "feature-counts")
    chosen = []
    for k in range(len(names)):
        n, rows, positive = F.col("n"), float(totals[0]), float(totals[k + 1])
        gap = F.col(f"y{k}") - n * F.lit(positive / max(rows, 1.0))
        statistic = gap * gap / (n * (F.lit(rows) - n + 1.0))
        chosen.append([r["f"] for r in counts.orderBy(statistic.desc(), "f").limit(max_features).select("f").collect()])
    places = [{f: i for i, f in enumerate(own)} for own in chosen]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = [p.as_py() for p in batch.column(1)]
            columns = [pa.array([[place[f] for f in p if f in place] for p in present], pa.list_(pa.int32())) for place in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], names=["id", *batch.schema.names[2:], *[f"x{k}" for k in range(len(places))]])

    schema = "id long, " + ", ".join([f"y{k} int" for k in range(len(names))] + [f"x{k} array<int>" for k in range(len(names))])
    found = sample.mapInArrow(located, schema).orderBy("id").collect()
    rows = [(xxhash.xxh64_intdigest(str(r["id"])) % folds, [r[f"y{k}"] for k in range(len(names))], [r[f"x{k}"] for k in range(len(names))]) for r in found]
    return train(rows, chosen, names, folds, weights=weights)


def score(documents: DataFrame, chain: Chain, keep: list[str], text_column: str = "text", prefix: str = "p_") -> DataFrame:
    """The columns in ``keep`` and ``<prefix><category>`` for each row, from its whole text.

    Null and empty texts have no feature.  Rows are neither moved nor joined.  A prefix
    that makes a name of ``keep`` again is an error.
    """
    active = {f >> 3 for f in chain.active()}
    names = [f"{prefix}{n}" for n in chain.names]
    if set(names) & set(keep):
        raise ValueError(f"column names taken: {sorted(set(names) & set(keep))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neutral: set[str] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part, found = batch.slice(i, 1024), []
                for text in part.column(0):
                    words, counts = _words(text.as_py()), Counter()
                    for word in words.keys() - neutral:
                        own = active.intersection(_bases(word))
                        for base in own:
                            counts[base] += words[word]
                        if not own and len(neutral) < REMEMBERED:
                            neutral.add(word)
                    found.append(chain.probabilities(_levels(counts, words.total())))
                if len(neutral) >= REMEMBERED:
                    neutral.clear()
                columns = [pa.array([p[k] for p in found], pa.float64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*part.schema.names[1:], *names])

    inputs = documents.select(F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(f.dataType.simpleString() for f in inputs.schema[1:])] + [f"{n} double" for n in names])
    out = inputs.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *names)


def label_categories() -> dict[str, Column]:
    """The categories of the labels table, in the chain's order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
