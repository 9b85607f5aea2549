"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors over hashed n-grams of letters. Document frequencies count every
labelled document. The weights are fitted by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample of labelled rows, and one temperature, fitted on a
held-out part of that sample, calibrates the probabilities.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is
every text when nothing could be learned. Rows with a null label are not learned from but
predicted. Repeated rows count as often as they occur. Ties go to the label that is first by
code point. Texts of any length are read in pieces of fixed size. Only the named columns are
read, so further columns of any name pass by. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
PIECE = 1 << 18


@dataclass(frozen=True)
class LanguageSettings:
    orders: tuple[int, ...] = (1, 2, 3, 4)
    bins: int = 1 << 15
    sample_rows: int = 2400  # bound on the labelled rows that the weights are fitted on
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


@dataclass(frozen=True)
class LanguageModel:
    settings: LanguageSettings
    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # bins x labels
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str | None, settings: LanguageSettings) -> np.ndarray | None:
    """Counts per bin of the letter n-grams of a whole text; None without a letter."""
    if not text:
        return None
    table, reach = _letters(), max(settings.orders) - 1
    counts, found = np.zeros(settings.bins, np.int64), False
    tail, before = np.zeros(0, np.uint64), False
    text = text.lower()
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[points]
        # one blank stands for each run of other characters
        keep = letter | np.concatenate(([before], letter[:-1]))
        before = bool(letter[-1])
        found = found or bool(letter.any())
        codes = np.concatenate((tail, np.where(letter, points, 32)[keep].astype(np.uint64)))
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, reach + 2):
            gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in settings.orders and len(gram):
                fresh = gram[max(0, len(tail) - n + 1) :]
                mixed = (fresh + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                slots = (mixed >> np.uint64(40)) & np.uint64(settings.bins - 1)
                counts += np.bincount(slots.astype(np.int64), minlength=settings.bins)
            if not len(gram):
                break
        tail = codes[max(0, len(codes) - reach) :]
    return counts if found else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.flatnonzero(counts)
    values = (1 + np.log(counts[index])) * idf[index]
    size = np.sqrt((values**2).sum())
    return index, values / size if size else values


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _document_frequencies(texts: DataFrame, settings: LanguageSettings) -> tuple[int, np.ndarray]:
    """Documents with a letter, and of them those with each bin, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(settings.bins, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py(), settings)
                if counts is not None:
                    seen += counts > 0
                    rows += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(index, -1)), pa.array(np.append(seen[index], rows))], names=["bin", "n"]
        )

    totals = texts.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    frequency = np.zeros(settings.bins + 1, np.int64)
    for row in totals.collect():  # at most bins + 1 rows
        frequency[row["bin"]] = row["n"]
    return int(frequency[-1]), frequency[:-1]


def _sample(rows: DataFrame, settings: LanguageSettings) -> tuple[tuple[str, ...], DataFrame | None]:
    """All labels, and (label, bins, counts) of at most sample_rows documents, as many of each label as can be."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return (), None
    quota = max(1, settings.sample_rows // len(sizes))
    shares = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(4.0 * quota / n))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the draw thins a label before its rows are put in order, the order makes the bound exact
    few = rows.withColumn("draw", draw).filter(F.col("draw") < shares[F.col("label")])
    rank = F.row_number().over(W.partitionBy("label").orderBy("draw", "key"))
    few = few.withColumn("rank", rank).filter(F.col("rank") <= quota)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, index, values = [], [], []
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                counts = gram_counts(text.as_py(), settings)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    labels.append(label)
                    index.append(at.astype("<u4").tobytes())
                    values.append(np.minimum(counts[at], 0xFFFFFFFF).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(index, pa.binary()), pa.array(values, pa.binary())],
                names=["label", "bins", "counts"],
            )

    return tuple(sorted(sizes)), few.select("label", "text", "draw").mapInArrow(features, "label string, bins binary, counts binary")


def fit(docs: DataFrame, text: str, label: str, key: str, settings: LanguageSettings | None = None) -> LanguageModel:
    """Learn from every row of `docs` that has a label; `key` only orders the sample.

    The sample, of bounded size, meets in one task; the driver gets the weights only.
    """
    settings = settings or LanguageSettings()
    rows = docs.select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("key")
    ).filter("label is not null and text is not null")
    n, frequency = _document_frequencies(rows.select("text"), settings)
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 1.0
    labels, sample = _sample(rows, settings)
    if sample is None:
        return LanguageModel(settings, (), idf, np.zeros((settings.bins, 0), np.float32), np.zeros(0), 1.0)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("label", "bins", "counts"))))
        weights, bias, temperature = _learn(found, idf, settings)
        known = json.dumps(sorted({r[0] for r in found}))
        yield pa.RecordBatch.from_pydict(
            {"labels": [known], "weights": [weights.astype("<f4").tobytes()], "bias": [bias.astype("<f8").tobytes()], "temperature": [temperature]}
        )

    row = sample.repartition(1).mapInArrow(train, "labels string, weights binary, bias binary, temperature double").first()
    labels = tuple(json.loads(row["labels"])) if row else ()
    if not labels:
        return LanguageModel(settings, (), idf, np.zeros((settings.bins, 0), np.float32), np.zeros(0), 1.0)
    weights = np.frombuffer(row["weights"], "<f4").reshape(settings.bins, len(labels))
    return LanguageModel(settings, labels, idf, weights, np.frombuffer(row["bias"], "<f8"), row["temperature"])


def _learn(sample: list, idf: np.ndarray, settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature from (label, bins, counts) in a fixed order."""
    labels = tuple(sorted({r[0] for r in sample}))
    vectors = []
    for name, index, counts in sample:
        dense = np.zeros(settings.bins, np.int64)
        dense[np.frombuffer(index, "<u4")] = np.frombuffer(counts, "<u4")
        vectors.append((labels.index(name), *_vector(dense, idf)))
    order = np.random.default_rng(7).permutation(len(vectors))
    aside = [vectors[i] for i in order[: len(order) // 5]]
    weights, bias = _follow_the_leader([vectors[i] for i in order[len(order) // 5 :]], len(labels), settings)
    return weights, bias, _temperature(aside, weights, bias)


def _follow_the_leader(rows: list, k: int, s: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias, not penalised."""
    z, n = np.zeros((s.bins + 1, k)), np.zeros((s.bins + 1, k))

    def solve(index: np.ndarray) -> np.ndarray:
        zi, ni = z[index], n[index]
        l1 = np.where(index == s.bins, 0.0, s.l1)[:, None]
        l2 = np.where(index == s.bins, 0.0, s.l2)[:, None]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((s.beta + np.sqrt(ni)) / s.alpha + l2)

    for _ in range(s.epochs):
        for label, index, values in rows:
            index, values = np.append(index, s.bins), np.append(values, 1.0)
            w = solve(index)
            p = _softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / s.alpha
            z[index] += g - step * w
            n[index] += g * g
    w = solve(np.arange(s.bins + 1))
    return w[:-1], w[-1]


def _temperature(rows: list, weights: np.ndarray, bias: np.ndarray) -> float:
    """The divisor of the logits with the least held-out log loss, on a fixed grid."""
    if not rows:
        return 1.0
    logits = np.array([v @ weights[i] + bias for _, i, v in rows])
    at = np.arange(len(rows)), np.array([r[0] for r in rows])

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(-(x[at] - np.log(np.exp(x).sum(axis=1))).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def predict(docs: DataFrame, text: str, model: LanguageModel, keep: list[Column]) -> DataFrame:
    """The columns of `keep`, `lang_pred` and `score` for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x (labels + 1) numbers
    kept = docs.select(*keep).schema

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column("_text"):
                name, score = UNKNOWN, 0.0
                counts = gram_counts(value.as_py(), m.settings) if m.labels else None
                if counts is not None:
                    index, values = _vector(counts, m.idf)
                    p = _softmax((values @ m.weights[index] + m.bias) / m.temperature)
                    best = int(p.argmax())
                    name, score = m.labels[best], min(1.0, float(p[best]))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept.fields), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept.names, "lang_pred", "score"],
            )

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(classify, f"{out}, lang_pred string, score double")
