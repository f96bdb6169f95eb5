"""Quality classifier learnt from trusted positives and unlabelled text (PU learning).

The model is linear in statistics of the whole text. It minimises the non-negative unbiased
risk of a positive-unlabelled problem: with class prior p,

    p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]),   l the logistic loss.

Where the second part of a mini-batch falls below zero, the step goes up its gradient instead,
as that part can't be negative but by overfitting. The prior is estimated from the data: a
first fit tells positives from unlabelled text, and on rows held out of that fit the share of
unlabelled rows above a threshold, over the share of positives above it, bounds the prior from
above; the smallest bound over thresholds, with a margin for chance, is taken.

Fitting works on bounded samples, drawn by hash from all rows. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade.llm.words import SPACE_SEPARATED, slices, text_buffers, word_hashes

#: Rows of each of both kinds that a fit looks at, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

_BYTES = np.arange(256)
#: Byte classes whose share of a text is a statistic.
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES < 91),
    "lower": (_BYTES >= 97) & (_BYTES < 123),
    "digit": (_BYTES >= 48) & (_BYTES < 58),
    "space": ~SPACE_SEPARATED,
    "line": _BYTES == 10,
    "sentence": np.isin(_BYTES, [ord(c) for c in ".,;:?'\"-"]),
    "shout": _BYTES == ord("!"),
    "bar": np.isin(_BYTES, [ord(c) for c in "|\t/\\_=+~"]),
    "symbol": np.isin(_BYTES, [ord(c) for c in "#$%&*@^"]),
    "bracket": np.isin(_BYTES, [ord(c) for c in "()[]{}<>"]),
    "control": (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13]),
    "wide": _BYTES >= 128,
}
_WORD_STATISTICS = (
    "log_words", "mean_word", "distinct_words", "log_distinct", "same_as_next", "same_as_after_next",
    "same_as_any_of_10", "top_word", "no_words", "words_without_letters", "capital_starts", "full_stops",
)
STATISTICS = (*_CLASSES, *_WORD_STATISTICS)
_IS_LETTER = _CLASSES["upper"] | _CLASSES["lower"] | _CLASSES["wide"]


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range; an empty range sums to 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each whole text; an empty text has zeros and no_words = 1.

    Words are the same if they differ in the case of A-Z only.
    """
    data, limits = text_buffers(column)
    out = np.zeros((len(limits) - 1, len(STATISTICS)))
    for start, end in slices(limits):
        base = int(limits[start])
        at = limits[start : end + 1] - base
        part = data[base : base + int(at[-1])]
        n = np.maximum(np.diff(at), 1)
        for k, member in enumerate(_CLASSES.values()):
            out[start:end, k] = np.sqrt(_per_row(member[part], at) / n)
        hashes, rows, starts = word_hashes(data, limits[start : end + 1], SPACE_SEPARATED)
        out[start:end, len(_CLASSES) :] = _word_statistics(part, at, hashes, rows, starts)
    return out


def _word_statistics(part, at, hashes, rows, starts) -> np.ndarray:
    words = np.diff(rows)
    n = np.maximum(words, 1)
    row = np.repeat(np.arange(len(words)), words)

    def alike(gap: int) -> np.ndarray:
        same = np.zeros(len(hashes), bool)
        if len(hashes) > gap:
            same[gap:] = (hashes[gap:] == hashes[:-gap]) & (row[gap:] == row[:-gap])
        return _per_row(same, rows) / n

    order = np.lexsort((hashes, row))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = _per_row(new, rows)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hashes)))
    top = np.zeros(len(words))
    np.maximum.at(top, row[order][first], size)
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[part], dtype=np.int64)])
    ends = np.append(starts[1:], len(part)) if len(starts) else starts
    bare = letters[ends] == letters[starts] if len(starts) else np.zeros(0, bool)
    capital = _CLASSES["upper"][part[starts]] if len(starts) else bare
    recent = np.zeros(len(hashes), bool)
    for gap in range(1, 11):
        if len(hashes) > gap:
            recent[gap:] |= (hashes[gap:] == hashes[:-gap]) & (row[gap:] == row[:-gap])
    visible = _per_row(SPACE_SEPARATED[part], at)
    return np.stack([
        np.log1p(words) / 10, visible / n / 20, distinct / n, np.log1p(distinct) / 10, alike(1), alike(2),
        _per_row(recent, rows) / n, top / n, (words == 0).astype(float), _per_row(bare, rows) / n,
        _per_row(capital, rows) / n, _per_row(part == ord("."), at) / n,
    ], axis=1)


def _expanded(x: np.ndarray) -> np.ndarray:
    """Statistics, their squares, and 1: what the linear model sees."""
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(_expanded(z) @ self.weights, -30, 30)))


def _sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit_weights(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 3000, batch: int = 2048, seed: int = 7) -> np.ndarray:
    """Weights of least non-negative unbiased risk, by Adam on mini-batches."""
    draw = np.random.default_rng(seed)
    p, u = _expanded(pos), _expanded(unl)
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    average = np.zeros_like(w)
    for t in range(1, steps + 1):
        a, b = p[draw.integers(len(p), size=min(batch, len(p)))], u[draw.integers(len(u), size=min(batch, len(u)))]
        fa, fb = a @ w, b @ w
        # gradients of E+[l(f)], E+[l(-f)] and Eu[l(-f)]
        g_pos = -(a * _sigmoid(-fa)[:, None]).mean(axis=0)
        g_neg = prior * (a * _sigmoid(fa)[:, None]).mean(axis=0)
        g_unl = (b * _sigmoid(fb)[:, None]).mean(axis=0)
        negative = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
        g = prior * g_pos + g_unl - g_neg if negative >= 0 else g_neg - g_unl
        g += 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            average += w / (steps - steps // 2)
    return average


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Smallest upper bound of the share of positives among unlabelled scores.

    For each threshold, (share of unlabelled above + margin) / (share of positives above).
    Margins follow the samples' sizes; thresholds that few positives pass bound nothing.
    """
    cut = np.quantile(pos, np.linspace(0, 0.9, 181))
    above_u = (unl[:, None] >= cut).mean(axis=0)
    above_p = (pos[:, None] >= cut).mean(axis=0)
    margin = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = np.argmin((above_u + margin * (1 + above_u / above_p)) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray) -> QualityModel:
    """A model from statistics of positive and unlabelled texts.

    Without any positive the prior is all there is to say: every text scores 0.5.
    """
    both = np.concatenate([pos, unl]) if len(pos) + len(unl) else np.zeros((1, len(STATISTICS)))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    if not len(pos) or not len(unl):
        return QualityModel(mean, scale, np.zeros(2 * len(STATISTICS) + 1), 0.5)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    w = fit_weights(p[::2], u[::2], 0.5)
    prior = estimate_prior(_expanded(p[1::2]) @ w, _expanded(u[1::2]) @ w) if min(len(p), len(u)) > 1 else 0.5
    return QualityModel(mean, scale, fit_weights(p, u, prior), prior)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), lists], names=["positive", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on positives of ``labels`` (quality = 1, not held out) and on unlabelled ``docs``.

    Each sample has ``sample_rows`` documents at most, those whose ids have the least hashes.
    No label but quality = 1 of rows not held out is read; a document with several labels is a
    positive if any says so. Null ids and null texts teach nothing.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    order = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.filter("quality = 1").filter(~held_out()).select("doc_id").distinct()
    chosen = known.orderBy(order, "doc_id").limit(sample_rows).withColumn("positive", F.lit(True))
    others = texts.select("doc_id").filter(~held_out()).distinct().orderBy(order, "doc_id").limit(sample_rows)
    ids = chosen.unionByName(others.withColumn("positive", F.lit(False)))
    # ids and statistics are of a bounded size; a repeated id's texts beyond the bound are left out
    measured = texts.join(F.broadcast(ids), "doc_id").select("positive", "text").mapInArrow(_measure, "positive boolean, x array<double>")
    got = measured.limit(4 * sample_rows).collect()
    pos, unl = (np.array(sorted(r.x for r in got if r.positive is kind)).reshape(-1, len(STATISTICS)) for kind in (True, False))
    return fit(pos, unl)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``score``, from the whole text.

    Null and empty texts have a score too, that of a text without words. A column ``score`` of
    ``docs`` is replaced.
    """
    names = [c for c in keep or docs.columns if c != "score"]
    read = docs.select(*dict.fromkeys([*names, "text"])).withColumn("text", F.col("text").cast("string"))
    schema = read.select(*names, F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(statistics(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), scores], names=[*names, "score"])

    return read.mapInArrow(score, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``score_quality`` by a model trained on ``docs`` and ``labels``, and int ``predicted``."""
    scored = score_quality(docs, train_quality(docs, labels), keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
