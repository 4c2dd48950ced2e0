"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one latent score s, the sum of hashed-text weights; ordered thresholds t_1 <= t_2 cut it into grades with
P(grade <= k) = logistic(t_(k+1) - s). All grades share the weights. Expected grade and tail probabilities select documents.

Features go into one hashed space: every word (mean of the weights over a text's words) and shape features (shares of upper
case, digits, marks, repeats and so on, each in one of LEVELS steps). Labels are fitted on at most SAMPLE rated documents, those of smallest hash of
doc_id; every document is scored on its whole text.

Null or empty texts have only shape features. A null rating, or one whose document is missing, is left out; several ratings
of one doc_id count as their lowest. Without any rating every tail probability is 1. Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import LOWER, U64, fields, lean, lists, mix, packed, prefix_hash, span_hash, step, texts, unpacked, words

WIDTH = 1 << 16
SAMPLE = 8000
GRADES = 3
#: Upper ends of the steps of a share.
LEVELS = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
MARKS = {"upper": range(65, 91), "digit": range(48, 58), "bang": b"!?", "bar": b"|", "sign": b"%$#*&@^~", "mark": b".,;:", "line": b"\n", "bracket": b"<>{}[]()=", "high": range(128, 256)}
CLASSES = np.zeros((len(MARKS), 256), bool)
for _i, _of in enumerate(MARKS.values()):
    CLASSES[_i, list(_of)] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the words, first word of each row, places of the shape features: rows x kinds)."""
    starts, ends, first = words(data, offsets)
    each = span_hash(prefix_hash(LOWER[data]), starts, ends)
    sizes, n = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(first), 1)
    sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
    again = np.zeros(len(each), bool)
    again[1:] = each[1:] == each[:-1]
    again[first[:-1][first[:-1] < len(each)]] = False
    shares = [sums(c[data], offsets) / sizes for c in CLASSES] + [sums(again, first) / n, sums(ends - starts > 20, first) / n]
    steps = [np.searchsorted(LEVELS, x) + (x > 0) for x in shares] + [np.minimum(np.log2(np.diff(first) + 1).astype(int), 15)]
    shape = np.stack([(mix(np.full(len(x), 1000 * (i + 1), U64) + x.astype(U64)) % U64(WIDTH)).astype(np.int64) for i, x in enumerate(steps)], 1)
    return (each % U64(WIDTH)).astype(np.int32), first, shape


def _collect(batches):
    for batch in batches:
        for a, b, data, offsets in texts(batch.column("text")):
            w, first, shape = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, b - a), lists(w, np.diff(first)), lists(shape.ravel().astype(np.int32), np.full(b - a, shape.shape[1]))], ["grade", "w", "shape"])


def _logistic(x):
    return 0.5 * (1 + np.tanh(x / 2))


def fit(grade: np.ndarray, w: np.ndarray, counts: np.ndarray, shape: np.ndarray, rounds: int = 200, rate: float = 0.05, keep: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised loss, by Adam over all rows at once."""
    row = np.repeat(np.arange(len(grade)), counts)
    share = 1 / np.maximum(counts, 1)
    # thresholds: the first, then the logarithms of the gaps
    x, gaps = np.zeros(WIDTH), np.array([-1.0] + [0.0] * (GRADES - 2))
    m, v = [np.zeros(WIDTH), np.zeros(GRADES - 1)], [np.zeros(WIDTH), np.zeros(GRADES - 1)]
    for step in range(1, rounds + 1):
        s = np.bincount(row, x[w], len(grade)) * share + x[shape].sum(1)
        cuts = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = _logistic(ends[grade + 1] - s), _logistic(ends[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        ds = (1 - hi - lo) / len(grade)
        dx = np.bincount(w, (ds * share)[row], WIDTH) + np.bincount(shape.ravel(), np.repeat(ds, shape.shape[1]), WIDTH) + keep * x
        dc = np.bincount(grade, -hi * (1 - hi) / p, GRADES)[:-1] + np.bincount(grade, lo * (1 - lo) / p, GRADES)[1:]
        dc = dc / len(grade)
        tail = np.cumsum(dc[::-1])[::-1]
        dg = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        for i, (value, g) in enumerate(((x, dx), (gaps, dg))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            value -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return x, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model for ratings(doc_id, grade) of docs(doc_id, text); grades from 0 to GRADES - 1."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("grade", "text").mapInArrow(_collect, "grade int, w array<int>, shape array<int>").toArrow()
    if not got.num_rows:
        return np.zeros(WIDTH), np.full(GRADES - 1, -np.inf)
    grade = got["grade"].to_numpy()
    w = got["w"].combine_chunks()
    counts = w.value_lengths().to_numpy(zero_copy_only=False)
    return fit(grade, w.flatten().to_numpy(), counts, got["shape"].combine_chunks().flatten().to_numpy().reshape(len(grade), -1))


@step
def _score(weights: np.ndarray, cuts: np.ndarray, columns: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                w, first, shape = features(data, offsets)
                sums = np.diff(np.concatenate([[0.0], np.cumsum(weights[w])])[first])
                s = sums / np.maximum(np.diff(first), 1) + weights[shape].sum(1)
                tails = [_logistic(s - c) for c in cuts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), pa.array(np.sum(tails, 0)), *map(pa.array, tails)], [*columns, "expected_grade", *(f"p{k + 1}" for k in range(len(tails)))])

    return run


def graded(labels: DataFrame) -> DataFrame:
    """Ratings in three grades from labels(doc_id, quality, toxic): 0 bad, 1 well written but toxic, 2 good. Null toxic counts as 0."""
    toxic = F.coalesce("toxic", F.lit(0))
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(toxic == 1, 1).otherwise(2).alias("grade"))


def scored(docs: DataFrame, ratings: DataFrame, columns: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The chosen columns of docs (default doc_id), expected_grade, and p1, p2: the probabilities of grade 1 and 2 at least. Columns of docs that bear these names are replaced."""
    made = ["expected_grade", *(f"p{k + 1}" for k in range(GRADES - 1))]
    columns = [c for c in docs.columns if c in (["doc_id"] if columns is None else columns) and c.lower() not in made]
    weights, cuts = train(docs, ratings, sample)
    source = lean(docs).select(*columns, *([] if "text" in columns else ["text"]))
    schema = fields(source, *columns)
    for c in made:
        schema = schema.add(c, "double")
    return source.mapInArrow(_score(weights, cuts, columns), schema)


def selected(docs: DataFrame, ratings: DataFrame, least: float = 0.5, grade: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Rows of docs, all columns, whose probability of the grade or better is at least least."""
    weights, cuts = train(docs, ratings, sample)
    source = packed(lean(docs))
    schema = fields(source, "row", "text").add("grade", "double")
    for k in range(GRADES - 1):
        schema = schema.add(f"p{k + 1}", "double")
    out = source.mapInArrow(_score(weights, cuts, ["row", "text"]), schema)
    return unpacked(out.where(F.col(f"p{grade}") >= least), docs.columns)
