"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model is P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 <= t_1 <= ...;
features are the distinct words of a text and their stems, the first four and five bytes. It is fitted on a
bounded sample of labelled rows, weighted back to the shares of all labelled rows; a text's expected severity
is the sum of P(grade > k) over the thresholds.

Labels only say toxic or not. The grades of toxic rows are made from how many of the sample's telling words
a text repeats: words that toxic rows hold far more often than clean ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import carried_columns, text_of
from tideline.llm.flat import column_slices, flat, hashes, runs
from tideline.llm.decontaminate import _FOLD, _INSIDE


@dataclass
class OrdinalModel:
    """keys: sorted hashes of the words with a weight; thresholds ascend."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """w.x of each text, from the hashes of its words and the text each belongs to."""
        out = np.zeros(n)
        if not len(self.keys) or not len(value):
            return out
        at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        has = self.keys[at] == value
        pair = np.unique(doc[has] * np.int64(len(self.keys)) + at[has])
        return np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], minlength=n)


STEMS = (4, 5)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and of the stems of longer words, text that each belongs to, in order)."""
    data, offsets = flat(column)
    start, length, first = runs(data, offsets, _INSIDE)
    folded = _FOLD[data]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values, docs = [hashes(folded, start, length)[0]], [doc]
    for k, size in enumerate(STEMS):
        longer = length > size
        begins = start[longer]
        values.append(hashes(folded, begins, np.full(len(begins), size))[0] ^ np.uint64(k + 1))
        docs.append(doc[longer])
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]


def sample_features(docs: DataFrame, labels: DataFrame, per_class: int, id_column: str, text_column: str, label_column: str) -> pd.DataFrame:
    """id, toxic, words (distinct hashes), counts, total (labelled rows of its class) of at most per_class
    labelled rows of each class, chosen by a hash of their id. A row labelled twice counts as toxic if any
    label says so; null labels are left out; of rows with the same words one counts."""
    label = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.when(F.col(label_column) > 0, 1).otherwise(0)).alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = None
    for c in (0, 1):
        own = label.where(F.col("_toxic") == c)
        part = own.orderBy(*order).limit(per_class).crossJoin(own.agg(F.count(F.lit(1)).alias("_total")))
        chosen = part if chosen is None else chosen.unionByName(part)
    given = docs.select(docs[id_column].alias("_id"), text_of(docs[text_column]).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_toxic", "_total", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, doc = _words(batch.column("text"))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            pairs = [np.unique(value[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_toxic"), batch.column("_total"), pa.array([w.tobytes() for w, _ in pairs], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary())],
                ["id", "toxic", "total", "words", "counts"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    out = given.mapInArrow(run, f"id {kind}, toxic int, total long, words binary, counts binary").toPandas()
    return out.sort_values(["id", "words"], kind="stable").drop_duplicates("id").drop_duplicates("words").reset_index(drop=True)


def fit_ordinal(x: list[np.ndarray], grade: np.ndarray, n_features: int, grades: int, weight: np.ndarray | None = None, l2: float = 3e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the mean cumulative-link log loss, rows weighted."""
    weight = np.full(len(x), 1 / max(1, len(x))) if weight is None else weight / weight.sum()
    row = np.repeat(np.arange(len(x)), [len(f) for f in x])
    col = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.clip(weight @ above, 1e-3, 1 - 1e-3)
    base = np.log((1 - share) / share)
    #: Thresholds as a first one and positive steps, so that they keep their order.
    raw = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    params = np.concatenate([np.zeros(n_features), raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t = params[:n_features], np.concatenate([params[n_features : n_features + 1], params[n_features] + np.cumsum(np.exp(params[n_features + 1 :]))])
        score = np.bincount(row, w[col], minlength=len(x))
        p = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -60, 60)))
        off = (p - above) * weight[:, None]
        grad_w = np.bincount(col, off.sum(1)[row], minlength=n_features) + l2 * w
        by_t = -off.sum(0)
        gaps = np.exp(params[n_features + 1 :])
        grad_t = np.concatenate([[by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * gaps])
        grad = np.concatenate([grad_w, grad_t])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], np.concatenate([params[n_features : n_features + 1], params[n_features] + np.cumsum(np.exp(params[n_features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = 2000, grades: int = 4, least_z: float = 4.0, most_features: int = 50_000) -> OrdinalModel:
    """Fit on at most per_class rows of each class. Features: words and stems of three sample rows or more whose
    shares in the two classes differ by least_z standard errors, the most_features strongest. Without rows of
    both classes the model calls nothing toxic."""
    sample = sample_features(docs, labels, per_class, id_column, text_column, label_column)
    toxic = sample["toxic"].to_numpy() > 0 if len(sample) else np.zeros(0, bool)
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 50.0) + np.arange(grades - 1))
    words = [np.frombuffer(x, np.uint64) for x in sample["words"]]
    counts = [np.frombuffer(x, np.int32) for x in sample["counts"]]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    vocabulary, back, held = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    in_toxic = np.bincount(back, toxic[row], minlength=len(vocabulary))
    n = np.array([(~toxic).sum(), toxic.sum()])
    share = np.stack([(held - in_toxic) / n[0], in_toxic / n[1]])
    pooled = held / n.sum()
    z = (share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n).sum())
    #: Telling words: smoothed odds of ten to one for toxic rows, beyond chance.
    odds = ((in_toxic + 0.5) / n[1]) / ((held - in_toxic + 0.5) / n[0])
    telling = (odds >= 10) & (z >= least_z) & (held >= 3)
    repeats = np.bincount(row, np.concatenate(counts) * telling[back], minlength=len(words))
    grade = np.zeros(len(words), int)
    cuts = np.quantile(repeats[toxic], np.arange(1, grades - 1) / (grades - 1))
    grade[toxic] = 1 + np.searchsorted(cuts, repeats[toxic], side="left")
    use = np.flatnonzero((np.abs(z) >= least_z) & (held >= 3))
    use = np.sort(use[np.argsort(-np.abs(z[use]), kind="stable")][:most_features])
    place = np.full(len(vocabulary), -1)
    place[use] = np.arange(len(use))
    ends = np.cumsum([len(w) for w in words])
    features = [p[p >= 0] for p in np.split(place[back], ends[:-1])]
    weight = sample["total"].to_numpy() / n[toxic.astype(int)]
    weights, thresholds = fit_ordinal(features, grade, len(use), grades, weight)
    return OrdinalModel(vocabulary[use], weights, thresholds)


def grade_texts(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text", cut: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the kept columns (the id), toxic (P(grade > 0) >= cut), grade (the number of
    thresholds passed with even odds), p_toxic, expected_severity.

    Null and empty texts score as texts without words; very long ones are read whole. A null id stays null,
    repeated rows each give a row, no rows give none, extra columns are ignored unless kept; a kept one that is
    called as a result is comes out as <name>_given. The model is of bounded size and goes along as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = {"toxic": "boolean", "grade": "int", "p_toxic": "double", "expected_severity": "double"}
    given, names, text = carried_columns(docs, [id_column] if keep is None else keep, text_column, fields)
    plain = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, text):
                value, doc = _words(batch.column(text))
                above = sent.value.above(sent.value.scores(value, doc, batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in plain), pa.array(above[:, 0] >= cut), pa.array((above >= 0.5).sum(1), pa.int32()), pa.array(above[:, 0]), pa.array(above.sum(1))],
                    [*plain, *fields],
                )

    schema = ", ".join([*(f"{c} {given.schema[c].dataType.simpleString()}" for c in plain), *(f"{c} {t}" for c, t in fields.items())])
    return given.mapInArrow(run, schema).toDF(*names, *fields)


def without_toxic(docs: DataFrame, model: OrdinalModel, text_column: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given, names, text = carried_columns(docs, docs.columns, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, text):
                value, doc = _words(batch.column(text))
                above = sent.value.above(sent.value.scores(value, doc, batch.num_rows))
                yield batch.filter(pa.array(above[:, 0] < cut))

    return given.mapInArrow(run, given.schema).toDF(*names)
