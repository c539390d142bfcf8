"""Ordinal quality classifier: cumulative-link regression on graded ratings.

A text's features are hashed: its lower-cased words and their beginnings of 4
to 6 bytes as present or absent, and its share of word shapes (case, last
character, repetition of the word before).
One weight vector serves all grades; ordered thresholds cut the score, so that
P(grade <= k) = logistic(threshold_k - score).  The model gives the expected
grade and the probability of reaching the grade that selection asks for.

The model is fitted on at most ``SAMPLE`` labelled documents, the first by a
hash of their id; only features that ``MIN_DOCS`` of these share, and whose
frequency differs between grades by ``MIN_CHI2``, get a weight; an L1 penalty
keeps few of them.
Its size is fixed, so the task that scores a batch carries it along.

Defined results: null and empty texts have no features and get the score 0
from which no grade differs but by its thresholds; labels without a document,
and null grades, are ignored; repeated label rows count as often as they occur;
without labels of two grades there is nothing to fit and every document is
selected; ties in the order of labelled documents go by id and grade; texts of
any length are read whole; null ids are scored like others; rows that repeat
are scored each; other columns, whatever their names, stay as they are; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, unused
from .kernels import U, byte_table, distinct, doc_words, mix, slices, span_hashes

SAMPLE, MIN_DOCS, MIN_CHI2 = 5000, 6, 12.0
BITS = 18  # of hashed words; shapes follow
SHAPES = 512
STEPS, RATE, PENALTY = 200, 0.2, 3e-4
CLEAN = 2


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor text, 1: well-formed but toxic, 2: clean."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).when(quality == 1, CLEAN)


def features(texts: list[str | None], only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature ids and values of every text; ``only`` marks the hashed features that are wanted."""
    buf, starts, ends, words, first = doc_words(texts, lower=True)
    ids = (words >> U(64 - BITS)).astype(np.int32)
    hashed, at = [ids], [np.arange(len(ids))]
    for n in (4, 5, 6):
        long = np.flatnonzero(ends - starts >= n)
        h = span_hashes(buf, starts[long], starts[long] + n, byte_table(True))
        hashed.append((mix(h, n) >> U(64 - BITS)).astype(np.int32))
        at.append(long)
    hashed, at = np.concatenate(hashed), np.concatenate(at)
    if only is not None:
        wanted = only[hashed]
        hashed, at = hashed[wanted], at[wanted]
    order = np.argsort(at, kind="stable")
    hashed, cut = hashed[order], np.searchsorted(at[order], first)
    head, last, second = buf[starts], buf[ends - 1], buf[np.minimum(starts + 1, ends - 1)]
    kind = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit; high bytes are letters
    kind[97:123] = kind[128:] = 1
    kind[65:91], kind[48:58] = 2, 3
    shape = (kind[head] * 4 + kind[second]) * 4 + np.minimum(ends - starts, 15) // 4
    tail = 64 + np.where(kind[last] > 0, kind[last], last.astype(np.int64))
    echo = np.zeros(len(words), np.int64)
    echo[1:] = words[1:] == words[:-1]
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        n = b - a
        if not n:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        seen = distinct(hashed[cut[i] : cut[i + 1]])
        share = np.bincount(shape[a:b], minlength=SHAPES) + np.bincount(tail[a:b], minlength=SHAPES)
        share[320], share[321] = len(distinct(ids[a:b])), echo[a + 1 : b].sum()
        on = np.flatnonzero(share)
        yield np.concatenate([seen, ((1 << BITS) + on).astype(np.int32)]), np.concatenate([np.ones(len(seen), np.float32), (4 * share[on] / n).astype(np.float32)])


def useful_features(ids: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Mask over all features: shapes, and words whose counts by grade differ enough.  counts: (grade, feature)."""
    seen, chi2 = counts.sum(0), np.zeros(len(ids))
    for g in range(len(docs)):
        expected = docs[g] / docs.sum() * seen
        chi2 += (counts[g] - expected) ** 2 * (1 / np.maximum(expected, 1e-9) + 1 / np.maximum(docs[g] - expected, 1e-9))
    mask = np.zeros((1 << BITS) + SHAPES, bool)
    mask[ids[(chi2 >= MIN_CHI2) | (ids >= 1 << BITS)]] = True
    return mask


def fit(y: np.ndarray, found: list[np.ndarray], shares: list[np.ndarray], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the cumulative-link likelihood."""
    size = (1 << BITS) + SHAPES
    at = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in found])
    ids, values = np.concatenate(found), np.concatenate(shares)
    used, column = np.unique(ids, return_inverse=True)
    balance = len(y) / (grades * np.maximum(np.bincount(y, minlength=grades), 1))
    weight = np.sqrt(balance)[y] / len(y)
    w, cuts = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(grades - 2)])  # first threshold, then logs of the gaps
    m, v = np.zeros(len(w) + len(cuts)), np.zeros(len(w) + len(cuts))
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, STEPS + 1):
        theta = cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))])
        score = np.bincount(at, values * w[column], minlength=len(y))
        upper = np.where(y < grades - 1, logistic(theta[np.minimum(y, grades - 2)] - score), 1.0)
        lower = np.where(y > 0, logistic(theta[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        gw = np.bincount(column, values * (du - dl)[at], minlength=len(w))
        gt = np.zeros(grades - 1)
        np.add.at(gt, np.minimum(y, grades - 2), np.where(y < grades - 1, -du, 0))
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, dl, 0))
        gc = np.concatenate([[gt.sum()], [gt[j + 1 :].sum() * np.exp(cuts[j + 1]) for j in range(grades - 2)]])
        g = np.concatenate([gw, gc])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = RATE * (1 - t / (STEPS + 1)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        step = pace * m / (1 - 0.9**t)
        w, cuts = w - step[: len(w)], cuts - step[len(w) :]
        w = np.sign(w) * np.maximum(np.abs(w) - PENALTY * pace[: len(w)], 0)
    full = np.zeros(size, np.float32)
    full[used] = w
    return full, cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on labelled documents: labels has doc_id, quality, toxic."""
    graded = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf.text)
            for lo, hi in slices([len(t or "") for t in texts]):
                found = list(features(texts[lo:hi]))
                yield pd.DataFrame({"grade": pdf.grade.iloc[lo:hi], "ids": [f[0] for f in found], "values": [f[1] for f in found]})

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [mask[i] for i in pdf.ids]
            yield pd.DataFrame({"grade": pdf.grade, "ids": [i[k] for i, k in zip(pdf.ids, keep)], "values": [v[k] for v, k in zip(pdf["values"], keep)]})

    schema, grades = "grade int, ids array<int>, values array<float>", range(CLEAN + 1)
    found = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInPandas(read, schema), "graded")
    sizes = {r["grade"]: r["count"] for r in found.groupBy("grade").count().collect()}  # a row for each grade
    if len(sizes) < 2:
        return None
    # at most one row for each hashed feature
    counts = found.select("grade", F.explode("ids").alias("id")).groupBy("id").agg(*[F.count(F.when(F.col("grade") == g, 1)).cast("int").alias(f"g{g}") for g in grades])
    counts = counts.where(" + ".join(f"g{g}" for g in grades) + f" >= {MIN_DOCS}").toPandas()
    mask = useful_features(counts["id"].to_numpy(), counts[[f"g{g}" for g in grades]].to_numpy().T.astype(float), np.array([sizes.get(g, 0) for g in grades], float))
    rows = found.mapInPandas(filtered, schema).toPandas()
    return fit(rows.grade.to_numpy(np.int64), [np.asarray(i, np.int32) for i in rows.ids], [np.asarray(v, np.float32) for v in rows["values"]], CLEAN + 1)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, keep: list[str] = ("doc_id",), threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """``keep`` columns, untouched, and expected_grade, p_clean, selected (with ``prefix``) of every row."""
    rows = docs.select(F.col("text").alias(unused(docs.select(*keep), "text")[0]), *[docs[c] for c in keep])
    kept = rows.schema.fields[1:]
    grade_, tail_, chosen = (f"{prefix}{c}" for c in ("expected_grade", "p_clean", "selected"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = model[0][: 1 << BITS] != 0 if model else None
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for lo, hi in slices([len(t or "") for t in texts]):
                for ids, values in features(texts[lo:hi], only):
                    if model is None:
                        out.append((float(CLEAN), 1.0))
                        continue
                    tail = 1 / (1 + np.exp(np.clip(model[1] - float(model[0][ids] @ values), -40, 40)))  # P(grade > k) by k
                    out.append((float(tail.sum()), float(tail[-1])))
            columns = [*batch.columns[1:], pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], grade_, tail_])

    schema = T.StructType([*kept, T.StructField(grade_, T.DoubleType()), T.StructField(tail_, T.DoubleType())])
    return rows.mapInArrow(score, schema).withColumn(chosen, F.col(tail_) >= threshold)


def select_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that reach the clean grade with the given probability, all columns unchanged."""
    prefix = "by_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return score_documents(docs, train(docs, labels), docs.columns, threshold, prefix).where(f"{prefix}selected").select(*docs.columns)
