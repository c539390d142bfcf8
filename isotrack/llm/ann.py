"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are assigned to the lists of a coarse quantizer whose centroids are
fitted on at most ``SAMPLE`` vectors; every vector is indexed.  Vectors are
stored rotated by one random orthogonal matrix, in column blocks, so that the
distance over the first blocks is an unbiased estimate of the whole.  A query
probes its nearest lists.  In each list, candidates' partial distances grow
block by block; after each block a test abandons those whose estimate lies so
far above the tenth best distance that a smaller whole distance is implausible
(error bound ``EPSILON`` / sqrt(dimensions seen)).  Survivors' distances are
computed exactly on the original vectors, in double precision.

How many lists a query probes is set from the sample: the true neighbours of
``TRIALS`` of its vectors are looked up in the ranking of lists, and the number
is the least that reaches ``REACHED`` of them.  The whole table is denser than
the sample, its neighbours are nearer, so this errs on the side of recall.

A list is cut into parts of about ``PART`` vectors by a hash of the id, and
queries go to each part of the lists they probe, so a list that holds a third
of all vectors is scanned by many tasks; the queries of a list are cut into
blocks of about ``PART`` likewise.  A query whose lists hold fewer than k others
probes on until they do.  The number of lists grows with the
square root of the table up to ``MAX_LISTS``, which bounds the centroids that
tasks carry along.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller id;
repeated rows of an id are one query, that of the smallest vector, and
candidates once each for others and never for themselves; a null id takes no
part; columns besides the two named are not read; with fewer candidates than asked for, all are returned; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SAMPLE, MAX_LISTS, ROUNDS = 20_000, 4096, 8
TRIALS, REACHED = 256, 0.97  # sample queries, and the share of their neighbours that probing must reach
PART, COLUMNS, EPSILON = 4096, 16, 2.1
LISTED = "id long, vector array<double>, list int, part int"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_601).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd iterations; an empty list takes a random vector again."""
    rng = np.random.default_rng(7)
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_lists(sample, centers, 1)[:, 0]
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], sample[rng.integers(len(sample), size=lists)])
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    out = np.empty((len(x), probes), np.int64)
    for lo in range(0, len(x), 1024):
        d = (centers**2).sum(1) - 2 * x[lo : lo + 1024] @ centers.T
        near = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(centers) else np.tile(np.arange(probes), (len(d), 1))
        out[lo : lo + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def probes_needed(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    asked = sample[:TRIALS]
    order = nearest_lists(asked, centers, len(centers))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centers))[None, :].repeat(len(asked), 0), 1)
    own = nearest_lists(sample, centers, 1)[:, 0]
    apart = (sample**2).sum(1) - 2 * asked @ sample.T
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centers)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return int(np.quantile(np.take_along_axis(rank, own[near], 1), REACHED)) + 1


def scan(query: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, turned: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one part: ids and exact distances, by (distance, id)."""
    dim, alive, partial = rotated.shape[1], np.flatnonzero(ids != own), None
    partial, bound = np.zeros(len(alive)), None
    for lo in range(0, dim, COLUMNS):
        hi = min(lo + COLUMNS, dim)
        step = rotated[alive, lo:hi] - turned[lo:hi]
        partial = partial + np.einsum("ij,ij->i", step, step)
        if len(alive) <= k or hi == dim:
            continue
        if bound is None or lo // COLUMNS % 2 == 0:  # the whole distances of the k most promising give the distance to beat
            first = alive[np.argpartition(partial, k - 1)[:k]]
            reach = ((rotated[first] - turned) ** 2).sum(1).max()
            if bound is None or reach < bound:
                bound, sure = reach, np.isin(np.arange(len(ids)), first)  # these k stay, so no part gives fewer than it could
        keep = sure[alive] | (partial * dim / hi <= bound * (1 + EPSILON / np.sqrt(hi)) ** 2 + 1e-12)
        alive, partial = alive[keep], partial[keep]
    exact = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
    best = np.lexsort((ids[alive], exact))[:k]
    return ids[alive[best]], exact[best]


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``is_query`` marks."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"), is_query.alias("is_query"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    shape = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, total = (shape["dim"], shape["count"]) if shape else (1, 0)
    rows = rows.where(F.size("vector") == dim)
    lists = max(1, min(MAX_LISTS, int(total**0.5 / 2), total // 8))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * lists)).select("vector").toPandas()
    fitted = np.stack(sample.vector) if total else np.zeros((1, dim))
    centers = centroids(fitted, lists)
    probes = min(lists, probes_needed(fitted, centers, k))
    sizes = np.zeros(lists, np.int64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = nearest_lists(np.stack(pdf.vector), centers, 1)[:, 0]
                yield pd.DataFrame({"id": pdf.id, "vector": pdf.vector, "list": near, "part": 0})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors, asks, lists_of, own = np.stack(pdf.vector), [], [], pdf.part.to_numpy()
                near = nearest_lists(vectors, centers, probes)
                for i in range(len(pdf)):
                    row = near[i]
                    if sizes[row].sum() < k + own[i]:
                        row = nearest_lists(vectors[i : i + 1], centers, lists)[0]
                        row = row[: max(probes, int(np.searchsorted(np.cumsum(sizes[row]), k + own[i])) + 1)]
                    asks += [i] * len(row)
                    lists_of.append(row)
                yield pd.DataFrame({"id": pdf.id.to_numpy()[asks], "vector": [pdf.vector.iat[i] for i in asks], "list": np.concatenate(lists_of), "part": 0})

    listed = stage(rows.select("id", "vector").mapInPandas(assign, LISTED), "listed").drop("part")
    counts = stage(listed.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")  # one row per list, at most MAX_LISTS
    for row in counts.collect():
        sizes[row["list"]] = row["n"]
    queries = rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    copies = rows.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").cast("int").alias("part"))  # rows that a query may not find
    asked = stage(queries.join(copies, "id").select("id", "vector", F.lit(0).alias("list"), "part").mapInPandas(probe, LISTED).drop("part"), "asked")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    parts = stage(counts.join(blocks, "list", "left").select("list", "parts", F.coalesce("blocks", F.lit(0)).alias("blocks")), "blocks")
    listed = listed.join(F.broadcast(parts.where("blocks > 0")), "list").selectExpr("id", "vector", "list", "cast(pmod(xxhash64(id), parts) as int) AS part", "explode(sequence(0, blocks - 1)) AS block")
    asked = asked.join(F.broadcast(parts), "list").selectExpr("id", "vector", "list", "cast(pmod(xxhash64(id), blocks) as int) AS block", "explode(sequence(0, parts - 1)) AS part")
    turn = rotation(dim)

    def scan_part(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        vectors, ids = np.stack(held.vector), held.id.to_numpy()
        rotated, out = vectors @ turn, []
        for q, v in zip(queries.id, queries.vector):
            found, score = scan(v, vectors, rotated, v @ turn, ids, q, k)
            out.append((np.full(len(found), q), found, score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = listed.groupBy("list", "part", "block").cogroup(asked.groupBy("list", "part", "block")).applyInPandas(scan_part, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
