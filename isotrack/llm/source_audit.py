"""How far the sources of a language differ in their words, and by which.

Texts of a batch are one buffer of UTF-8.  A table of 256 bytes lower-cases A-Z
and clears what is no letter, so places where it turns to and from zero are the
boundaries of terms.  xxhash groups the slices between them; every slice is then
compared byte by byte with the first of its group, and those that differ form
groups of their own.  Only counts leave a batch: one row a language, source and
term, summed over a task's batches before the shuffle and by Spark behind it, so a
hot source or term is as many rows as there are tasks.

Terms in enough documents of a language are kept.  Their counts, dealt by term,
are CSR matrices of source by term.  For a source, its shares, laid out over
the matrix's terms, meet all cells of all sources at once, and ``reduceat`` sums the
divergences by source; terms that one or both lack need a share that only
depends on the source, so they enter as numbers of terms.  The sums over
matrices are added up by Spark.  Terms of a source are ranked behind a limit
that Spark applies before the shuffle.

Shares are ``1 + floor(10^9 (count + 1) / (N + V))``; divergences are
``floor((p - q)^2 / q)``; all in integers.

Defined results: null text, language and source are empty strings; a group
without terms has counts of 0; repeated rows are separate documents; ties of
value go by the term's or source's UTF-8; a text of any length is read whole,
in slices cut between terms; other columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import gathered, runs, utf8
from .common import stage

MIN_DOCS, TOP = 3, 200
UNIT = 1_000_000_000
SLICE = 16_000_000  # bytes that are grouped at once
HASHED, PENDING = 200_000, 2_000_000  # slices hashed in one go; rows of counts held before they are summed
CELLS = 20_000  # of a matrix, on average; more where a language has more pairs of sources
COUNTED = "lang string, source string, term binary, n long, docs long"
PAIRED = "lang string, source string, item string, value long"

#: What each byte becomes: lower-cased letters and bytes outside ASCII stay, all else ends a term.
TABLE = np.array([b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], np.uint8)


def boundaries(body: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded buffer, and where its terms begin and end; none crosses a place."""
    folded = TABLE[body]
    inside = np.concatenate([[False], folded > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = turns[::2], turns[1::2]
    cuts = np.unique(places[1:-1])
    at = np.searchsorted(begins, cuts, "left") - 1
    cuts = cuts[(at >= 0) & (begins[np.maximum(at, 0)] < cuts) & (cuts < ends[np.maximum(at, 0)])] if len(begins) else cuts[:0]
    return folded, np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))


def grouped(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms."""
    from xxhash import xxh3_64_intdigest

    raw, lengths = folded.tobytes(), ends - begins
    hashes = np.empty(len(begins), np.uint64)
    for k in range(0, len(begins), HASHED):
        hashes[k : k + HASHED] = [xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins[k : k + HASHED].tolist(), ends[k : k + HASHED].tolist())]
    which, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    terms = [raw[begins[i] : ends[i]] for i in first.tolist()]
    other = lengths != lengths[first[which]]
    same = np.flatnonzero(~other)
    for low, high in runs(np.concatenate([[0], np.cumsum(lengths[same])])):
        part = same[low:high]
        differ = folded[gathered(begins[part], lengths[part])] != folded[gathered(begins[first[which[part]]], lengths[part])]
        if differ.any():
            other[part] = np.add.reduceat(differ, np.cumsum(lengths[part]) - lengths[part]) > 0
    if other.any():  # slices of one hash and different bytes
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(other).tolist():
            term = raw[begins[i] : ends[i]]
            if term not in known:
                known[term] = len(terms)
                terms.append(term)
            which[i] = known[term]
    return which, terms


def counted(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, count, documents) of the slices; ``doc`` names each slice's document, ``group`` each document's group."""
    which, terms = grouped(folded, begins, ends)
    key, n = np.unique(doc * len(terms) + which, return_counts=True)
    cell = group[key // len(terms)] * len(terms) + key % len(terms)
    cell, at = np.unique(cell, return_inverse=True)
    count = np.bincount(at, n, len(cell)).astype(np.int64)
    return cell // len(terms), [terms[i] for i in (cell % len(terms)).tolist()], count, np.bincount(at, minlength=len(cell))


def pieces_of(body: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges of one long document that end between terms, of about a slice each."""
    while low < high:
        stop = min(low + SLICE, high)
        while stop < high:
            gap = np.flatnonzero(TABLE[body[stop : stop + 65_536]] == 0)
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + 65_536, high)
        yield low, stop
        low = stop


def summed(parts: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(parts)
    if len(parts) == 1:
        return table
    table = table.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns(["n" if c == "n_sum" else "docs" if c == "docs_sum" else c for c in table.column_names]).select(["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a group's row of an empty term says that it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for part in parts_of(batches):
            pending.append(part)
            if sum(p.num_rows for p in pending) > PENDING:
                pending = summed(pending).to_batches()
                if sum(p.num_rows for p in pending) > PENDING // 2:  # few repeats: holding more would not help
                    yield from pending
                    pending = []
        if pending:
            yield from summed(pending).to_batches()

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, places = utf8(batch["text"])
            names = pd.MultiIndex.from_arrays([batch["lang"].to_pylist(), batch["source"].to_pylist()])
            group, groups = pd.factorize(names)
            lang, source = ([g[k] for g in groups] for k in (0, 1))

            def rows(group, term, n, docs, lang=lang, source=source):
                at = group.tolist()
                columns = [pa.array([lang[i] for i in at], pa.string()), pa.array([source[i] for i in at], pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

            n = len(groups)
            yield rows(np.arange(n), [b""] * n, np.zeros(n, np.int64), np.bincount(group, minlength=n))
            for low, high in runs(places):
                begin, end = int(places[low]), int(places[high])
                if end - begin <= SLICE:
                    folded, begins, ends = boundaries(body[begin:end], places[low : high + 1] - begin)
                    doc = np.searchsorted(places[low : high + 1] - begin, begins, "right") - 1
                    if len(begins):
                        yield rows(*counted(folded, begins, ends, doc, group[low:high]))
                    continue
                seen: set[bytes] = set()  # a document's terms, each counted once among its documents
                for a, b in pieces_of(body, begin, end):
                    folded, begins, ends = boundaries(body[a:b], np.array([0, b - a]))
                    if len(begins):
                        at, term, count, _ = counted(folded, begins, ends, np.zeros(len(begins), np.int64), group[low:high])
                        yield rows(at, term, count, np.array([t not in seen for t in term], np.int64))
                        seen.update(term)

    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")]
    found = docs.select(*columns).mapInArrow(run, COUNTED)
    # dealt by what both this sum and the one over sources need, so that one shuffle serves both
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / total)``, by long division in steps of a thousand, which int64 holds up to totals of 10^15."""
    rest, out = np.asarray(count, np.int64) + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    whole, rest = np.divmod(rest, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + whole * UNIT + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Divergences of all pairs of sources over the terms of one matrix: cells (source, term, n), groups (source, total)."""
    groups = groups.sort_values("source", ignore_index=True)
    names, total = groups["source"].tolist(), groups["total"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(names)}
    row = cells["source"].map(place).to_numpy(np.int64)
    column, terms = pd.factorize(cells["term"])
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order].astype(np.int64), cells["n"].to_numpy(np.int64)[order]
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    share, none = shares(n, total[row]), shares(np.zeros(len(names), np.int64), total)
    held, filled = np.diff(indptr), np.flatnonzero(np.diff(indptr))

    def by_source(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        if len(values):
            out[filled] = np.add.reduceat(values, indptr[filled])
        return out

    out = []
    for g in range(len(names)):
        own = slice(indptr[g], indptr[g + 1])
        has, p = np.zeros(len(terms), bool), np.full(len(terms), none[g])
        has[column[own]], p[column[own]] = True, share[own]
        met, at = has[column], p[column]
        value = by_source(divergence(at, share))  # terms that the other source has
        kinds, many = np.unique(share[own], return_counts=True)
        mine = (divergence(kinds[:, None], none[None, :]) * many[:, None]).sum(0)  # all of the own terms, as if the other lacked them
        value += mine - by_source(np.where(met, divergence(at, none[row]), 0))  # without those that it has
        both = by_source(met.astype(np.int64))
        value += (len(terms) - held[g] - held + both) * divergence(none[g], none)
        out.append(pd.DataFrame({"source": names[g], "item": names, "value": value}).drop(index=g))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that each has more often than its language."""
    one = Window.partitionBy("lang", "term")  # as many rows as there are sources
    counts = count_terms(docs).select("*", *[F.sum(c).over(one).alias(f"all_{c}") for c in ("n", "docs")], F.row_number().over(one.orderBy("source")).alias("nth"))
    counts = counts.where((F.col("all_docs") >= min_docs) | (F.length("term") == 0))
    counts = stage(counts.select("lang", "source", "term", "n", "all_n", (F.col("nth") == 1).cast("long").alias("new")), "counts")
    cells = counts.where(F.length("term") > 0)
    sizes = cells.groupBy("lang").agg(F.sum("new").alias("terms"), F.sum("n").alias("lang_n"))
    per = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where(F.length("term") == 0).select("lang", "source").join(per, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["group_n", "terms", "lang_n"])
    groups = stage(groups.select("lang", "source", (F.col("group_n") + F.col("terms")).alias("total"), (F.col("lang_n") + F.col("terms")).alias("lang_total")), "groups")

    share = lambda n, total: F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20, 0)) * {UNIT}) DIV {total}")
    terms = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("all_n", "lang_total")).where("p > q")
    value = F.expr("((p - q) * (p - q)) DIV q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-cells.count() // max(CELLS, most * most)))
    dealt = cells.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("chunk"))
    sides = groups.select("lang", "source", "total", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("chunk"))
    sides = sides.join(dealt.select("lang", "chunk").distinct(), ["lang", "chunk"], "left_semi")

    def pairs(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        return pair_sums(cells, groups).assign(lang=groups["lang"].iloc[0])[["lang", "source", "item", "value"]]

    sums = dealt.groupBy("lang", "chunk").cogroup(sides.groupBy("lang", "chunk")).applyInPandas(pairs, PAIRED)
    other = groups.select("lang", F.col("source").alias("item"))
    every = groups.select("lang", "source").join(other, "lang").where("source <> item")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(order)).unionByName(terms)
