"""Incremental substring deduplication with a log-structured fingerprint index.

A window is ``words`` consecutive words.  Its fingerprint is the smallest hash
of its shingles of ``shingle`` words, so equal windows have equal fingerprints
and neighbouring windows mostly share one.  A maximal run of windows of one
fingerprint is a context; its fingerprint says where to look, and a 128-bit
digest of its words tells it from others.

The index is log-structured.  Every batch of documents adds one immutable run:
the contexts that no earlier run holds, each with its first place, in a table
of the shared folder that is bucketed and sorted by fingerprint.  A batch is
merge-joined with the runs, which tells the owner of every context that
repeats; the runs are merged into one when there are more than ``fanout``.  A
manifest beside the runs lists the current ones, so that an index can be opened
again for the next batch.

* A context that the index, or a smaller document of the batch, holds with the
  same digest is removed as a whole.
* Where different contexts share a fingerprint, their windows may still be
  equal.  These windows alone are read again from the texts, once per distinct
  context, and verified by 128-bit digests of their words; a window goes if a
  smaller document starts it too.

A passage that a third of all documents share costs each of them one row; it is
reduced before the shuffle, and where rows of it must meet their verdict,
Spark's adaptive execution splits its partition.

Defined results: null text has no words; a null doc_id counts as smaller than
any other; rows that repeat a doc_id never remove each other's words and each
get a row; documents under ``words`` words lose nothing; texts of any length
are read whole; equal windows inside one document stay; other columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_dir, stage
from .kernels import digests, doc_words, runs, signed, single_spaced, slices, sliding_min, window_hashes

WORDS, SHINGLE, FANOUT, BATCHES = 50, 10, 2, 3
PER_BUCKET = 1_000_000  # contexts of a run in one bucket
NO_ID = -(2**63)
PRINTS = "doc_id long, tkey long, fp array<long>, c1 array<long>, c2 array<long>, start array<int>, n array<int>"
RUN = "fp long, c1 long, c2 long, doc_id long, tkey long, start int, n int"
KEY = ["fp", "c1", "c2"]
PARTLY = "spark.sql.requireAllClusterKeysForCoPartition"  # false: tables bucketed by fp are joined as they lie


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, text: a repeated doc_id with another text stays a row of its own."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def fingerprints(docs: DataFrame, words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """The contexts of every document, as arrays."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf.text)
            for lo, hi in slices([len(t or "") for t in texts]):
                buf, begin, end, hashes, first = doc_words(single_spaced(texts[lo:hi]), lower=False)
                low = sliding_min(window_hashes(hashes, shingle, 2), words - shingle + 1)
                rows = []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:]), lo):
                    if b - a >= words:
                        own = low[a : b - words + 1]
                        start, n = runs(own)
                        c1, c2 = digests(buf[begin[a] : end[b - 1]], begin[a + start] - begin[a], end[a + start + n + words - 2] - begin[a])
                        rows.append((pdf.doc_id.iat[i], pdf.tkey.iat[i], signed(own[start]), c1, c2, start.astype(np.int32), n.astype(np.int32)))
                yield pd.DataFrame(rows, columns=["doc_id", "tkey", "fp", "c1", "c2", "start", "n"])

    return keyed(docs).mapInPandas(scan, PRINTS)


class SubstringIndex:
    """Immutable runs of contexts (``RUN``) in the folder ``root``, with a manifest of the current ones.

    ``add`` takes batches whose doc_ids are above all earlier ones.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.version, self.runs = spark, fanout, 0, []
        self.root = root or f"{scratch_dir(spark)}/isotrack-{uuid.uuid4().hex}/index"

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = FANOUT) -> SubstringIndex:
        """An index that an earlier session left in ``root``."""
        index = cls(spark, root, fanout)
        rows = spark.read.parquet(f"{root}/manifest").collect()  # one row for each run of each version
        index.version = max(r.version for r in rows)
        for name, buckets in sorted((r.run, r.buckets) for r in rows if r.version == index.version):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{root}/{name}'")
            index.runs.append((name, buckets))
        return index

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for name, _ in self.runs]

    def _write(self, rows: DataFrame, buckets: int, replaced: list) -> None:
        name = f"isotrack_run_{uuid.uuid4().hex}"
        rows.repartition(buckets, "fp").write.bucketBy(buckets, "fp").sortBy("fp").option("path", f"{self.root}/{name}").saveAsTable(name)
        self.runs = [r for r in self.runs if r not in replaced] + [(name, buckets)]
        self.version += 1
        listed = self.spark.createDataFrame([(self.version, n, b) for n, b in self.runs], "version int, run string, buckets int")
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        for old, _ in replaced:
            self.spark.sql(f"DROP TABLE {old}")

    def add(self, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch.  Gives spans (doc_id, tkey, start, n) of contexts of the batch that are removed as a
        whole, and contexts, of the batch or the index, that must be compared window by window."""
        rows = prints.select("doc_id", "tkey", F.inline(F.arrays_zip(*KEY, "start", "n")))
        place = F.struct("doc_id", "tkey", "start", "n")
        own = rows.groupBy(*KEY).agg(F.min(place).alias("first"), F.max("doc_id").alias("last"))
        before = self.spark.conf.get(PARTLY)
        self.spark.conf.set(PARTLY, "false")
        try:
            held = F.lit(None).cast("long")
            for i, run in enumerate(self.tables()):
                own = own.join(run.select(*KEY, F.col("doc_id").alias(f"owner{i}")).hint("merge"), KEY, "left")
                held = F.coalesce(held, F.col(f"owner{i}"))
            own = stage(own.select(*KEY, "first", "last", held.alias("owner")), "merged")
            forms = own.groupBy("fp").agg((F.count("*") - F.count("owner")).alias("forms"))
            for run in self.tables():
                own_forms = run.groupBy("fp").agg(F.count("*").alias("more")).hint("merge")
                forms = forms.join(own_forms, "fp", "left").select("fp", (F.col("forms") + F.coalesce("more", F.lit(0))).alias("forms"))
            mixed = stage(forms.where("forms > 1").select("fp", F.lit(True).alias("mixed")), "mixed")
        finally:
            self.spark.conf.set(PARTLY, before)
        known = own.join(mixed, "fp", "left").where("owner IS NOT NULL OR first.doc_id < last OR mixed")
        known = known.select(*KEY, F.coalesce("owner", "first.doc_id").alias("owner"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
        found = stage(rows.join(known, KEY).where("owner < doc_id OR mixed").select("doc_id", "tkey", "start", "n", (F.col("owner") < F.col("doc_id")).alias("whole")), "found")
        compare = found.where("not whole").drop("whole")
        for run in self.tables():
            compare = compare.unionByName(run.join(mixed, "fp", "left_semi").select("doc_id", "tkey", "start", "n"))
        compare = stage(compare, "compare")
        fresh = own.where("owner IS NULL").select(*KEY, "first.*")
        self._write(fresh, max(1, -(-fresh.count() // PER_BUCKET)), [])
        if len(self.runs) > self.fanout:
            self.compact()
        return found.where("whole").drop("whole"), compare

    def compact(self) -> None:
        """Merge all runs into one; the old ones leave the manifest, their files stay for readers of older versions."""
        merged = self.tables()[0]
        for run in self.tables()[1:]:
            merged = merged.unionByName(run)
        self._write(merged, sum(b for _, b in self.runs), self.runs)

    def close(self) -> None:
        """Take the runs out of the session's catalog; the index stays in its folder."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def verified_windows(docs: DataFrame, places: DataFrame, words: int = WORDS) -> DataFrame:
    """Spans (doc_id, tkey, start, n=1) of windows of ``places`` that a smaller document starts."""
    wanted = places.distinct().groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("places"))

    def window_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, tkey, text, places in zip(pdf.doc_id, pdf.tkey, pdf.text, pdf.places):
                said = text.encode("utf-8", "surrogatepass").split()
                ends = np.cumsum([len(w) + 1 for w in said])
                line, at, hashed = b" ".join(said), [], []
                for place in places:
                    for i in range(place["start"], place["start"] + place["n"]):
                        at.append(i)
                        hashed.append(hashlib.blake2b(line[(ends[i - 1] if i else 0) : ends[i + words - 1] - 1], digest_size=16).digest())
                w = np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"doc_id": doc, "tkey": tkey, "w1": w[:, 0], "w2": w[:, 1], "start": np.array(at, np.int32)})

    rows = stage(keyed(docs).join(wanted, ["doc_id", "tkey"]).mapInPandas(window_digests, "doc_id long, tkey long, w1 long, w2 long, start int"), "windows")
    first = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    return rows.join(first, ["w1", "w2"]).where("owner < doc_id").select("doc_id", "tkey", "start", F.lit(1).alias("n"))


def remove_spans(docs: DataFrame, spans: DataFrame, words: int = WORDS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row; a span covers ``n`` windows from ``start``."""
    per = spans.groupBy("doc_id", "tkey").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, starts, ns in zip(pdf.doc_id, pdf.text, pdf.starts, pdf.ns):
                said = (text or "").encode("utf-8", "surrogatepass").split()
                total = len(said)
                if starts is not None:
                    mark = np.zeros(total + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + ns + words - 1, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    said = [w for w, k in zip(said, keep) if k]
                line = b" ".join(said)
                text = (line.decode("utf-8", "surrogatepass"),) if with_text else ()
                rows.append((doc, total, total - len(said), hashlib.sha256(line).hexdigest(), *text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = keyed(docs).join(per, ["doc_id", "tkey"], "left").mapInPandas(cut, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def dedup_substrings(docs: DataFrame, words: int = WORDS, shingle: int = SHINGLE, batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """Deduplicate ``docs`` by adding them in ``batches`` ranges of doc_id to a new index."""
    prints = stage(fingerprints(docs, words, shingle), "prints")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(prints.approxQuantile("doc_id", shares, 0.01))) if shares else []
    index, spans, compare = SubstringIndex(docs.sparkSession), None, None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = prints if low is None else prints.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        whole, mixed = index.add(part)
        spans = whole if spans is None else spans.unionByName(whole)
        compare = mixed if compare is None else compare.unionByName(mixed)
    index.close()
    discard(prints)
    spans = spans.unionByName(stage(verified_windows(docs, compare, words), "verified"))
    return remove_spans(docs, spans, words, with_text)


def dedup_batch(index: SubstringIndex, docs: DataFrame, history: DataFrame, words: int = WORDS, shingle: int = SHINGLE, with_text: bool = True) -> DataFrame:
    """Add ``docs`` to an index of the documents in ``history``, all of smaller doc_ids; their rows as ``remove_spans`` gives them."""
    spans, compare = index.add(stage(fingerprints(docs, words, shingle), "prints"))
    read = history.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    spans = spans.unionByName(stage(verified_windows(read, compare, words), "verified"))
    return remove_spans(docs, spans, words, with_text)
