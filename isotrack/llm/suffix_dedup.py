"""Suffix-array dedup: repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Bytes covered by a string of ``length`` bytes that a smaller document starts
too are removed.  Equal strings must meet in one task, whatever documents they
stand in.  Each string is therefore filed under its anchor, the smallest hash
of its ``gram``-byte substrings; neighbouring strings mostly have one anchor in
common and form a context.

Texts that are equal as a whole are represented by the smallest document; all
the others' strings start there too.  For the rest:

1. Chunks of documents list their anchors, 38 bits each, as sorted and packed
   differences, dealt out by value; each value's task answers which of them
   occur in more than one document.  Only contexts of such anchors go on.
2. A context that a smaller document holds too is removed as a whole.
3. Different contexts of one anchor are dealt to shards, once each.  A shard
   builds the suffix array and Burrows-Wheeler transform of its contexts.  In
   it, intervals of suffixes are extended backward by one byte, all of a length
   at a time: a border between neighbouring suffixes of common prefix l follows
   from the borders of l - 1 between the occurrences of the byte before.
   Values of the common prefixes thus come in increasing order, and expansion
   stops at ``length``: suffixes with no border between them by then share that
   many bytes.  The smallest document of such an interval keeps its string.

Anchors of more than ``HOT`` different contexts are cut again, by longer grams,
before they are dealt to shards, so a string that a third of all documents go
on from in their own ways is spread out too.  Where even a longer gram has more,
the strings are filed one by one and reduced by digest, whole all the same.

Whole copies are equal by SHA-256, contexts by a 128-bit digest of their bytes;
anchors only say where to look.

Defined results: null text is empty; null doc_ids are smaller than any other;
rows that repeat a doc_id never remove each other's bytes and each get a row;
equal strings inside one document stay; documents under ``length`` bytes lose
nothing; texts of any length are read whole; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .kernels import U, byte_table, distinct, powers, runs, signed, slices, sliding_min

LENGTH, GRAM, HOT_GRAM = 50, 20, 40
CHUNK, BUCKET, SHARD = 4 << 20, 16 << 20, 3 << 14  # bytes of text, of text again, of contexts
SLICE = 1 << 17  # bytes of text that are hashed at a time, which fit the caches
HOT = 5_000
STRINGS = 1 << 17  # strings that are filed one by one, at a time
NO_ID = -(2**63)
LISTS = "bucket long, chunk int, packed binary, local binary"
ANSWERS = "chunk int, bucket long, shared binary, doc_id long, tkey long"
DOCS = "doc_id long, tkey long, n_bytes long, copy boolean, sha string, packed binary, fp array<long>, c1 array<long>, c2 array<long>, start array<int>, n array<int>"
SPANS = "doc_id long, tkey long, start int, n int"


def contexts_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of a list of texts: text number, anchor, first string, number of strings."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    none = tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64))
    if len(buf) < length:
        return none
    up, down = powers(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(byte_table(False)[buf] * up, out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1]
    grams = (grams ^ (grams >> U(32))) * U(0xBF58476D1CE4E5B9)
    anchor = sliding_min(grams ^ (grams >> U(29)), length - gram + 1)
    edges = np.zeros(len(buf) + 1, np.int8)  # strings that cross no border lie between
    long = sizes >= length
    edges[(end - sizes)[long]] += 1
    edges[(end - length + 1)[long]] -= 1
    whole = np.cumsum(edges, dtype=np.int8)[: len(anchor)] > 0
    same = np.zeros(len(anchor), bool)
    same[1:] = whole[1:] & whole[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(whole & ~same)
    if not len(first):
        return none
    count = np.add.reduceat(whole, first, dtype=np.int64)
    doc = np.searchsorted(end, first, "right")
    return doc, anchor[first], first - (end - sizes)[doc], count


def sliced(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``contexts_of`` by slices, which bounds the memory."""
    parts = []
    for lo, hi in slices([len(t) for t in texts], SLICE):
        doc, *rest = contexts_of(texts[lo:hi], length, gram)
        parts.append((doc + lo, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else contexts_of([], length, gram)


def names_of(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of the bytes of each context, as two arrays."""
    joined = b"".join([hashlib.blake2b(texts[d][s : s + n], digest_size=16).digest() for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist())])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as byte planes of their differences, compressed."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def short(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit value of anchors."""
    return ((anchors >> U(32)) % U(buckets)).astype(np.int64), (anchors & U(0xFFFFFFFF)).astype(np.uint32)


def shared_contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document: size, digest, and its contexts of anchors that several documents have, with the compressed text."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    brief = stage(rows.select("doc_id", "tkey", F.length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest")), "brief")
    total = brief.agg(F.sum("size")).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK)), max(1, -(-total // BUCKET))
    in_chunk = F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(chunks)).cast("int")
    rows, brief = rows.withColumn("chunk", in_chunk), brief.withColumn("chunk", in_chunk)
    first = brief.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    copies = stage(brief.join(first, "digest").where("owner < doc_id").select("chunk", "doc_id", "tkey").distinct(), "copies")

    def without(pdf: pd.DataFrame, drop: pd.DataFrame) -> pd.DataFrame:
        """The documents in order, with a mark on whole copies."""
        known = set(zip(drop.doc_id, drop.tkey))
        pdf = pdf.sort_values(["doc_id", "tkey"])
        return pdf.assign(copy=[(d, t) in known for d, t in zip(pdf.doc_id, pdf.tkey)])

    def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        found = sliced(texts, length, gram)
        bucket, value = short(found[1], buckets)
        return bucket, value, (bucket.astype(U) << U(32)) | value.astype(U), found

    def list_anchors(pdf: pd.DataFrame, drop: pd.DataFrame) -> pd.DataFrame:
        pdf = without(pdf, drop)
        pdf = pdf[~pdf["copy"]]
        _, _, key, found = anchors_of(list(pdf.text))
        doc = pdf.doc_id.to_numpy()[found[0]]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1
        local, key = doc[first] != doc[last], key[first]
        begin, size = runs(key >> U(32))
        out = [(int(key[x] >> U(32)), pdf.chunk.iloc[0], pack(key[x : x + n].astype(np.uint32)), np.packbits(local[x : x + n]).tobytes()) for x, n in zip(begin, size)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "packed", "local"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack(p) for p in pdf.packed]
        values = np.sort(np.concatenate(lists))
        repeated = distinct(values[1:][values[1:] == values[:-1]])
        out = []
        for chunk, held, local in zip(pdf.chunk, lists, pdf.local):
            at = np.searchsorted(repeated, held)
            hit = repeated[np.minimum(at, len(repeated) - 1)] == held if len(repeated) else np.zeros(len(held), bool)
            out.append((chunk, pdf.bucket.iloc[0], np.packbits(hit | np.unpackbits(np.frombuffer(local, np.uint8), count=len(held)).astype(bool)).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "shared"]).assign(doc_id=0, tkey=0)

    def keep_shared(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told = answers.bucket < 0
        pdf, answers = without(pdf, answers[told]), answers[~told]
        texts = [b"" if c else t for c, t in zip(pdf["copy"], pdf.text)]
        bucket, _, key, (doc, anchor, start, count) = anchors_of(texts)
        listed = distinct(key)
        flags = np.zeros(len(listed), bool)
        begin, size = runs(listed >> U(32))
        cut = {int(listed[x] >> U(32)): (x, x + n) for x, n in zip(begin, size)}
        for b, bits in zip(answers.bucket, answers.shared):
            x, y = cut[b]
            flags[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        keep = flags[np.searchsorted(listed, key)]
        doc, anchor, start, count = (x[keep] for x in (doc, anchor, start, count))
        c1, c2 = names_of(texts, doc, start, count + length - 1)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        squeeze, out = zstandard.ZstdCompressor(level=1), []
        for i, (d, t, copy, text) in enumerate(zip(pdf.doc_id, pdf.tkey, pdf["copy"], pdf.text)):
            x, y = at[i], at[i + 1]
            held = (squeeze.compress(text), signed(anchor[x:y]), c1[x:y], c2[x:y], start[x:y].astype(np.int32), count[x:y].astype(np.int32)) if y > x else (None,) * 6
            gone = copy and len(text) >= length
            out.append((d, t, len(text), gone, hashlib.sha256(b"" if gone else text).hexdigest(), *held))
        return pd.DataFrame(out, columns=["doc_id", "tkey", "n_bytes", "copy", "sha", "packed", "fp", "c1", "c2", "start", "n"])

    answers = rows.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInPandas(list_anchors, LISTS).groupBy("bucket").applyInPandas(answer, ANSWERS)
    answers = answers.unionByName(copies.select("chunk", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("shared"), "doc_id", "tkey"))
    return stage(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(keep_shared, DOCS), "chunked")


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix ends at its context's separator, ties go by position."""
    n = len(text)
    place = np.arange(n, dtype=np.int64)
    room = ends - place  # symbols before the separator
    longest = int(room.max()) + 1
    key = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    for width in (1, 2, 4):  # eight symbols, a byte each
        key = (key[:-width] << U(8 * width)) | key[width:]
    beyond = np.array([0, *[(2 ** (8 * r) - 1) << (64 - 8 * r) for r in range(1, 9)]], U)
    key, have = key[:n] & beyond[np.minimum(room, 8)], 8  # nothing beyond the separator
    while True:
        order = np.argsort(key)
        ranked = key[order]
        number = np.zeros(n, np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=number[1:])
        if number[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = number
        if have >= longest:
            return np.argsort(rank * n + place)
        after = np.zeros(n, np.int64)
        after[: n - have] = (rank[have:] + 1) * (room[: n - have] >= have)
        key, have = rank * (n + 1) + after, 2 * have
        if have >= longest and n < 1 << 20:
            return np.argsort(key * n + place)


def common_intervals(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Borders in the suffix array: True where a suffix shares fewer than ``length`` symbols with the one before."""
    before = text[order - 1]  # the Burrows-Wheeler transform; the text begins after a separator
    follow = np.argsort(before, kind="stable")  # place of the suffix that is one symbol shorter, by place
    first = text[order]
    border = first == 0  # separators are all different
    border[0] = True
    border[1:] |= first[1:] != first[:-1]
    open_ = np.flatnonzero(~border)
    here, there = follow.take(open_), follow.take(open_ - 1)
    single = here - there == 1  # one place lies between: its own border decides
    wide = np.flatnonzero(~single)
    wide, low, high = open_.take(wide), there.take(wide), here.take(wide)
    single = np.flatnonzero(single)
    narrow, at = open_.take(single), here.take(single)
    for _ in range(1, length):
        hit = border.take(at)
        found = np.flatnonzero(hit)
        far = found[:0]
        if len(wide):
            borders = np.cumsum(border.astype(np.int32), dtype=np.int32)
            far = np.flatnonzero(borders.take(high) != borders.take(low))
        if not len(found) and not len(far):  # a longer common prefix would need one that is shorter by one
            break
        left, right = ~hit, np.ones(len(wide), bool)
        right[far] = False
        border[narrow.take(found)] = True
        border[wide.take(far)] = True
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        narrow, at = narrow.take(left), at.take(left)
        wide, low, high = wide.take(right), low.take(right), high.take(right)
    return border


def compare_shard(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the strings of a shard's contexts that a smaller document starts."""
    raw = list(pdf.text)
    sizes = np.array([len(r) + 1 for r in raw])
    text = np.frombuffer(b"\x00".join([*raw, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    last = np.cumsum(sizes) - 1
    text[last] = 0
    order = suffix_order(text, np.repeat(last, sizes))
    border = common_intervals(text, order, length)
    context = np.repeat(np.arange(len(raw)), sizes)
    doc = pdf.doc_id.to_numpy(np.int64)[context]
    begin = np.flatnonzero(border)
    least = np.minimum.reduceat(doc[order], begin)
    gone = np.zeros(len(text), bool)
    gone[order] = doc[order] > np.repeat(least, np.diff(np.append(begin, len(order))))
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    c = context[s]
    offset = s - (last - sizes + 1)[c]
    return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[c], "tkey": pdf.tkey.to_numpy()[c], "start": (pdf.start.to_numpy()[c] + offset).astype(np.int32), "n": (e - s).astype(np.int32)})


def expand_shards(chunked: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, tkey, start, n strings) from the transform of all contexts that must be compared."""
    wanted = found.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n", "fp", "hot")).alias("places"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, again = [], []
            for doc, tkey, packed, places in zip(pdf.doc_id, pdf.tkey, pdf.packed, pdf.places):
                whole = zstandard.ZstdDecompressor().decompress(packed)
                for p in places:
                    to = again if p["hot"] else out
                    to.append((doc, tkey, p["start"], p["fp"], whole[p["start"] : p["start"] + p["n"] + length - 1]))
            of, anchors, starts, counts = sliced([x[-1] for x in again], length, HOT_GRAM)
            for i, a, s, n in zip(of.tolist(), signed(anchors).tolist(), starts.tolist(), counts.tolist()):
                doc, tkey, start, _, text = again[i]
                out.append((doc, tkey, start + s, a, text[s : s + n + length - 1]))
            yield pd.DataFrame(out, columns=["doc_id", "tkey", "start", "fp", "text"])

    rows = chunked.select("doc_id", "tkey", "packed").join(wanted, ["doc_id", "tkey"])
    rows = stage(rows.mapInPandas(extract, "doc_id long, tkey long, start int, fp long, text binary"), "contexts")
    anchors = rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("contexts")).where("lo <> hi")
    rows = stage(rows.join(anchors.select("fp", (F.col("contexts") > HOT).alias("hot")), "fp"), "compared")
    total = rows.where("not hot").agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    dealt = rows.where("not hot").withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int"))
    found = dealt.groupBy("shard").applyInPandas(lambda pdf: compare_shard(pdf, length), SPANS)
    return found.unionByName(compare_strings(rows.where("hot"), length))


def compare_strings(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the strings, filed one by one by a 128-bit digest, that a smaller document starts: for
    anchors whose contexts would still make too large a transform.  An anchor's contexts are dealt out, as
    they lie together; many are cut at a time."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, count = list(pdf.text), np.array([len(t) - length + 1 for t in pdf.text], np.int64)
            ids, keys, first = (pdf[c].to_numpy() for c in ("doc_id", "tkey", "start"))
            for lo, hi in slices(count.tolist(), STRINGS):
                n = count[lo:hi]
                d = np.frombuffer(b"".join([hashlib.blake2b(t[i : i + length], digest_size=16).digest() for t in texts[lo:hi] for i in range(len(t) - length + 1)]), np.int64).reshape(-1, 2)
                start = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(len(d))
                yield pd.DataFrame({"doc_id": np.repeat(ids[lo:hi], n), "tkey": np.repeat(keys[lo:hi], n), "start": start.astype(np.int32), "d1": d[:, 0], "d2": d[:, 1]})

    dealt = rows.select("doc_id", "tkey", "start", "text").repartition("doc_id", "tkey", "start")
    strings = dealt.mapInPandas(cut, "doc_id long, tkey long, start int, d1 long, d2 long")
    strings = stage(strings, "strings")
    first = strings.groupBy("d1", "d2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    return strings.join(first, ["d1", "d2"]).where("owner < doc_id").select("doc_id", "tkey", "start", F.lit(1).alias("n"))


def remove_spans(chunked: DataFrame, spans: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Every document's row; a span covers ``n`` strings from ``start``."""
    per = spans.groupBy("doc_id", "tkey").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, size, copy, sha, packed, starts, ns in zip(pdf.doc_id, pdf.n_bytes, pdf["copy"], pdf.sha, pdf.packed, pdf.starts, pdf.ns):
                if starts is None:
                    out.append((doc, size, size * copy, int(copy), sha, *((b"" if copy else None,) if with_text else ())))
                    continue
                text = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
                mark = np.zeros(size + 1, np.int64)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + ns + length - 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                kept = text[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, size, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    rows = chunked.select("doc_id", "tkey", "n_bytes", "copy", "sha", "packed").join(per, ["doc_id", "tkey"], "left")
    return rows.mapInPandas(cut, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds the remaining
    bytes (``kept``) of documents that lose some."""
    chunked = shared_contexts(docs, length, gram)
    rows = chunked.select("doc_id", "tkey", F.inline(F.arrays_zip("fp", "c1", "c2", "start", "n")))
    contexts = rows.groupBy("fp", "c1", "c2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    forms = contexts.groupBy("fp").agg(F.count("*").alias("forms"))
    known = contexts.join(forms, "fp").where("owner < last OR forms > 1").select("fp", "c1", "c2", "owner", "forms")
    found = rows.join(stage(known, "known"), ["fp", "c1", "c2"]).withColumn("whole", F.col("owner") < F.col("doc_id"))
    found = stage(found.where("whole OR forms > 1").select("doc_id", "tkey", "start", "n", "fp", "whole", (F.col("forms") > HOT).alias("hot")), "found")
    spans = stage(expand_shards(chunked, found.where("not whole"), length), "expanded")
    spans = spans.unionByName(found.where("whole").select("doc_id", "tkey", "start", "n"))
    return remove_spans(chunked, spans, length, with_text)
