"""Best-fit packing of tokenized documents by linear grouping.

Every document is tokenized in tasks and ends in token 0; one longer than a
sequence is cut, its first piece taking what does not fill whole sequences.
What must be decided centrally depends on lengths alone, and there are at most
as many of these as a sequence has tokens: the histogram of piece lengths is
all that the driver sees, whatever the corpus size.

* Large lengths are sorted, cut into groups of equal cardinality and rounded up
  to the largest of their group, which leaves a few sizes.
* A linear program over configurations of those sizes, solved by column
  generation with a knapsack, gives how often to use each configuration.
* Actual lengths replace the rounded ones.  Pieces that rounding down the
  solution leaves over, and the small ones, go longest first to the sequence
  with the least room that holds them.

The plan lists ranges: pieces of one length, by rank, go to consecutive
sequences.  Each piece gets its rank among those of its length by a prefix sum
over hash buckets, and finds its sequence in the range of the plan.

Defined results: null text is empty and becomes the single token 0; a null
doc_id stays null; repeated rows are packed as often as they occur; pieces of
one length are interchangeable, ties go by a hash of document and piece; long
texts are tokenized whole; other columns, whatever their names, are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, with_prefix

LENGTH = 2048
GROUPS = 24
SMALL = 1 / 8  # of a sequence: shorter pieces are small
NO_ID = -(2**63)  # stands for a null doc_id inside tasks
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(file: str):
    """A function from text to token ids of the byte-level vocabulary whose file reads ``file``.

    The vocabulary file names tokens in printable characters, one for each
    byte; ranks of the same tokens as bytes drive the encoder, which gives the
    ids of the file's own library, those of added tokens that stand in a text
    included (tests hold them against each other).
    """
    import json

    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    model = json.loads(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(token in text for token in special):
            return own.encode(text, allowed_special="all")
        return own.encode_ordinary(text)

    return encode


_ENCODERS: dict = {}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the driver's file ``tokenizer`` is shipped to the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = zlib.crc32(shipped.value.encode())
        encode = _ENCODERS.get(name) or _ENCODERS.setdefault(name, encoder(shipped.value))
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = np.array([*encode(text or ""), 0], "<u4")
                first = len(ids) % length or length
                for k, start in enumerate([0, *range(first, len(ids), length)]):
                    part = ids[start : first if not k else start + length]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInPandas(cut, PIECES).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def configurations(sizes: list[int], demand: list[int], length: int) -> list[tuple[np.ndarray, float]]:
    """Basic solution of the linear program: configurations (pieces per size) and how often to use each."""
    k = len(sizes)
    s, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(length // s).astype(float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        use, price = inverse @ need, np.ones(k) @ inverse
        best, pick = np.zeros(length + 1), np.full(length + 1, -1)
        for j in range(k):  # unbounded knapsack, vectorised over rooms of the same remainder
            for room in range(int(s[j]), length + 1):
                if best[room - s[j]] + price[j] > best[room] + 1e-12:
                    best[room], pick[room] = best[room - s[j]] + price[j], j
        if best[length] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), length
        while room > 0 and pick[room] >= 0:
            column[pick[room]] += 1
            room -= s[pick[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return [(basis[:, i].round().astype(int), float(u)) for i, u in enumerate(np.linalg.inv(basis) @ need) if u > 0.5]


def plan(histogram: dict[int, int], length: int = LENGTH, groups: int = GROUPS) -> list[tuple[int, int, int, int]]:
    """Ranges (piece length, first rank, first sequence, count): ranks and sequences run in step."""
    out: list[tuple[int, int, int, int]] = []
    given: dict[int, int] = defaultdict(int)  # ranks already placed, by length
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> ranges of sequences (first, count)
    made = histogram.get(length, 0)
    if made:
        out.append((length, 0, 0, made))
        given[length] = made
    large = sorted(n for n, count in histogram.items() if count and SMALL * length <= n < length)
    total = sum(histogram[n] for n in large)

    def place(n: int, first: int, count: int) -> None:
        out.append((n, given[n], first, count))
        given[n] += count

    if total:
        # groups of ``each`` pieces; a frequent length can fill several, which then have one size and count as one
        each, members, lists = -(-total // groups), 0, [[]]
        for n in large:
            todo = histogram[n]
            while todo:
                if members == each:
                    if lists[-1][-1][0] != n:
                        lists.append([])
                    members = 0
                take = min(todo, each - members)
                lists[-1].append([n, take])
                members, todo = members + take, todo - take
        sizes = [g[-1][0] for g in lists]
        stock = [g[::-1] for g in lists]
        left = [sum(c for _, c in g) for g in stock]
        for config, use in sorted(configurations(sizes, left, length), key=lambda x: -x[1]):
            count = min([int(use + 1e-9), *(left[j] // c for j, c in enumerate(config) if c)])
            if count < 1:
                continue
            runs = [(made, count, 0)]  # ranges of these sequences and what they hold by now
            made += count
            for j, c in enumerate(config):
                left[j] -= c * count
                for _ in range(c):
                    after = []
                    for first, n_seq, held in runs:
                        while n_seq:
                            n, have = stock[j][0]
                            take = min(n_seq, have)
                            place(n, first, take)
                            after.append((first, take, held + n))
                            first, n_seq = first + take, n_seq - take
                            stock[j][0][1] -= take
                            if not stock[j][0][1]:
                                stock[j].pop(0)
                    runs = after
            for first, n_seq, held in runs:
                rooms[length - held].append((first, n_seq))
    free = sorted(r for r in rooms if r)
    for n in sorted((n for n, count in histogram.items() if count), reverse=True):
        todo = histogram[n] - given[n]
        while todo:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                each = length // n
                whole, rest = divmod(todo, each)
                for k in range(each):
                    if whole + (k < rest):
                        place(n, made, whole + (k < rest))
                for room, first, count in ((length - each * n, made, whole), (length - rest * n, made + whole, 1)):
                    if room and count and (rest or first == made):
                        if not rooms[room]:
                            bisect.insort(free, room)
                        rooms[room].append((first, count))
                made += whole + bool(rest)
                todo = 0
                continue
            room = free[at]
            first, have = rooms[room].pop()
            take = min(todo, have)
            if have > take:
                rooms[room].append((first + take, have - take))
            if not rooms[room]:
                free.pop(at)
            place(n, first, take)
            if room > n:
                if not rooms[room - n]:
                    bisect.insort(free, room - n)
                rooms[room - n].append((first, take))
            todo -= take
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    rows = stage(pieces(docs, tokenizer, length), "pieces")
    histogram = {n: c for n, c in rows.groupBy("length").count().collect()}  # at most one row per length
    ranges = plan(histogram, length)
    table = spark.createDataFrame(pd.DataFrame(ranges, columns=["length", "first_rank", "first_seq", "n"], dtype="int64"), "length long, first_rank long, first_seq long, n long")
    starts = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "first_seq"))).alias("ranges"))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("order_key", order).withColumn("one", F.lit(1).cast("long"))
    ranked = with_prefix(ranked, ["length"], F.shiftright("order_key", 54), ["order_key", "doc_id", "piece"], "one", "rank")
    ranked = ranked.join(F.broadcast(starts), "length")
    hit = F.element_at(F.filter("ranges", lambda r: r["first_rank"] <= F.col("rank")), -1)
    placed = ranked.withColumn("hit", hit).withColumn("sequence_id", F.col("hit.first_seq") + F.col("rank") - F.col("hit.first_rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
