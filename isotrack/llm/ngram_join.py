"""N-gram Jaccard join on parity sketches.

A document's set is that of its distinct word shingles.  Each shingle flips one
bit of a sketch, so two sketches differ in at most as many bits as the sets
have elements apart.  Sets of sizes a and b with Jaccard similarity num/den or
more are at most d = (a + b)(den - num)/(den + num) elements apart.

Sizes are cut into bands; a set joins its own band and, if a similar set can be
larger than the band, the next one.  In a band the sketch is cut into groups,
so many that one group at least has no more than r odd bits that differ
(pigeonhole).  A group is cut again into m blocks, of which then m - r agree;
each choice of m - r blocks is a join key.  Small sets take r and m by which a
key holds most of them, as a passage shared by unlike documents can be half of
them; large ones take r = 0, where groups are keys themselves.

Keys without an odd bit would be common to many sets.  There are spare groups,
so that several agree; a set with fewer groups that have a bare key than these
leaves its bare keys out, as one of the groups that agree has none.

Equal sets form one class and only its representative, a node, is joined.  Keys
never cross the network one by one: chunks of nodes list theirs sorted and
packed, dealt out by value; each value's task answers which are shared, and
only shared ones become rows.

Similar sets share many keys of a band, at least as many as groups agree.  Each node leaves out its most frequent
keys, one fewer than it shares with any similar set: as all nodes go by one order, the first key that two similar
sets share is left out by neither.  So a passage that many unlike documents hold hardly brings them together.

Members of a key are compared with one pivot first; only if members then lie in
different components are more of them made pivots, few at first, as components
that grow together need not be compared, until none is left.  Before
sets are compared, sketches are: too large a Hamming distance rules a pair out.
Members of a key that many nodes have are spread by a salt, and so are pairs of
a pivot that many keys have.

Words are told apart by BLAKE2 digests, shingles by hashes of these.

Defined results: texts without words have empty sets, which are linked with
nothing; a text of fewer words than a shingle has the whole sequence as its one
element; texts of any length are read whole, long ones by pieces; rows that
repeat a doc_id are linked as each one's own text is; a null doc_id sorts first;
equal sets are linked whatever their size; other columns, whatever their names,
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, only_last_table_stays, partitions_for, stage, unused
from .kernels import U, distinct, mix, signed, slices, window_hashes, word_digests

NO_ID = -(2**63)
BAND = 1.3
PIVOTS = (1, 16, 256, 2048)  # pivots of a key in later rounds, one after the other; the last holds for those that follow
SPREAD = 8  # parts that the pairs of one pivot are dealt to
SALT = 8192  # members of a key in one part
SETS_EACH = 1000  # pairs whose sets one partition compares
SKETCH = 512  # bits of the short sketch of the whole set; the wide one has as many as the set has elements
SCHEMES = ((1, 1, 6), (2, 2, 8), (20, 2, 6), (30, 1, 3), (float("inf"), 0, 1))  # (most elements apart, r, m)
BLOCK_BITS = 1 << 32  # so many that a key tells its shingles apart, and unlike sets hardly ever meet by chance
SLOTS = 16  # last digits of a key, those of its band's number
CHUNK_BITS, BUCKET = 14, 1_000_000  # nodes of a chunk, as bits of their number; keys of a bucket
SIGNATURE = "row long, doc_id long, n long, f1 long, f2 long, sketch array<long>, wide array<long>, budget array<int>, keys array<long>"
LISTS = "bucket long, chunk long, packed binary, owner binary, more binary, node long, doc_id long, n long, f1 long, f2 long, sketch array<long>, wide array<long>, budget array<int>"
ANSWERS = "bucket long, chunk long, shared binary"
SETS = "doc_id long, f1 long, f2 long, shingles array<long>"


def band_edges(top: int) -> list[int]:
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


def band_scheme(low: int, high: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(groups, spare, r, m) of the band [low, high): ``spare`` groups at least have no more than r bits
    that differ.  No groups if the band's similar sets are equal ones."""
    d = 2 * (high - 1) * (den - num) // (den + num)
    r, m = next((r, m) for most, r, m in SCHEMES if d <= most)
    groups = d // (r + 1) + 1
    empty = groups * math.comb(m, r) * math.exp(-0.9 * low * (m - r) / m / (groups + 1))  # keys without bits to expect
    spare = 1 if empty < 1e-3 else 2 + math.ceil(2 * empty)
    return groups - 1 + spare if d else 0, spare, r, m


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, first = word_digests(texts, lower=True)
    grams = window_hashes(words, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield distinct(grams[a : b - k + 1])
        elif b > a:
            yield mix(window_hashes(words[a:b], int(b - a)), 1000 + int(b - a))
        else:
            yield np.zeros(0, U)


def band_keys(s: np.ndarray, num: int, den: int, edges: list[int]) -> Iterator[tuple[int, np.ndarray, int]]:
    """Every band that a sorted set joins, its block keys there and how many of them it can leave out: one fewer than
    it shares with any similar set."""
    n = len(s)
    band = int(np.searchsorted(edges, n, "right")) - 1
    for k in range(band, len(edges) - 1):
        if k > band and n * den < num * edges[k]:  # no set of that band is similar
            break
        groups, spare, r, m = band_scheme(edges[k], edges[k + 1], num, den)
        if not groups:
            continue
        block = ((s >> U(32)) * U(groups * m)) >> U(32)
        begin = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
        content = np.zeros(groups * m, U)
        content[block[begin].astype(np.int64)] = np.bitwise_xor.reduceat(mix(s % U(BLOCK_BITS), 5), begin)
        blank = (content == 0).reshape(groups, m)
        content = mix(content + mix(np.arange(groups * m, dtype=U), 100 + k)).reshape(groups, m)
        choices = [list(c) for c in combinations(range(m), m - r)]
        keys = np.stack([mix(content[:, c].sum(axis=1)) for c in choices]) // U(SLOTS) * U(SLOTS) + U(k % SLOTS)
        bare = np.stack([blank[:, c].all(axis=1) for c in choices])
        bares = int(bare.any(axis=0).sum())
        apart = (n + min(edges[k + 1] - 1, n * den // num)) * (den - num) // (den + num)
        agree = groups - apart // (r + 1) - min(bares, spare - 1)  # either set may have left bare keys out
        yield k, keys.ravel() if bares >= spare else keys[~bare], max(0, agree - 1)


def join_keys(s: np.ndarray, num: int, den: int, edges: list[int]) -> np.ndarray:
    """The block keys of a sorted set in every band that it joins."""
    return np.concatenate([np.zeros(0, U), *(keys for _, keys, _ in band_keys(s, num, den, edges))])


def keys_and_budget(s: np.ndarray, num: int, den: int, edges: list[int]) -> tuple[np.ndarray, list[int]]:
    """The block keys of a sorted set and, by their last digits, how many can be left out; none where bands share these."""
    bands, budget = list(band_keys(s, num, den, edges)), [0] * SLOTS
    if len(bands) <= SLOTS:
        for k, _, most in bands:
            budget[k % SLOTS] = most
    return np.concatenate([np.zeros(0, U), *(keys for _, keys, _ in bands)]), budget


def whole_sketch(s: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    odd = np.bincount((mix(s, 9) % U(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """Of a power of two of bits, so that the longer of two folds to the shorter."""
    return whole_sketch(s, max(SKETCH, 1 << (len(s) - 1).bit_length()))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, row = band_edges((1 << 12) * den // num), TaskContext.get().partitionId() << 36
        for pdf in batches:
            texts, ids = list(pdf.text), pdf.doc_id.to_numpy()
            for lo, hi in slices([len(t or "") for t in texts]):
                rows = []
                for doc, s in zip(ids[lo:hi], shingle_sets(texts[lo:hi], k)):
                    if len(s) * den >= num * edges[-2]:
                        edges = band_edges(2 * len(s) * den // num)
                    keys, budget = keys_and_budget(s, num, den, edges) if len(s) else (s, [])
                    rows.append((row + len(rows), doc, len(s), int(signed(mix(s, 3).sum(keepdims=True))[0]), int(signed(mix(s, 4).sum(keepdims=True))[0]), whole_sketch(s), wide_sketch(s) if len(s) else [], budget, signed(keys)))
                row += len(rows)
                yield pd.DataFrame(rows, columns=["row", "doc_id", "n", "f1", "f2", "sketch", "wide", "budget", "keys"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").mapInPandas(sign, SIGNATURE)


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as byte planes of their differences, compressed."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def key_lists(reps: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: nodes (node, doc_id, n, f1, f2, sketch, wide, budget), and per chunk of nodes and bucket the
    sorted distinct keys, the first node of each, and (key's place, node) of the others."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, most = TaskContext.get().partitionId() << 28, 1 << CHUNK_BITS
        for batch in batches:
            for lo, hi in slices([len(k) for k in batch["keys"]], 1 << 20):
                for at in range(lo, hi, most):
                    pdf = batch.iloc[at : min(at + most, hi)]
                    yield pdf.drop(columns="keys").assign(node=(chunk << CHUNK_BITS) + np.arange(len(pdf)))
                    owner = np.repeat(np.arange(len(pdf), dtype=np.uint16), [len(k) for k in pdf["keys"]])
                    key = np.concatenate([np.asarray(k, np.int64) for k in pdf["keys"]]).view(U)
                    key = ((key >> U(32)) % U(buckets) << U(32)) | (key & U(0xFFFFFFFF))
                    order = np.argsort(key, kind="stable")
                    key, owner = key[order], owner[order]
                    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
                    place = np.cumsum(fresh) - 1
                    begin = np.flatnonzero(np.concatenate([[True], key[1:] >> U(32) != key[:-1] >> U(32)])) if len(key) else np.zeros(0, np.int64)
                    out = []
                    for x, y in zip(begin, np.append(begin[1:], len(key))):
                        first, others = x + np.flatnonzero(fresh[x:y]), x + np.flatnonzero(~fresh[x:y])
                        more = (place[others] - place[x]).astype("<u4").tobytes() + owner[others].astype("<u2").tobytes()
                        out.append((int(key[x] >> U(32)), chunk, pack(key[first].astype(np.uint32)), owner[first].tobytes(), more))
                    yield pd.DataFrame(out, columns=["bucket", "chunk", "packed", "owner", "more"])
                    chunk += 1

    columns = [c.split()[0] for c in LISTS.split(", ")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types = {c: "Int64" for c in ("bucket", "chunk", "node", "doc_id", "n", "f1", "f2")}
        for pdf in build(batches):
            yield pdf.assign(**{c: None for c in columns if c not in pdf})[columns].astype(types)

    return reps.mapInPandas(whole, LISTS)


def others(more: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(more) // 6
    return np.frombuffer(more, "<u4", n), np.frombuffer(more, "<u2", n, 4 * n)


def shared_keys(lists: DataFrame) -> DataFrame:
    """(key, node) of every key that several nodes have."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack(p) for p in pdf.packed]
        value = np.concatenate(lists)
        own = np.zeros(len(value), bool)  # shared inside its chunk
        ends = np.cumsum([len(x) for x in lists])
        for end, held, local in zip(ends, lists, pdf.local):
            own[end - len(held) : end] = np.unpackbits(np.frombuffer(local, np.uint8), count=len(held)).astype(bool)
        order = np.argsort(value, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
        size = np.diff(np.append(begin, len(order)))
        shared = np.empty(len(value), bool)
        shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(own[order], begin), size)
        out = []
        for end, chunk, held in zip(ends, pdf.chunk, lists):
            part = slice(end - len(held), end)
            if shared[part].any():
                out.append((pdf.bucket.iloc[0], chunk, np.packbits(shared[part]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "shared"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            local = []
            for owner, more in zip(pdf.owner, pdf.more):
                bits = np.zeros(len(owner) // 2, bool)
                bits[others(more)[0]] = True
                local.append(np.packbits(bits).tobytes())
            yield pdf.drop(columns=["owner", "more"]).assign(local=local)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, chunk, packed, owner, more, shared in zip(pdf.bucket, pdf.chunk, pdf.packed, pdf.owner, pdf.more, pdf.shared):
                value, owner = unpack(packed), np.frombuffer(owner, np.uint16).astype(np.int64)
                on = np.unpackbits(np.frombuffer(shared, np.uint8), count=len(value)).astype(bool)
                place, extra = others(more)
                place = np.concatenate([np.flatnonzero(on), place])
                nodes = (chunk << CHUNK_BITS) + np.concatenate([owner[on], extra.astype(np.int64)])
                yield pd.DataFrame({"key": (bucket << 32) | value[place].astype(np.int64), "node": nodes})

    held = lists.where("bucket IS NOT NULL").select("bucket", "chunk", "packed", "owner", "more")
    told = held.mapInPandas(mark, "bucket long, chunk long, packed binary, local binary").groupBy("bucket").applyInPandas(answer, ANSWERS)
    return held.join(stage(told, "answers"), ["bucket", "chunk"]).mapInPandas(expand, "key long, node long")


def rarest(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, pivot) of the keys that several nodes still have when each has left out the most frequent ones that
    its budgets allow; the pivot is the smallest of these nodes.  ``member`` has a row (key, node) for each time that a
    node lists a key."""
    sizes = member.groupBy("key").agg(F.count("*").alias("size"))
    held = member.join(sizes, "key").withColumn("slot", F.col("key").bitwiseAND(SLOTS - 1).cast("int")).join(nodes.select("node", "budget"), "node")
    place = F.row_number().over(Window.partitionBy("node", "slot").orderBy(F.desc("size"), "key"))
    held = stage(held.select("key", "node", F.col("budget")[F.col("slot")].alias("most"), place.alias("place")).where("place > most").select("key", "node"), "held")
    pivots = held.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    kept = stage(held.join(pivots.select("key", "pivot"), "key"), "members")
    discard(held)
    return kept


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, doc_id, f1, f2), read again from the texts."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = list(pdf.text), pdf.doc_id.to_numpy()
            for lo, hi in slices([len(t or "") for t in texts]):
                found = list(shingle_sets(texts[lo:hi], k))
                marks = [[int(signed(mix(s, seed).sum(keepdims=True))[0]) for s in found] for seed in (3, 4)]
                yield pd.DataFrame({"doc_id": ids[lo:hi], "f1": marks[0], "f2": marks[1], "shingles": [signed(s) for s in found]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").mapInPandas(build, SETS)
    return rows.join(nodes.select("node", "doc_id", "f1", "f2"), ["doc_id", "f1", "f2"]).dropDuplicates(["node"]).select("node", "shingles")


def plausible(n_a: str, n_b: str, sketch_a: str, sketch_b: str, num: int, den: int) -> Column:
    """Whether sizes and the sketches' Hamming distance allow the similarity."""
    half = lambda x, i: F.slice(x, F.lit(1) + i * F.floor(F.size(x) / 2).cast("int"), F.floor(F.size(x) / 2).cast("int"))
    fold = lambda x: F.zip_with(half(x, 0), half(x, 1), lambda u, v: u.bitwiseXOR(v))
    a, b = F.col(sketch_a), F.col(sketch_b)
    if "wide" in sketch_a:
        for _ in range(math.ceil(math.log2(den / num)) + 1):  # sizes that allow it differ no more
            a, b = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
        apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    else:  # of a fixed number of words, whose terms Spark compiles
        apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (apart * (den + num) <= (F.col(n_a) + F.col(n_b)) * (den - num))


def sketched(pairs: DataFrame, nodes: DataFrame, num: int, den: int, sketch: str = "sketch") -> DataFrame:
    """The ``pairs`` (a, b, ...) whose sketches allow the similarity; those of one node a are dealt to ``SPREAD`` parts."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(sketch).alias(f"{sketch}_{x}"))
    first = side("a").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    near = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")).join(first, ["a", "part"]).join(side("b"), "b")
    return near.where(plausible("n_a", "n_b", f"{sketch}_a", f"{sketch}_b", num, den)).select(*pairs.columns)


def verify(near: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``near`` whose sets are similar."""
    near = stage(near.select("a", "b").distinct(), "near")  # few pairs: their sets alone are read again
    with partitions_for(near, SETS_EACH):
        return similar(near, docs, nodes, k, num, den)


def similar(near: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    need = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = stage(sets_of(docs, nodes.join(need, "node", "left_semi"), k), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"))
    full = near.join(side("b"), "b").join(side("a"), "a")
    both, all_ = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long"), F.size("shingles_a") + F.size("shingles_b")
    edges = stage(full.select("a", "b", both.alias("both"), all_.alias("n")).where(F.col("both") * den >= (F.col("n") - F.col("both")) * num).select("a", "b"), "edges")
    discard(sets)
    return edges


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    side = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"label_{x}"))
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(apart).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; the component is the smallest doc_id over links."""
    signed_docs = stage(signatures(docs, k, num, den), "signatures")
    rows = stage(signed_docs.select("row", "doc_id", "n", "f1", "f2"), "rows")
    classes = stage(rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min_by("row", F.struct("doc_id", "row")).alias("row")), "classes")
    reps = signed_docs.join(classes.select("row"), "row", "left_semi").select("doc_id", "n", "f1", "f2", "sketch", "wide", "budget", "keys")
    total = signed_docs.agg(F.sum(F.size("keys"))).first()[0] or 0
    lists = stage(key_lists(reps, max(1, -(-total // BUCKET))), "lists")
    discard(signed_docs)
    nodes = stage(lists.where("node IS NOT NULL").select("node", "doc_id", "n", "f1", "f2", "sketch", "wide", "budget"), "nodes")
    shared = stage(shared_keys(lists), "shared")
    discard(lists)
    member = rarest(shared, nodes)
    discard(shared)
    rest = member.where("node <> pivot").select("key", "node")
    pairs = member.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    pairs = stage(sketched(pairs, nodes, num, den), "pairs")
    near = stage(sketched(pairs, nodes, num, den, "wide"), "near")
    # each node is compared with the pivot of most of its keys first, then with those of other components
    first = near.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
    edges = verify(first, docs, nodes, k, num, den)
    labels = connected_components(edges)
    edges = stage(edges.union(verify(between(near, labels), docs, nodes, k, num, den)), "edges")
    held = [member]
    for most in chain(PIVOTS, repeat(PIVOTS[-1])):
        components = connected_components(edges)
        labels = components.select(F.col("id").alias("node"), F.col("component").alias("label"))
        rest = rest.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        split = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("least"), F.count("*").alias("members"))
        split = split.where("lo <> hi").select("key", "least", F.ceil(F.col("members") / most).alias("every"), F.ceil(F.col("members") / SALT).cast("int").alias("parts"))
        rest = rest.join(split, "key").dropDuplicates(["key", "node"])
        head = (F.pmod(F.xxhash64("node"), F.col("every")) == 0) | (F.col("node") == F.col("least"))
        rest = stage(rest.withColumn("head", head).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")).join(nodes.select("node", "n", "sketch"), "node"), "rest")
        discard(*held)
        held = [rest]
        if rest.isEmpty():
            break
        heads = rest.where("head").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        heads = heads.select("key", "part", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "sketch")])
        pairs = heads.join(rest, ["key", "part"]).where((F.col("label") != F.col("label_a")) & (~F.col("head") | (F.col("node") > F.col("node_a"))))
        pairs = pairs.where(plausible("n", "n_a", "sketch", "sketch_a", num, den)).select(F.col("node_a").alias("a"), F.col("node").alias("b"))
        near = sketched(stage(pairs.distinct(), "pairs"), nodes, num, den, "wide")
        edges = stage(edges.union(verify(near, docs, nodes, k, num, den)), "edges")
        rest = rest.where("not head").select("key", "node")
    discard(*held)
    marks = nodes.select("node", "doc_id", "n", "f1", "f2").join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = marks.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = stage(marks.join(least, "component").select("n", "f1", "f2", "least"), "found")
    component = F.nullif(F.coalesce("least", "doc_id"), F.lit(NO_ID))
    return rows.join(found, ["n", "f1", "f2"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, all columns unchanged: that of the smallest doc_id, null last.

    A row is named by a 64-bit hash of its id and text, so that rows that share an id, or lack one, are linked and
    chosen each by its own text, and no copy of the texts is written.  Of several rows with the smallest id, that of
    the lowest hash stays, and of rows equal in id and text any one.  A chance meeting of two hashes keeps a row too
    many and loses none.  Rows without words stay all.
    """
    name, digest = unused(docs, "__name", "__digest")
    named = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    with only_last_table_stays(docs.sparkSession):
        groups = near_duplicates(named.select(F.col(name).alias("doc_id"), "text"), k, num, den)
        groups = groups.groupBy("doc_id", "component_id").agg(F.max("n_shingles").alias("n"))
        ids = named.groupBy(F.col(name).alias("doc_id")).agg(F.min(named["doc_id"]).alias("id"), F.count("*").alias("rows"))
        chosen = F.min_by(F.struct("doc_id", "n", "rows"), F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("chosen")
        kept = stage(groups.join(ids, "doc_id").groupBy("component_id").agg(chosen).select("chosen.*"), "kept")
    repeated = (F.col("n") > 0) & (F.col("rows") > 1)
    of = lambda rows: named.join(rows.select(F.col("doc_id").alias(name)), name, "left_semi")
    several = of(kept.where(repeated)).withColumn(digest, F.sha2("text", 256)).dropDuplicates([name, digest])
    return of(kept.where(~repeated)).select(*docs.columns).union(several.select(*docs.columns))
