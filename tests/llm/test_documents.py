"""Operators on documents against brute force on small fixtures, edge cases included."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrack.llm import exact_dedup, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup
from isotrack.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, selected boolean"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    shared = [words(rng, n) for n in (12, 55, 80)]
    base = [words(rng, rng.choice([0, 1, 2, 4, 11, 30, 60, 140, 400])) for _ in range(40)]
    texts = [None, "", " \t\n ", *base]
    for t in base[:25]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
        texts.append(t.upper() if rng.random() < 0.5 else t)
    for s in shared:
        texts += [f"{words(rng, 20)} {s} {words(rng, rng.randint(0, 30))}" for _ in range(6)]
    texts += ["loop " * 300, "x loop " + "loop " * 200, "é" * 200, "ü " + "é" * 120, shared[2] + " " + shared[2], "a" * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4 if i % 3 else 0], 0, 7, "k", i % 2 == 0) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        sizes, bits, slots = exact_dedup.build_hash(keys)
        assert sorted(slots) == list(range(n))
        assert (exact_dedup.find_slots(keys, sizes, bits) == slots).all()


def test_exact_groups(docs, empty):
    groups = {}
    for i, t in corpus():
        groups.setdefault(lower(t), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())


def test_exact_groups_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (2, "b"), (None, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 1, True), (None, None, 1, True)], key=str)
    assert sorted(r.text for r in exact_dedup.drop_repeats(rows).collect()) == ["a", "b", "c"]


def components(rows, k, num):
    sets = {}
    for i, t in rows:
        w = lower(t).encode().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (3, 50)])
def test_near_duplicates(docs, k, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, k, num, 100).collect()}
    assert got == components(corpus(), k, num)


def test_near_duplicates_edges(spark, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "A b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, None), (5, 2, None), (6, 0, 6)], key=str)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[:150], b[:40]]))
        bits = np.unpackbits(ngram_join.whole_sketch(a).view(np.uint8) ^ ngram_join.whole_sketch(b).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_keys_of_unlike_sets_differ():
    rng = np.random.default_rng(6)
    edges = ngram_join.band_edges(1 << 13)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1000, 2000) for _ in range(400)]
    _, owners = np.unique(np.concatenate([np.unique(ngram_join.join_keys(s, 80, 100, edges)) for s in sets]), return_counts=True)
    assert owners.sum() > 300_000 and (owners > 1).sum() < 0.005 * len(owners)


def test_frequent_keys_left_out_lose_no_link():
    """However frequent keys are, similar sets share one that neither leaves out; bare keys and all schemes included."""
    rng = np.random.default_rng(7)
    edges = ngram_join.band_edges(1 << 13)
    dropped = 0
    for n in (6, 11, 19, 23, 40, 61, 79, 104, 134, 170, 226, 300, 383, 600, 838, 1089, 1500) * 4:
        other = int(rng.integers(n, n * 100 // 80 + 1))
        both = -(-80 * (n + other) // 180)  # as few as the similarity of 0.8 allows
        if both > n:
            continue
        union = np.unique(rng.integers(0, 2**64, n + other - both, dtype=np.uint64))
        rng.shuffle(union)
        found = [ngram_join.keys_and_budget(np.sort(x), 80, 100, edges) for x in (union[:n], union[n - both :])]
        common = np.intersect1d(found[0][0], found[1][0])
        for order in (lambda k: np.isin(k, common), lambda k: np.zeros(len(k)), lambda k: k >> np.uint64(7)):  # what they share is the most frequent
            kept = []
            for keys, budget in found:
                keys = keys[np.lexsort((keys, order(keys)))]
                slots = [keys[keys % np.uint64(ngram_join.SLOTS) == slot] for slot in range(ngram_join.SLOTS)]
                kept.append(np.concatenate([own[: max(0, len(own) - most)] for own, most in zip(slots, budget)]))
                dropped += len(keys) - len(kept[-1])
            assert len(np.intersect1d(*kept))
    assert dropped > 1000


def test_passage_of_unlike_documents_brings_few_together(spark, monkeypatch):
    rng, held, write = random.Random(9), [], ngram_join.stage
    passage = words(rng, 200)
    rows = [(i, f"{words(rng, 150)} {passage} {words(rng, 150 + 2 * i)}") for i in range(60)]
    rows += [(100 + i, " ".join(t.split()[:-10])) for i, t in rows[:20]]

    def watched(df, name, **options):
        table = write(df, name, **options)
        if name == "members":
            held.append(table.groupBy("key").count().agg({"count": "max"}).first()[0])
        return table

    monkeypatch.setattr(ngram_join, "stage", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == components(rows, 5, 80) and sum(c < i for i, (_, c) in got.items()) == 20
    assert held[0] <= 8


def test_later_rounds_begin_with_few_pivots(spark, monkeypatch):
    """Copies just under the threshold share keys; few of them are compared with all others before components have grown."""
    rng, heads, write = random.Random(8), [], ngram_join.stage
    base = words(rng, 120).split()
    rows = []
    for i in range(80):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(2, 4)):
            w[at] = f"new{i}x{at}"
        rows.append((i, " ".join(w)))

    def watched(df, name, **options):
        table = write(df, name, **options)
        if name == "rest":
            heads.append(table.groupBy("key").agg(F.count_if("head").alias("n")).agg(F.max("n")).first()[0])
        return table

    monkeypatch.setattr(ngram_join, "stage", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == components(rows, 3, 90) and heads[0] and heads[0] <= 8


def test_wide_sketches_fold(spark):
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 1100).astype(np.uint64))
    b = a[:900]
    rows = [(len(a), len(b), ngram_join.wide_sketch(a).tolist(), ngram_join.wide_sketch(b).tolist())]
    frame = spark.createDataFrame(rows, "n_a long, n_b long, wide_a array<long>, wide_b array<long>")
    assert len(rows[0][2]) == 2 * len(rows[0][3])
    assert frame.where(ngram_join.plausible("n_a", "n_b", "wide_a", "wide_b", 80, 100)).count() == 1
    assert frame.where(ngram_join.plausible("n_a", "n_b", "wide_a", "wide_b", 90, 100)).count() == 0


def test_chosen_words_do_not_collide(spark):
    odd = "a"
    for _ in range(11):
        odd += odd.translate(str.maketrans("ab", "ba"))  # sums of powers modulo 2^64 take both for equal
    twin = odd.translate(str.maketrans("ab", "ba"))
    one, two = ([w if i != 30 else x for i, w in enumerate(f"w{j}" for j in range(60))] for x in (odd, twin))
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, f"x {odd} y"), (4, f"x {twin} y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(frame).collect()} == {(i, 0) for i in range(1, 5)}
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame, 3, 99, 100).collect()}
    assert got == {i: i for i in range(1, 5)}


@pytest.mark.parametrize("num", [50, 60])
def test_near_duplicates_of_unequal_sizes(spark, num):
    rng = random.Random(num)
    rows = []
    for i in range(20):
        w = words(rng, 150 + 7 * i).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + words(rng, int(len(w) * (95 / num - 1))).split()))]
    want = components(rows, 5, num)
    assert sum(c != i for i, (_, c) in want.items()) >= 15
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, num, 100).collect()}
    assert got == want


def test_one_per_group_keeps_columns(docs):
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    want = {c for i, (_, c) in components(corpus(), 5, 80).items()}
    assert {r.doc_id for r in kept.collect()} == want


def removed(rows, units, size):
    seen, out = set(), {}
    for i, t in rows:
        u = units(t or "")
        gone, new = [False] * len(u), []
        for j in range(len(u) - size + 1):
            w = tuple(u[j : j + size])
            if w in seen:
                gone[j : j + size] = [True] * size
            new.append(w)
        seen.update(new)
        out[i] = (u, gone)
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substring_dedup(docs, batches):
    want = {i: (len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for i, (u, g) in removed(corpus(), lambda t: t.encode().split(), 50).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs, batches=batches).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 500


def test_substring_index_is_opened_again(spark, docs, tmp_path):
    want = {i: (len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for i, (u, g) in removed(corpus(), lambda t: t.encode().split(), 50).items()}
    cuts, got = [(0, 30), (30, 70), (70, 1000)], {}
    for low, high in cuts:
        root = str(tmp_path / "index")
        index = substring_dedup.SubstringIndex(spark, root, fanout=1) if not low else substring_dedup.SubstringIndex.open(spark, root, fanout=1)
        part = docs.where((docs.doc_id >= low) & (docs.doc_id < high))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_batch(index, part, docs.where(docs.doc_id < low)).collect()}
        assert len(index.runs) == 1
        index.close()
    assert got == want
    index = substring_dedup.SubstringIndex.open(spark, root)
    once = substring_dedup.fingerprints(docs).select(F.inline(F.arrays_zip("fp", "c1", "c2"))).distinct().count()
    assert index.tables()[0].count() == once
    index.close()


@pytest.mark.parametrize("hot", [1, 5000])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = {}
    for i, (u, g) in removed(corpus(), lambda t: t.encode(), 50).items():
        spans = sum(g[j] and not (j and g[j - 1]) for j in range(len(g)))
        want[i] = (len(u), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(u, g) if not x)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == want


def test_suffix_dedup_of_an_anchor_in_many_contexts(spark):
    """Strings of 20,000 contexts of one anchor, all in one partition, take no frame each; the result is that of a dictionary."""
    rng = random.Random(12)
    line = "".join(rng.choices("abcdef", k=45))
    texts = [(line + "".join(rng.choices("xyz", k=rng.randint(5, 15)))).encode() for _ in range(20_000)]
    rows = [(i, 7 * i, 3, t) for i, t in enumerate(texts)] + [(20_000, 1, 0, texts[0] * 3000)]
    first, want = {}, set()
    for doc, _, start, text in rows:
        for i in range(len(text) - 49):
            if first.setdefault(text[i : i + 50], doc) < doc:
                want.add((doc, start + i))
    frame = spark.createDataFrame(rows, "doc_id long, tkey long, start int, text binary").coalesce(1)
    began = time.time()
    got = [(r.doc_id, r.tkey, r.start, r.n) for r in suffix_dedup.compare_strings(frame, 50).collect()]
    assert time.time() - began < 15
    assert len(got) == len(want) and {(d, s) for d, _, s, _ in got} == want
    assert all(k == (7 * d if d < 20_000 else 1) and n == 1 for d, k, _, n in got)


def test_common_intervals_against_sorted_suffixes():
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(30)]
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\x00".join([*parts, b""]), np.uint8) + np.uint8(1)
    last = np.cumsum(sizes) - 1
    text[last] = 0
    order = suffix_dedup.suffix_order(text, np.repeat(last, sizes))
    border = suffix_dedup.common_intervals(text, order, 6)
    joined = b"\x00".join([*parts, b""])
    ends = np.repeat(last, sizes)
    suffix = [joined[o : ends[o]] for o in order]
    assert suffix == sorted(suffix)
    for j in range(1, len(suffix)):
        a, b = suffix[j - 1], suffix[j]
        common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert border[j] == (common < 6)


def test_dedup_of_nothing(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_substring_index_compacts_as_registered(docs, monkeypatch):
    compacted, compact = [], substring_dedup.SubstringIndex.compact
    monkeypatch.setattr(substring_dedup.SubstringIndex, "compact", lambda self: (compacted.append(len(self.runs)), compact(self)))
    assert substring_dedup.dedup_substrings(docs, with_text=False).count() == docs.count()
    assert compacted == [substring_dedup.FANOUT + 1]


def test_mixing(docs, empty):
    rows = mixing.allocate(docs).collect()
    sizes = {i: len((t or "").encode().split()) for i, t in corpus()}
    assert {r.doc_id: r.size for r in rows} == sizes
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(sum(sizes.values()))
    assert all(abs(sum(t) - target) <= 1 and target <= 3 * size + 1e-6 for (size, target), t in by.items())
    mixed = mixing.curriculum(docs)
    assert mixed.columns == docs.columns
    total = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(total - sum(sizes.values())) <= 4
    assert mixing.allocate(empty).count() == 0


def test_mixing_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    texts = [f"t{i} " + words(rng, rng.randint(3, 40)) for i in range(60)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(60)]
    rows = [(ids[i], t, "en", "ab"[i % 2], 0, 7, "k", True) for i, t in enumerate(texts)]
    mixed = mixing.curriculum(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    times, held = {}, dict(zip((t.split()[0] for t in texts), rows))
    for r in mixed:
        name = r.text.split()[0]
        assert (r.doc_id, r.source) == (held[name][0], held[name][3])
        times[name] = times.get(name, 0) + 1
    assert max(times.values()) <= 3
    assert abs(sum(len(r.text.split()) for r in mixed) - sum(len(t.split()) for t in texts)) <= 4


def test_allocate_orders_null_ids_by_text(spark):
    rng = random.Random(17)
    rows = [(None, words(rng, rng.randint(1, 30)), "ab"[i % 2]) for i in range(40)] + [(None, None, "a")]
    got = mixing.allocate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    for source in "ab":
        stream = sorted((t or "" for _, t, s in rows if s == source), key=lambda t: digest(digest(t)))
        sizes = [len(t.split()) for t in stream]
        target = {r.target for r in got if r.source_size == sum(sizes)}
        assert len(target) == 1
        budget, want, before = round(target.pop()), [], 0
        for n in sizes:
            want.append((n, sum(max(0, min(n, budget - before - e * sum(sizes))) for e in range(3))))
            before += n
        assert sorted((r.size, r.taken) for r in got if r.source_size == sum(sizes)) == sorted(want)


def test_mixing_takes_whole_texts(spark):
    rng = random.Random(13)
    small = [(100 + i, "a\n\nb  " + words(rng, rng.randint(1, 90)), f"s{i % 25:02}") for i in range(100)]
    long = [(500, words(rng, 3000).replace(" ", "\n"), "one long text"), (501, "x y", None)]
    rows = [(i, t, "en", s, 0, 7, "k", True) for i, t, s in small + long]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = mixing.curriculum(frame).collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {(r[0], r[1]) for r in rows}
    assert {r.source for r in mixed} == {r[3] for r in rows}
    times, size, target = {}, {}, {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    source = {r[0]: r[3] for r in rows}
    for r in mixing.allocate(frame).collect():
        size.setdefault(source[r.doc_id], {})[r.doc_id], target[source[r.doc_id]] = r.size, r.target
    for s, own in size.items():
        total = sum(times.get(i, 0) * n for i, n in own.items())
        assert abs(total - target[s]) <= max(own.values()) / 2 + 1 or len([i for i in own if i in times]) == 1


def test_schedules_are_inverted(spark):
    for w0, w1 in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0), (0.0, 2.0)):
        for t in (0.0, 0.3, 1.0):
            asked = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            got = spark.range(1).select(mixing.moment(F.lit(asked), F.lit(w0), F.lit(w1)).alias("t")).first().t
            assert got == pytest.approx(t, abs=1e-9)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), length=64).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    import zlib

    for i, t in corpus():
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seqs) <= 1.1 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_encoder_agrees_with_the_vocabulary_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        encode = packing.encoder(f.read())
    rng = random.Random(8)
    odd = ["<|endoftext|>", "<|endoftext|> a <|endoftext|>", "x<|endoftext|><|endof", "it's we'LL  don't x", "a\r\n\tb  \n", "日本語 текст 🙂🏽", "x" * 500, "  lead", "1234 ½ ²", "\x1c\x85 a"]
    texts = odd + ["".join(rng.choice("ab 'sé\n\t1.,-🙂 ") for _ in range(60)) for _ in range(300)]
    assert [encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_plan_places_every_rank_once():
    rng = random.Random(4)
    for n in (0, 1, 3, 400):
        histogram = {}
        for _ in range(n):
            k = rng.choice([rng.randint(1, 64), 64, 3])
            histogram[k] = histogram.get(k, 0) + 1
        fill, ranks = {}, {}
        for k, first, seq, count in packing.plan(histogram, 64):
            ranks.setdefault(k, []).extend(range(first, first + count))
            for s in range(seq, seq + count):
                fill[s] = fill.get(s, 0) + k
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in histogram.items()}
        assert all(v <= 64 for v in fill.values()) and set(fill) == set(range(len(fill)))


def fewest(lengths, size):
    """The least number of sequences, by trying every set of pieces that can share one."""
    from functools import cache

    @cache
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            taken = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(taken) <= size:
                best = min(best, 1 + least(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def test_plan_is_near_the_fewest_sequences():
    rng = random.Random(14)
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 9))]
        histogram = {n: lengths.count(n) for n in lengths}
        used = max(s + c for _, _, s, c in packing.plan(histogram, 64))
        assert used <= fewest(lengths, 64) + 1


CLASH = ["row", "key", "copy", "own_id", "own_sha", "by_selected", "text_", "__c", "__text", "__id", "__sha", "kept_id", "size", "order_key"]


def test_columns_of_any_name_stay(spark):
    rng = random.Random(15)
    texts = [None, "", *[words(rng, 30) for _ in range(12)]]
    texts += [texts[4], texts[5] + " more"]
    rows = [(i if i % 5 else None, t, "ab"[i % 2], *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    held = set(rows)
    for out in (quality.select_documents(frame, labels), exact_dedup.drop_repeats(frame), ngram_join.one_per_group(frame), mixing.curriculum(frame)):
        assert out.columns == frame.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= held
    assert suffix_dedup.dedup_bytes(frame).count() == substring_dedup.dedup_substrings(frame).count() == packing.pack(frame, tokenizer_path()).count() == len(rows)


def test_very_long_texts(spark):
    rng = random.Random(16)
    long = words(rng, 120_000)
    rows = [(1, long), (2, long + " end"), (3, words(rng, 5)), (None, long), (4, "9" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame, with_text=False).collect()}
    assert (got[None].n_removed, got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 120_000, 120_000, 0)
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(frame).collect()}
    assert (got[None].n_removed, got[1].n_removed, got[2].n_removed, got[4].n_removed) == (0, len(long), len(long), 0)
    near = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()}
    assert near == {None: None, 1: None, 2: None, 3: 3, 4: 4}
    pieces = packing.pieces(frame.where("doc_id <= 2 or doc_id is null"), tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert len({r.n for r in pieces if r.doc_id != 2}) == 1


def test_pipeline_stages(spark, docs):
    """Each stage against brute force, on what the one before kept."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(len((t or "").split()) > 3), 0) for i, t in corpus()], "doc_id long, quality int, toxic int")
    kept = docs.join(quality.score_documents(docs, quality.train(docs, labels)).where("selected").select("doc_id"), "doc_id", "left_semi")
    assert sorted(map(str, quality.select_documents(docs, labels).collect())) == sorted(map(str, kept.select(*docs.columns).collect()))
    held = {r.doc_id: r.text for r in docs.collect()}
    once = {lower(t): i for i, t in sorted(held.items())}
    frame = corpus_pipeline.exact(spark, docs, "")
    assert {r.doc_id for r in frame.collect()} == set(once.values())
    held = {i: held[i] for i in once.values()}
    frame = corpus_pipeline.near(spark, frame.repartition(2), "")
    want = {c for _, c in components(sorted(held.items()), 5, 80).values()}
    assert {r.doc_id for r in frame.collect()} == want
    mixed = corpus_pipeline.mix(spark, frame, "").collect()
    sizes = {i: len((held[i] or "").split()) for i in want}
    assert {r.doc_id for r in mixed} <= want and abs(sum(sizes[r.doc_id] for r in mixed) - sum(sizes.values())) <= max(sizes.values())
    packed = corpus_pipeline.packing(spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert len({(r.doc_id, r.piece) for r in packed}) <= len(packed) and {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]


def test_quality_on_held_out_texts(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, rng.randint(20, 80)).split()
        kind = i % 3
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "horrid"]))
        rows.append((i, " ".join(w), "en", "s", 0, 7, "k", True))
        if i < 400:
            labels.append((i, int(kind > 0), int(kind == 1)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, None, None, None)], SCHEMA)
    lab = spark.createDataFrame([*labels, (9999, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab)
    scored = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    held = [scored[i].selected == (i % 3 == 2) for i in range(400, 600)]
    assert sum(held) >= 0.95 * len(held)
    assert all(0 <= r.expected_grade <= 2 for r in scored.values()) and len(scored) == 601
    kept = quality.select_documents(docs, lab)
    assert kept.columns == docs.columns
    assert quality.select_documents(docs, lab.limit(0)).count() == 601
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_one_per_group_goes_by_rows(spark):
    rng = random.Random(12)
    base, other = words(rng, 120).split(), words(rng, 120)
    near = lambda i: " ".join(base[:i] + ["zzz"] + base[i + 1 :])
    kept = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, __row string"), 5, 80, 100).collect())
    assert kept([(None, near(1), "a"), (None, near(60), "b"), (3, near(110), "c"), (4, "", "d"), (None, None, "e")]) == [(-1, None), (3, near(110)), (4, "")]
    assert kept([(1, near(1), "a"), (5, near(60), "b"), (5, other, "c")]) == [(1, near(1)), (5, other)]
    assert len(kept([(7, near(5), "a")] * 4 + [(None, other, "b")] * 3)) == 2
    one = ngram_join.one_per_group(spark.createDataFrame([(2, near(1), "a"), (2, near(1), "b")], "doc_id long, text string, __row string")).collect()
    assert len(one) == 1 and one[0]["__row"] in "ab"
