"""Fill-in-the-middle, the divergence audit and byte-level BPE against brute force, edge cases included."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from isotrack.llm import byte_bpe, fill_middle, source_audit
from isotrack.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n long, output string, ids string"
RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def corpus():
    rng = random.Random(5)
    some = ["naïve café", "  two  spaces ", "tab\tand\nline\r\n", "Straße ÄÖ", "日本語 テキスト", "a b 　c  d", "I'll don't they're 12 345.", "🙂🙃 👩‍👩‍👧", "<P>", "x<S>y <M>", "\x1c \x1f \x85 \x0b", "end "]
    texts = [None, "", " ", "\n\t ", "word", "one two", *some, *some[:4]]
    for n in (3, 40, 400, 3000):
        texts += [" ".join(rng.choice([*some, "Alpha", "beta", "gamma42", "Ωmega", "the", "THE"]) for _ in range(n)) for _ in range(4)]
    texts += ["z" * 60_000, "7" * 60_000, " " * 30_000, "ab " * 60_000, "é" * 9_000, "<" * 500 + "P>" + " y" * 9]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4], 7, "o", "i") for i, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "null id text here", "en", "s1", 1, "o", "i"), (None, None, None, None, 1, "o", "i"), (900, "only 12 345 here", "fr", "s9", 1, "o", "i"), (901, "...", "fr", "s8", 1, "o", "i")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_hand(doc_id, text):
    text, tokens = text or "", UNITS.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(docs, empty):
    names = fill_middle.output_columns(docs)
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == [*docs.columns, *names] and len({c.lower() for c in made.columns}) == len(made.columns)
    got = made.withColumn("back", fill_middle.restore(F.col(names[4]), F.col(names[1]))).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert tuple(r[c] for c in names) == middle_by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.output == "o"
    assert {r[names[1]] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_units_by_events():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab \t\n<P>Sé\x1c") for _ in range(rng.randint(0, 14)))
        ends, marked = fill_middle.scan_text(text)
        assert ends.tolist() == [m.end() for m in UNITS.finditer(text)]
        assert marked == bool(re.search("<[PSM]>", text))


def audit_by_hand(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, seen = defaultdict(Counter), defaultdict(set)
    for i, r in enumerate(rows):
        lang, source = r[2] or "", r[3] or ""
        found = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        counts[lang, source].update(found)
        for t in found:
            seen[lang, t].add(i)
    out = set()
    for lang in {k for k, _ in counts}:
        kept = sorted(t for (at, t), ids in seen.items() if at == lang and len(ids) >= least)
        groups = {s: [c[t] for t in kept] for (at, s), c in counts.items() if at == lang}
        share = lambda n: [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n]
        p, q = {s: share(n) for s, n in groups.items()}, share([sum(n) for n in zip(*groups.values())])
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode()) for o in groups if o != s]
            terms = [(-f(a, b), t.encode()) for t, n, a, b in zip(kept, groups[s], p[s], q) if n and a > b]
            for part, items in (("pair", pairs), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, t.decode(), -v, k) for k, (v, t) in enumerate(sorted(items), 1)}
    return out


def test_audit(docs, empty):
    for top in (200, 3):
        got = source_audit.audit(docs, top=top).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == audit_by_hand(corpus(), top=top)
    assert source_audit.audit(empty).count() == 0


def test_audit_of_sources_alike_and_apart(spark):
    rows = [(i, t, "en", s, 0, "", "") for i, (t, s) in enumerate([("a b c", "x"), ("a b c", "y"), ("A B C", "z"), ("", "w"), (None, "v")] * 2)]
    got = {tuple(r) for r in source_audit.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == audit_by_hand(rows) and ("en", "x", "pair", "y", 0, 3) in got
    once = [(1, "a b", "en", "x", 0, "", ""), (2, "c d", "en", "y", 0, "", "")]
    assert {tuple(r) for r in source_audit.audit(spark.createDataFrame(once, SCHEMA)).collect()} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    text = ["ab cd ab abcd e f cd e", "cd abcd xy"]
    body = np.frombuffer("".join(text).encode(), np.uint8)
    folded, begins, ends = source_audit.boundaries(body, np.array([0, len(text[0]), len(body)]))
    which, terms = source_audit.grouped(folded, begins, ends)
    assert [terms[k].decode() for k in which] == " ".join(text).split() and len(set(terms)) == len(terms)


def test_long_documents_are_cut_between_terms(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "δ"]) for _ in range(400)), "tiny alpha", "x" * 500, "beta beta"]
    body = np.frombuffer(texts[0].encode(), np.uint8)
    monkeypatch.setattr(source_audit, "SLICE", 100)
    pieces = list(source_audit.pieces_of(body, 0, len(body)))
    assert len(pieces) > 10 and b"".join(body[a:b].tobytes() for a, b in pieces).decode() == texts[0]
    assert all(body[b] == 32 for _, b in pieces[:-1])
    assert list(source_audit.pieces_of(np.frombuffer(b"x" * 500, np.uint8), 0, 500)) == [(0, 500)]


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(500):
        total = rng.randint(1, 10**15)
        count = rng.randint(0, total - 1)
        assert int(source_audit.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_encode_and_decode(docs, empty, library):
    ids, split, ends = byte_bpe.encoded_columns(docs, offsets=True)
    made = byte_bpe.encode(docs, RANKS, offsets=True)
    assert made.columns == [*docs.columns, ids, split, ends] and ids != "ids"
    got = byte_bpe.decode(made, RANKS, ids, "back").collect()
    assert len(got) == len(corpus())
    for r in got:
        text = r.text or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(r[ids], "<u4").tolist() == want
        assert bytes(r.back).decode() == text
        stops = np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in want)]).tolist()
        raw = text.encode()
        begins = [n for n, b in enumerate(raw) if b & 0xC0 != 0x80]
        assert np.frombuffer(r[ends], "<u4").tolist() == np.searchsorted(begins, stops[1:]).tolist()
        assert r[split] == sum(raw[a] & 0xC0 == 0x80 for a in stops[:-1])
    assert sum(r[split] for r in got) > 0
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS), RANKS, ids, "back").count() == 0


def test_every_character_and_cut(library):
    own = byte_bpe.Codec(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)))
    rng = random.Random(4)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{c} b{c}{c}1{c} .{c}  " for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)])]
    texts += ["".join(rng.choice([*spaces, *"  ab1.'é日", "'s", "'ll"]) for _ in range(rng.randint(0, 20))) for _ in range(20_000)]
    ids, places = own.encode(pa.array(texts))
    for text, a, b in zip(texts, places, places[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text)


def test_merges_of_any_ranks():
    """Ranks that no training gives: the merges still lead where merging by rank leads."""
    rng = random.Random(6)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 300:
            t = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5)))
            if t not in tokens:
                tokens.append(t)
        order = tokens[256:]
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(tokens[:256] + order)}
        own = byte_bpe.Codec(byte_bpe.tokenizer_json(ranks))
        library = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(100)]
        ids, places = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [library.encode_ordinary(t) for t in texts]


def test_unknown_ids_are_an_error():
    own = byte_bpe.Codec(byte_bpe.tokenizer_json({bytes([b]): b for b in range(256)}))
    with pytest.raises(ValueError):
        own.spell(np.array([300], np.uint32))
    assert own.spell(np.array([0xC3, 0xA9], np.uint32)).tobytes().decode() == "é"


def test_very_long_documents_count_once(spark):
    rows = [(1, "alpha Beta " * 800_000, "en", "s", 0, "", ""), (2, "beta", "en", "s", 0, "", "")]
    got = {(bytes(r.term).decode(), r.n, r.docs) for r in source_audit.count_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("", 0, 2), ("alpha", 800_000, 1), ("beta", 800_001, 2)}
