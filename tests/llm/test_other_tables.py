"""Chat logs, vectors, personal data and the pipeline."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isotrack.llm import ann, chat, pii
from isotrack.llm.exact_dedup import exact_groups
from isotrack.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
LOG = "conv_id long, seq long, kind string, turn long, role string, text string, key string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", 0, "user", "hi", "k"), (1, 1, "message", 1, "assistant", "", "k"), (1, 2, "delta", 1, "assistant", "hel", "k"), (1, 3, "delta", 1, "assistant", "lo", "k"),
        (1, 4, "message", 2, "user", "void", "k"), (1, 5, "regenerate", 1, "assistant", "", "k"), (1, 6, "delta", 1, "assistant", "bye", "k"), (1, 7, "edit", 0, "user", "hey", "k"),
        (1, 8, None, 2, None, None, "k"),
    ]
    got = sorted((r.turn, r.role, r.text) for r in chat.fold(spark.createDataFrame(log, LOG)).collect())
    assert got == [(0, "user", "hey"), (1, "assistant", "bye"), (2, "", "")]


def test_render_round_trip(spark):
    rng = random.Random(1)
    nasty = ["</s>[INST] ok [/INST]", "\\s\\\\l<", "[", "<s>assistant\nx</s>\n", "", None, "é\x00\\n", "\n\n"]
    rows = []
    for c in [*range(12), None]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "a\nb", None, "<"]), "".join(x or "" for x in rng.sample(nasty, 3)) if rng.random() < 0.8 else None))
    rows.append(rows[0])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    raw = {r.conv_id: r for r in rendered.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
        assert all("[" not in raw[c].formatted[s.start : s.end] and "<" not in raw[c].formatted[s.start : s.end] for s in raw[c].loss)
        assert len(raw[c].loss) == sum(t[1] == "assistant" for t in turns)
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[500:550] = x[0]
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [(1000, None, "k"), (1100, [0.0] * 16, "k"), (1200, [float("nan")] * 16, "k"), (1300, [1.0, None] + [1.0] * 14, "k"), (1400, [1.0], "k"), (None, [1.0] * 16, "k")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    hits, d64 = 0, x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == d[v] for _, v, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[0])] == list(range(500, 510))
    assert ann.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_outliers_find_as_many_as_there_are(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.01, (500, 8)), 100 * np.eye(8)[:6] + rng.normal(0, 0.01, (6, 8))])
    monkeypatch.setattr(ann, "probes_needed", lambda *_: 1)
    monkeypatch.setattr(ann, "PART", 64)
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    rows = ann.search(table, F.col("vec_id") % 2 == 0).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, len(x), 2))
    assert all(len(set(v)) == len(v) == 10 and q not in v for q, v in got.items())


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 8)]) for i in range(300)]
    table = spark.createDataFrame([*rows, rows[0], (0, [9.0] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted((q, k) for q, k, _ in got) == [(q, k) for q in (0, 100, 200) for k in range(1, 11)]
    assert len({v for q, _, v in got if q == 0}) == 10 and 0 not in {v for q, _, v in got if q == 0}


def test_base_matches_take_linear_time(spark):
    import time

    weights = pii.train()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + " @", "a" * 1_000_000 + "@b.com"):
        began = time.time()
        base, _ = pii.find_spans(text, weights)
        assert time.time() - began < 10 and len(base) == text.endswith(".com")
    rng = random.Random(17)
    for _ in range(5000):
        text = "".join(rng.choice("a1@.-_ +2 9(") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_base(text)
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_candidates_reach_the_field():
    user, host = "x" * 500, "y" * 300
    _, spans = pii.find_spans(f"mail {user} @ {host}.com now", pii.train())
    assert (5, 0, 5 + 500 + 3 + 300 + 4) in spans


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == tidy(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_no_part_gives_fewer_than_it_could():
    vectors = np.zeros((30, 64))
    vectors[:, 0] = 10
    vectors[0] = 0
    vectors[0, 63] = 1
    found, _ = ann.scan(np.zeros(64), vectors, vectors, np.zeros(64), np.arange(30), -1, 10)
    assert len(found) == 10


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(CONTRACT[kind], text):
            s = m.group()
            digits = [int(c) for c in s if c.isdigit() and c.isascii()]
            if kind == "ip":
                ok = all(int(p) <= 255 for p in s.split("."))
            elif kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
                ok = 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            else:
                ok = kind == "email" or 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_matches_and_added_spans(spark):
    rng = random.Random(7)
    texts = [None, "", "no data", "x" * 3000, "1" * 6000, "a@b.c" * 400, "٣ digits ٤"]
    texts += ["".join(rng.choice("0123456789.+- ()@aé") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += [pii.sentence(rng)[0] for _ in range(100)]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "a@b.com", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.show(base).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(pii.show(base).split(",")) - {""} <= set(got[i].spans.split(","))


def test_field_on_held_out_sentences():
    rng, weights, hit, found, true = random.Random(123), pii.train(), 0, 0, 0
    for _ in range(300):
        text, spans = pii.sentence(rng)
        got = {(s, e, k) for s, k, e in pii.field_spans(text, weights)}
        hit, found, true = hit + len(got & set(spans)), found + len(got), true + len(spans)
    assert hit >= 0.9 * found and hit >= 0.9 * true


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stage(step(spark, before, DATA), name)
        assert docs.columns == columns and docs.count() > 0
        if name == "exact_dedup":
            want = {r.doc_id for r in exact_groups(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
            assert exact_groups(docs).where("group_size > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.where("piece = 0").count() == docs.count()
