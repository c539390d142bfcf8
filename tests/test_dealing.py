import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isotrack.operators import dealing, resampled, sensitivity


@pytest.mark.parametrize("texts", [[f"_{s * 37}" for s in range(20_000)], ["_a" * k for k in range(40)], ["_1"], ["_2", "_2", "_1"], ["", "_é"]])
def test_orders_follow_digests(texts):
    made = dealing.Digests(pa.array(texts))
    for rep in (1, 22, 333):
        prefix = f"3_{rep}_15".encode()
        assert made.order(prefix).tolist() == sorted(range(len(texts)), key=lambda i: (hashlib.md5(prefix + texts[i].encode()).hexdigest(), i))


def deals(spark):
    rows = spark.range(600).select((F.col("id") % 6 + 1).cast("int").alias("season"), F.col("id").alias("sid"), (F.col("id") % 7).cast("int").alias("cell_id"), F.lit(1.0).alias("share"))
    return rows, rows.select("season", "sid", F.when(F.col("season") <= 3, "e").otherwise("l").alias("period"), F.substring(F.md5(F.col("sid").cast("string")), 1, 1).alias("label"))


def test_replicates_are_no_rows_of_a_shuffle(spark):
    rows, labels = deals(spark)
    means = dealing.dealt_means(rows, labels, [], {None: 3}, 99)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and means.where("rep = 7").agg(F.sum("je"), F.sum("jl")).first()[:] == pytest.approx((1.0, 1.0))
    assert "rep" not in resampled.label_permutation(rows, labels, 99, 3).columns


def test_domains_are_tested_in_one_pass(spark):
    rows, labels = deals(spark)
    p = rows.select("season", "sid", (F.col("cell_id") * 5 + 1.0).alias("lat"), (100 + F.col("sid") % 80).cast("double").alias("lon"))
    domains = [("all", (100.0, 180.0, 0.0, 40.0), 5.0, False), ("west", (100.0, 140.0, 0.0, 40.0), 5.0, True)]
    both = {r["mode"]: r for r in sensitivity.domain_null(p, labels, domains, 49, 5).collect()}
    for i, domain in enumerate(domains):
        alone = sensitivity.domain_null(p, labels, [domain], 49, 5 + i).first()
        assert np.allclose(both[domain[0]][1:], alone[1:], atol=1e-12)
