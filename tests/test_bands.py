"""Claims by bands, gaps by bins and digest trees against plain Python, with groups that hold most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barlight.operators import evidence, quality, stats


@pytest.mark.parametrize(("share", "least"), [(0.005, 1e-9), (0.2, 0.5), (0.05, 3.0)])
def test_claims_by_bands_are_those_of_all_pairs(spark, share, least):
    rng = random.Random(least)
    value = lambda: rng.choice([0.0, -0.0, rng.uniform(-2, 2) * least, rng.uniform(-5, 5), rng.lognormvariate(0, 6) * rng.choice([-1, 1]), None, float(rng.randrange(-3, 4))])
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    observed = [(key(), rng.choice("fg"), value()) for _ in range(400)]
    claims = [(i, key(), rng.choice("fgh"), v if rng.random() < 0.5 or v is None else v * (1 + rng.uniform(-2, 2) * share)) for i, v in enumerate(rng.choice(observed)[2] for _ in range(1200))]
    got = evidence.check_claims(spark.createDataFrame(claims, "claim_id long, symbol string, field string, value double"), spark.createDataFrame(observed, "symbol string, field string, value double"), share, least).collect()
    want = {}
    for i, s, f, v in claims:
        own = [o for t, g, o in observed if (t, g) == (s, f) and o is not None]
        close = v is not None and any(abs(v - o) <= max(share * abs(o), least) for o in own)
        want[i] = "ambiguous" if s is None else "unavailable" if not own else "ok" if close else "conflict"
    assert {r.claim_id: r.verdict for r in got} == want and len(got) == len(claims)
    for r in got:
        own = [o for t, g, o in observed if (t, g) == (r.symbol, r.field) and o is not None]
        assert (r.observed_min, r.observed_max) == ((min(own), max(own)) if r.verdict == "conflict" else (None, None))


def test_a_hot_group_of_claims_is_many_bands(spark):
    bands = spark.range(1, 20_001).select(evidence.band(F.col("id") / 100.0, 0.005, 1e-9).alias("b")).groupBy("b").count()
    assert bands.count() > 1000 and bands.agg(F.max("count")).first()[0] < 200


def test_gaps_by_bins_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    gap = lambda most: (lambda a: (rng.choice(["hot", "hot", "x", None]), a, a + rng.randrange(1, most)))(rng.randrange(-500, 500))
    manifest, found = [gap(90) for _ in range(150)] + [("hot", 5, 30)] * 2 + [("hot", None, 4), ("hot", 4, None)], [gap(12) for _ in range(60)]
    schema = "symbol string, gap_from long, gap_to long"
    got = quality.manifest_errors(spark.createDataFrame(manifest, schema), spark.createDataFrame(found, schema), bin_ns=20).collect()
    alone = lambda s, a, b: a is None or b is None or not any(t == s and c < b and d > a for t, c, d in found)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.symbol, r.gap_from, r.gap_to) for r in got], key=key) == sorted([m for m in manifest if alone(*m)], key=key)


def test_a_changed_row_changes_one_leaf_and_the_root(spark):
    rows = [(("hot" if i % 4 else "cold"), i, f"v{i}") for i in range(500)] + [("hot", 7, "again"), (None, 1, "v")]
    tree = lambda r: stats.leaves(spark.createDataFrame(r, "k string, at long, v string").repartition(3), "k", F.expr("at div 50"), ["at"], stats.fingerprint(F.col("at"), F.col("v")))
    before, after = tree(rows), tree([(k, i, "other" if i == 123 else v) for k, i, v in rows if i != 499] + [("hot", 1000, "new")])
    assert {(r.k, r.leaf, r.n) for r in before.collect()} >= {("hot", 0, 38), (None, 0, 1)} and before.count() == 21
    assert {(r.k, r.leaf, r.change) for r in stats.changed_leaves(before, after, "k").collect()} == {("hot", 2, "changed"), ("hot", 9, "changed"), ("hot", 20, "new")}
    roots = [{r.k: r.root for r in stats.root(t, "k").collect()} for t in (before, after)]
    assert roots[0]["hot"] != roots[1]["hot"] and roots[0]["cold"] == roots[1]["cold"] and roots[0][None] == roots[1][None]
    own = sorted((r.leaf, r.digest) for r in before.where("k = 'cold'").collect())
    assert roots[0]["cold"] == hashlib.sha256(",".join(f"{n}:{d}" for n, d in own).encode()).hexdigest()
