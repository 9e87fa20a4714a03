"""The corpus pipeline: each stage on what the one before kept, against brute force and on odd rows."""

import collections

import corpus_pipeline as cp
import pytest
from barlight.llm import decision_list, decontaminate, jaccard_join, secret_markov

from .test_operators import SCHEMA, TEXTS, brute_base, brute_base_spans, brute_links, texts_of


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    first = stages["quality_rules"](spark, docs, small).cache()
    verdict = {r.doc_id: r.kept for r in decision_list.judge(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    texts = texts_of(docs)
    assert {r.doc_id for r in first.collect()} == {k for k, kept in verdict.items() if kept}
    assert all(brute_base(texts[r.doc_id])[0] >= 10 for r in first.collect())
    second = stages["near_duplicates"](spark, first, small).cache()
    classes = brute_links(texts_of(first))
    assert {r.doc_id for r in second.collect()} == {k for k, (root, _) in classes.items() if k == root}
    third = stages["benchmark_passages"](spark, second, small).cache()
    found = {r.doc_id for r in decontaminate.find(second, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - found
    fourth = stages["secrets"](spark, third, small).cache()
    before, after = texts_of(third), texts_of(fourth)
    for k, t in before.items():
        base = brute_base_spans(t)
        assert not brute_base_spans(after[k]) and (base or "[SECRET]" in after[k] or after[k] == t)
    assert all(r.n_chars == len(r.text) for r in fourth.collect())
    for stage in (first, second, third, fourth):
        assert stage.columns == columns
    last = stages["packing"](spark, fourth, small)
    assert {r.doc_id for r in last.collect()} == set(after)


def test_run_goes_through_all_stages(spark, small):
    out = cp.run(spark, small)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0 and 4 <= len(cp.STAGES) <= 5


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_and_empty_tables(spark, small, name, stage):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, "w", "r", "s", "t") for i, t in enumerate(TEXTS)] + [(None, "a row without id that has enough words to stay in the corpus", *[None] * 9)]
    odd = spark.createDataFrame(rows, SCHEMA)
    for docs in (odd, odd.where("false")):
        out = stage(spark, docs, small)
        assert out.count() <= (200 if name == "packing" else len(rows)) and (name == "packing" or out.columns == docs.columns)
    if name != "packing":
        assert stage(spark, odd, small).where("doc_id is null").count() == 1


def test_secret_values_are_gone():
    text = 'x password="hunter2hunter2" and deadbeefdeadbeefdeadbeefdeadbeef'
    out = secret_markov.blanked(text, secret_markov.base_spans(text))
    assert "hunter2" not in out and "deadbeef" not in out


def test_repeats_and_rows_without_id(spark, small):
    """Repeated rows, copies without id, two texts under one id, and contaminated rows without id."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 60").first().text
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (3, b), (None, c), (None, c), (4, f"{a} {item}"), (None, f"{b} {item}"), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    second = cp.near_duplicates(spark, docs, small)
    assert collections.Counter(map(tuple, second.collect())) == collections.Counter({(1, a): 1, (1, b): 1, (None, c): 1, (4, f"{a} {item}"): 1, (None, f"{b} {item}"): 1, (5, None): 1, (6, ""): 1})
    third = cp.benchmark_passages(spark, docs, small)
    assert collections.Counter(map(tuple, third.collect())) == collections.Counter(r for r in rows if item not in (r[1] or ""))


def test_links_of_two_texts_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t + " tail"
    got = jaccard_join.near_duplicates(spark.createDataFrame([(1, a), (1, b), (2, near(a)), (3, near(b))], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)]
