"""Pruned ranks against all pairs, and the index that lives against one built anew."""

import collections
import contextlib
import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from barlight.functions import text as ft
from barlight.operators import index, search


def tokens(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def corpus(seed, n=150):
    """Common words, rare words, ties, repeats of a text, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 30, 120]))) for _ in range(n)]
    return [(i, rng.choice([t, texts[0], texts[0] + " w7"]) if rng.random() < 0.3 else t) for i, t in enumerate(texts)] + [(n, ""), (n + 1, None)]


def brute(docs, queries, k, k1=1.2, b=0.75):
    split = {i: (t or "").split() for i, t in docs}
    mean, n = sum(map(len, split.values())) / len(split), len(split)
    df = collections.Counter(w for t in split.values() for w in set(t))
    out = {}
    for q, text in queries:
        scores = []
        for i, t in split.items():
            tf = collections.Counter(t)
            shared = set((text or "").split()) & set(tf)
            if shared:
                scores.append((-round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in shared), 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def hits(found):
    out = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r.doc_id, r.score))
    return out


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 1), (3, 20)])
def test_pruned_ranks_are_those_of_all_pairs(spark, seed, k):
    docs = corpus(seed)
    queries = [(i, t) for i, t in docs[::9]] + [(1000, "w1 w2 w3"), (1001, "nothing of this"), (1002, None)]
    got = hits(search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), tokens, k))
    for q, want in brute(docs, queries, k).items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)
        if len({s for _, s in want}) == len(want):
            assert [i for i, _ in got[q][:-1]] == [i for i, _ in want[:-1]]


def test_common_terms_are_not_met(spark):
    """Of the pairs of postings that a join by term builds, the lists that can decide hold a small share."""
    rng = random.Random(0)
    docs = [(i, " ".join([f"c{rng.randrange(30)}" for _ in range(60)] + [f"r{i // 4}x{j}" for j in range(6)])) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real, kept, pairs = search.written, {}, {}

    def counting(frame, name):
        out = kept[name] = real(frame, name)
        if name == "asked":
            pairs["all"], pairs["probe"] = out.agg(F.sum("n"), F.sum(F.when(F.col("upto") <= 128, F.col("n")))).first()
        if name == "terms":
            pairs["lists"] = kept["asked"].drop("term_most").join(out, ["q", "term"]).where("needed and most + all - term_most >= floor").agg(F.sum("n")).first()[0]
        return out

    search.written = counting
    try:
        found = search.similar(df, F.col("doc_id") % 50 == 0, k=3)
    finally:
        search.written = real
    assert found.count() == 24 * 3 and all(r.src // 4 == r.dst // 4 for r in found.collect())
    assert pairs["all"] > 400_000 and pairs["probe"] + pairs["lists"] < pairs["all"] / 10


def test_no_pair_of_postings_is_a_row(spark, monkeypatch):
    """A query and a term are one row, whatever counts and lengths the term's postings have; many small blocks give what one block gives."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"c{100 + rng.randrange(40)}" for _ in range(rng.choice([3, 9, 40, 200])))) for i in range(400)] + [(400, None), (None, "c101 c102")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real, kept = search.written, {}
    monkeypatch.setattr(search, "written", lambda frame, name: kept.setdefault((name, len(kept)), real(frame, name)))
    monkeypatch.setattr(search, "cleared", lambda spark: contextlib.nullcontext(lambda df: df))
    once = search.similar(df, F.col("doc_id") % 50 == 0).collect()
    asked = next(f for (name, _), f in kept.items() if name == "asked")
    assert asked.count() == asked.select("q", "term").distinct().count() == sum(len(set((t or "").split())) for i, t in docs[:-1] if i % 50 == 0)
    monkeypatch.setattr(search, "best", functools.partial(search.best, block=600))
    assert sorted(search.similar(df, F.col("doc_id") % 50 == 0).collect()) == sorted(once) and len(once) == 8 * 5


def test_postings_are_not_gathered_by_document(spark, monkeypatch, tmp_path):
    """Ids of their own: postings go from the tokenised rows to their buckets; an id that is there again has the terms of all its rows."""
    monkeypatch.setattr(index, "cleared", lambda spark: contextlib.nullcontext())
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    postings, sizes = index._entries(frame([(1, "aa bb aa"), (2, None), (None, "aa")]), tokens, "doc_id", "text")
    assert all("Exchange" not in d._jdf.queryExecution().executedPlan().toString() for d in (postings, sizes))
    assert sorted(sizes.collect()) == [(1, 3), (2, 0)]
    postings, sizes = index._entries(frame([(1, "aa bb"), (1, "aa"), (2, ""), (2, None), (3, "cc")]), tokens, "doc_id", "text")
    assert sorted(tuple(r) for r in postings.select("doc_id", "dl", "term", "tf").collect()) == [(1, 3, "aa", 2), (1, 3, "bb", 1), (3, 1, "cc", 1)]
    assert sorted(tuple(r) for r in sizes.collect()) == [(1, 3), (2, 0), (3, 1)]


def test_an_index_after_changes_is_one_built_anew(spark, tmp_path):
    docs = corpus(5)
    schema, path = "doc_id long, text string", str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(i, t) for i, t in docs[::20]] + [(1000, "w1 w2 w3")], "query_id long, query string")
    assert not index.populated(spark, path)
    index.upsert(frame(docs[:100]), path, tokens)
    index.upsert(frame([*docs[100:], (3, "w1 w1 w9"), (None, "w1")]), path, tokens)
    index.remove(spark.createDataFrame([(7,), (9,), (None,), (12345,)], "doc_id long"), path)
    index.upsert(frame([(9, "w2 again")]), path, tokens)
    now = {i: t for i, t in docs} | {3: "w1 w1 w9", 9: "w2 again"}
    del now[7]
    want = hits(search.search(frame(list(now.items())), queries, tokens))
    assert hits(index.search(path, queries, tokens)) == want
    assert len(index.segments(spark, path)) == 4
    # A segment without its last table is not there.
    frame([(1, "w1")]).write.parquet(f"{path}/segment=5/docs")
    assert hits(index.search(path, queries, tokens)) == want
    assert index.merge(spark, path) == 6 and index.segments(spark, path) == [6]
    assert hits(index.search(path, queries, tokens)) == want
    index.rebuild(frame(list(now.items())), path, tokens)
    assert hits(index.search(path, queries, tokens)) == want
    index.remove(frame(list(now.items())).select("doc_id"), path)
    assert not index.populated(spark, path) and index.search(path, queries, tokens).count() == 0


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    index.upsert(spark.createDataFrame(corpus(8), "doc_id long, text string"), path, tokens)
    own = [r.b for r in spark.createDataFrame([("w1",), ("w5",)], "t string").select(index.bucket(F.col("t")).alias("b")).collect()]
    read = lambda b: {r[0] for r in index.live_postings(spark, path, b).select(F.input_file_name()).distinct().collect()}
    assert all(any(f"bucket={b}/" in f for b in own) for f in read(own)) and len(read(own)) < len(read(None))
    assert "PartitionFilters: [bucket#" in index.live_postings(spark, path, own)._jdf.queryExecution().executedPlan().toString()


def test_an_empty_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame(corpus(9, 40), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "unheard of")], "query_id long, query string")
    spare = lambda q: q.select("query_id", F.lit(99).cast("long").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    out = index.search_chain(str(tmp_path / "i"), queries, docs, tokens, spare).collect()
    assert {r.via for r in out if r.query_id == 1} == {"index"} and [(r.id, r.via) for r in out if r.query_id == 2] == [(99, "scan")]
    assert index.segments(spark, str(tmp_path / "i")) == [1]
    index.search_chain(str(tmp_path / "i"), queries, docs, tokens, spare)
    assert index.segments(spark, str(tmp_path / "i")) == [1]


def test_snippets_of_hits(spark):
    """Every hit with its text: words whole, signs without word bounds, signs of two units before the match, texts that are gone, queries without terms."""
    docs = spark.createDataFrame([
        (1, "Alphabet alpha beta, ALPHA_x and Beta.", "a"), (2, "我们研究市场波动率", "b"), (3, "🙂" * 40 + " alpha " + "z" * 300, "c"), (4, None, "d"), (5, "üalpha", "e"),
    ], "doc_id long, text string, kind string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "市场"), (3, "!")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 1, 2.0), (1, 3, 2, 1.0), (1, 9, 3, 0.5), (1, 4, 4, 0.4), (1, 5, 5, 0.3), (2, 2, 1, 1.0), (3, 1, 1, 0.1)], "query_id long, doc_id long, rank int, score double")
    got = {(r.query_id, r.doc_id): (r.snippet, r.what, r.rank) for r in search.snippets(hits, queries, docs, ft.search_tokens, what="kind").collect()}
    assert len(got) == 7
    assert got[1, 1] == ("Alphabet >>>alpha<<< >>>beta<<<, ALPHA_x and >>>Beta<<<.", "a", 1)
    assert got[1, 3][0] == "🙂" * 19 + " >>>alpha<<< " + "z" * 94 and got[1, 9] == (None, None, 3) and got[1, 4][0] is None and got[1, 5][0] == "ü>>>alpha<<<"
    assert ">>>市场<<<" in got[2, 2][0] and got[3, 1][0].startswith("Alphabet alpha")


def test_a_search_keeps_postings_of_asked_terms_alone(spark, monkeypatch):
    """What is written and dealt out for a search holds no term that no query asks for, lengths stay whole; more terms than may be listed give the same hits."""
    docs = [*corpus(4), (900, None), (901, "nobody asks"), (None, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, "w5 unheard"), (3, None)], "query_id long, query string")
    real, kept = search.written, {}
    monkeypatch.setattr(search, "written", lambda frame, name: kept.setdefault((name, len(kept)), real(frame, name)))
    monkeypatch.setattr(search, "cleared", lambda spark: contextlib.nullcontext(lambda df: df))
    got = hits(search.search(df, queries, tokens))
    rows = next(f for (name, _), f in kept.items() if name == "forward").collect()
    assert {t.term for r in rows for t in r.terms} == {"w1", "w2", "w3", "w5"}
    assert sorted((r.doc_id or -1, r.dl) for r in rows) == sorted((i or -1, len((t or "").split())) for i, t in docs)
    kept.clear()
    assert hits(search.search(df, queries, tokens, listed=4)) == got and set(got) == {1, 2}
    rows = next(f for (name, _), f in kept.items() if name == "forward").collect()
    assert "nobody" in {t.term for r in rows for t in r.terms}
    assert search.search(df, queries.where("query is null"), tokens).count() == 0


def test_words_are_counted_in_batches_and_not_by_position(spark):
    texts = {1: "the cat the Cat é_x the 日本 日本", 2: "", 3: None, 4: "zz aa zz", 5: "of"}
    made = search.forward(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), tokens)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_extract_all") == 1
    got = {r.doc_id: (r.dl, [tuple(t) for t in r.terms]) for r in made.collect()}
    assert got == {1: (6, [("_x", 1), ("cat", 2), ("the", 3)]), 2: (0, []), 3: (0, []), 4: (3, [("aa", 1), ("zz", 2)]), 5: (1, [("of", 1)])}
