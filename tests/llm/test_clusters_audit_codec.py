"""Operators 11 to 13 against SQL, brute force and exact round trips, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from barlight.llm import centroid_clusters, filter_audit, piece_codec, queries
from tests.test_oracle import TABLES, rows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_filter_audit"])
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    assert rows(got.select(*columns).collect()) == rows(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


# 11


@pytest.mark.parametrize("spread", [3, 1000])
def test_threshold_walk_finds_the_nearest(spread):
    """Small values make many ties; the walk meets fewer pairs than there are where lists are long."""
    rng = np.random.default_rng(spread)
    centroids, v = rng.integers(-spread, spread, (60, 3)), rng.integers(-spread, spread, (500, 3))
    met = []

    class Counting(centroid_clusters.Lists):
        def meet(self, v, row, c, best, number):
            met.append(len(row))
            super().meet(v, row, c, best, number)

    number, best = Counting(centroids).nearest(v)
    want = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == want.min(1)).all() and (number == want.argmin(1)).all()
    assert sum(met) < 500 * 60
    far_number, far = centroid_clusters.Lists(centroids.astype(object)).nearest(v.astype(object) * 1)
    assert (far_number == number).all() and (far == best).all()


def test_a_tie_beyond_the_bound_is_seen():
    """Centroids 1 and 0 are equally far; number 0 stands further out in the lists and must still win."""
    number, best = centroid_clusters.Lists(np.array([[0, 5], [3, 4]])).nearest(np.array([[0, 0]]))
    assert number.tolist() == [0] and best.tolist() == [25]


def lloyd(vectors, k, rounds):
    """vectors: (id or None, integers). Sorted rows of id, cluster, distance and the centroids, by Python's integers."""
    vectors = sorted(vectors, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in vectors[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in vectors:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*own[i])] if i in own else c for i, c in enumerate(centroids)]
    return [(i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in vectors], centroids


def test_clusters_of_odd_vectors(spark):
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    good = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    good += [good[7], good[7], (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.1, 0.1, 0.1, 0.1]), (8, [0.0, 0.0, 0.0, 0.0]), (99, [1e12, -1e12, 0.0, 1.0]), (98, [5e5, 0.0, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [0.1] * 3), (53, [0.1] * 5), (54, [0.1, nan, 0.1, 0.1]), (55, [0.1, inf, 0.1, 0.1]), (56, [0.1, None, 0.1, 0.1]), (57, [-inf] * 4)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int, distance long, v int").repartition(3)
    got = centroid_clusters.cluster(table, 5, 6, 4).collect()
    integers = [(i, [max(-(2**48), min(2**48, math.floor(1024 * x))) for x in v]) for i, v in good]
    want, centroids = lloyd(integers, 5, 6)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(want, key=key)
    assert all(r.centroid == centroids[r.cluster] for r in got)
    sums = collections.Counter()
    for _, c, d in want:
        sums[c] += d
    assert all(r.cluster_inertia == min(sums[r.cluster], 2**63 - 1) and r.inertia == min(sum(min(s, 2**63 - 1) for s in sums.values()), 2**63 - 1) for r in got)
    few = centroid_clusters.cluster(table.where("vec_id < 3"), 5, 2, 4).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}
    assert centroid_clusters.digest(centroid_clusters.cluster(table.where("false"), 5, 2, 4)).collect() == []


# 12


def test_gallop_is_a_binary_search():
    rng = np.random.default_rng(0)
    for n, m in [(0, 5), (5, 0), (1, 1), (7, 300), (300, 7), (200, 200)]:
        for width in (3, 50, 10_000):
            keys, target = np.sort(rng.integers(0, width, n)), np.sort(rng.integers(0, width, m))
            assert (filter_audit.gallop(keys, target) == np.searchsorted(target, keys)).all()


def test_words_in_pieces(monkeypatch):
    text = ("aa b\x0bccc　d\tee aa é\r\n" * 50).encode()
    want = len(text.split()), len(set(text.split()))
    for piece in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        assert filter_audit.counts(text) == want
    assert filter_audit.counts(b"") == (0, 0)


def brute_audit(docs, labels):
    first, marks, said = {}, [], collections.defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, quality, toxic in labels:
        said[i] |= {"good"} & {"good" if quality == 1 else ""} | {"toxic"} & {"toxic" if toxic == 1 else ""}
    for i, t, part in docs:
        t = t or ""
        w = t.encode().split()
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and t in first and i > first[t])) if x}
        marks.append((part or "", fails, said[i] if i is not None else set()))
    out = {}
    for part in {p for p, _, _ in marks}:
        own = [(f, s) for p, f, s in marks if p == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                gone = [(x, s) for x, s in own if x & set(order[:i])]
                removed = [(x, s) for x, s in own if f in x and not x & set(order[:i])]
                out[part, "".join(order), i + 1] = [len(own) - len(gone) - len(removed), len(removed), sum(f in x for x, _ in gone), sum(x == {f} for x, _ in own), sum("good" in s for _, s in removed), sum("toxic" in s for _, s in removed)]
                total[f] += len(removed)
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                out[part, "".join(order), i + 1].append(total[f])
    return out


def test_audit_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_IDS", 4)
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n", "A", "ABC def", "a # b", long, long + " #", long.upper(), "x " * 400, "日本 " * 250, "é" * 300, long]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)] + [(5, long, "en")] * 40 + [(None, long, "en")] * 40 + [(-7, long, "fr"), (2**62, "only one", "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 30, 2), 4, 4, -7]] + [(None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m", 3) for d in docs], "doc_id long, text string, lang string, n int, mask string, part int").repartition(5)
    said = spark.createDataFrame([(*r, "g") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = filter_audit.audit(table, said)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got.collect()} == brute_audit(docs, labels)
    assert got.count() == len({d[2] or "" for d in docs}) * 600
    assert filter_audit.audit(table.where("false"), said).count() == 0
    without = filter_audit.audit(table, said.where("false")).collect()
    assert {(r.good_lost, r.toxic_lost) for r in without} == {(0, 0)}


def test_a_text_that_most_documents_share_is_many_tasks(spark, monkeypatch):
    """Copies over the bound meet their first id by broadcast; the entries are the same."""
    docs = spark.range(6000).selectExpr("'en' part", "id", "cast(if(id % 3 = 0, 'same', concat('d', id div 2)) as binary) digest", "1 mask").repartition(4)
    got = filter_audit.repeats(docs, 4).collect()
    firsts = {}
    for i in range(6000):
        firsts.setdefault("same" if i % 3 == 0 else f"d{i // 2}", i)
    assert {(r.id, r["mask"]) for r in got} == {(i, 1 | 16 * (firsts["same" if i % 3 == 0 else f"d{i // 2}"] < i)) for i in range(6000)}


# 13


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=piece_codec.read_ranks(RANKS), special_tokens={})


def test_codes_match_the_library_over_whole_documents(spark, small, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    got = queries.op13_piece_codec(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def test_codes_of_odd_texts(spark, reference, monkeypatch):
    monkeypatch.setattr(piece_codec, "GROUP_CHARS", 5000)
    rng = random.Random(2)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x250), rng.randrange(0x3000, 0xD7FF), rng.choice([0, 1, 9, 10, 13, 32, 0x1C, 0x85, 0xA0, 0x2028, 0x2581]), rng.randrange(0xE000, 0x1FFFF)]))
    texts = ["", None, " ", "\n\n  x", "<|endoftext|>", "it's 12ab don't", "#" * 50_000, "ab" * 30_000, "word " * 4000, "日本語🙂" * 2000, "▁ ▁Āǿ", *["".join(pick() for _ in range(rng.randrange(40))) for _ in range(3000)]]
    table = spark.createDataFrame([(None if i % 7 == 0 else i % 50, t, "c", [1], b"x") for i, t in enumerate(texts)], "doc_id long, text string, raw string, ids array<int>, decoded binary").repartition(3)
    got = piece_codec.decode(piece_codec.encode(table, RANKS, PATTERN), RANKS, PATTERN).collect()
    found = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got)
    assert found == collections.Counter((None if i % 7 == 0 else i % 50, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert piece_codec.encode(table.where("false"), RANKS, PATTERN).collect() == []
    broken = spark.sql("select 1L doc_id, cast(X'61FF62' as string) text")
    assert piece_codec.decode(piece_codec.encode(broken, RANKS, PATTERN), RANKS, PATTERN).first().decoded == "a�b".encode()
    assert piece_codec.decode(spark.sql("select 1L doc_id, cast(null as array<int>) ids"), RANKS, PATTERN).first().decoded == b""


def test_every_code_point_is_cut_as_by_the_library(reference):
    """Letters, digits and spaces of all of Unicode between two letters."""
    own = piece_codec.codec(RANKS, PATTERN)
    for start in range(0, 0x110000, 997):
        text = "".join(f"a{chr(c)}1 " for c in range(start, min(start + 997, 0x110000), 13) if not 0xD800 <= c < 0xE000)
        assert own.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_a_token_that_no_merge_reaches():
    """A match that is a token as a whole is that token; unused ids and missing bytes are told apart."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}
    model = piece_codec.serialised(ranks)
    assert model
    with pytest.raises(ValueError):
        piece_codec.serialised({b"a": 0})


@pytest.mark.parametrize("bad", [r"[\P{L}]", r"[\S]"])
def test_negated_class_in_brackets_is_refused(bad):
    with pytest.raises(ValueError):
        piece_codec.splitters(bad)
