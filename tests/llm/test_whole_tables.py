"""Operators without SQL against brute force over the whole smallest tables, and on shapes that once went wrong."""

import collections
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.llm import decision_list, decontaminate, hilbert_shards, jaccard_join, quality_crf, queries, secret_markov, shingles, token_counts, url_filter

from .test_operators import brute_base, brute_base_spans, texts_of


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


def test_lower_case_is_one_for_one():
    long, plain = (set(shingles.words(t)[0].tolist()) for t in ("İ Hello World from THE Big City", "i hello world from the big city"))
    assert long == plain
    hashes, starts, ends = shingles.words("ẞİ Ab")
    assert len(hashes) == 2 and list(zip(starts, ends)) == [(0, 2), (3, 5)]


def test_held_out_quality(spark, small):
    """Documents of the fold that is not learned from, and a row without id."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = [r for r in queries.op1_quality(spark, small).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in got if labels[r.doc_id] == k] for k in (1, 0))
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.9
    assert not spark.range(1).select((~quality_crf.is_training(F.lit(None).cast("long"))).alias("h")).first().h


def test_decontamination_matches_alignment_of_whole_documents(spark, small, docs):
    items = {r.item_id: shingles.words(r.text or "")[0] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op3_decontaminate(spark, small).collect()}
    want = {}
    for k, t in texts_of(docs).items():
        w = shingles.words(t)[0][:4000]  # the longest texts at their head: those found beyond it are looked up alone
        for i, item in items.items():
            if len(np.intersect1d(w, item)) * 2 >= len(set(item.tolist())) and (score := decontaminate.align(item, w) / (2 * len(item))) >= 0.5:
                want[k, i] = score
    assert {k: v for k, v in want.items() if got.get(k) is None or abs(got[k] - v) > 1e-9 and v > got[k]} == {}
    whole = texts_of(docs)
    for k, i in set(got) - set(want):
        assert decontaminate.align(items[i], shingles.words(whole[k])[0]) / (2 * len(items[i])) >= 0.5


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_recall_of_edited_items(spark, rate):
    """Words replaced at this rate, in documents of common words: of those whose whole text aligns with the item, nine tenths are found, and no others.

    Among the items one of 3,000 words, which must not widen the others' passages."""
    rng = np.random.default_rng(int(100 * rate))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    common = [word() for _ in range(300)]
    items = [[word() for _ in range(40)] for _ in range(60)] + [[word() for _ in range(3000)]]
    filler = lambda n: rng.choice(common, n).tolist()
    edited = [[w if rng.random() > rate else word() for w in item] for item in items]
    rows = [(i, " ".join([*filler(200), *e, *filler(200)])) for i, e in enumerate(edited)] + [(1000 + i, " ".join(filler(400))) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    hashes = lambda t: shingles.words(t)[0]
    want = {(i, i) for i, w in enumerate(items) if decontaminate.align(hashes(" ".join(w)), hashes(rows[i][1])) >= len(w)}
    print(f"rate {rate}: {len(want)} of {len(items)} reach the threshold, found {len(got)}")
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > (30 if rate < 0.3 else 10)


def test_passages_reach_as_far_as_their_own_items():
    hits, reach = np.array([10, 500, 520, 5000]), np.array([20, 20, 20, 3000])
    assert [(part.tolist(), a, b) for part, a, b in decontaminate.around(hits, reach, 3)] == [([0], 0, 33), ([1, 2], 480, 543), ([3], 2000, 8003)]


def test_blocks_of_items_are_bounded(spark):
    rows = [(i, [int(x) for x in range(i * 100, i * 100 + n)], [0] * n) for i, n in enumerate([90, 5, 5, 40, 300, 60, 7, 8])]
    tests = spark.createDataFrame(rows, "item_id long, words array<long>, seeds array<long>")
    blocks = [[(r.item_id, len(r.seeds)) for r in b.collect()] for b in decontaminate.in_blocks(tests, 100)]
    assert sorted(x[0] for b in blocks for x in b) == list(range(8)) and all(sum(n for _, n in b) <= 100 or len(b) == 1 for b in blocks)


def test_addresses_match_a_plain_join(spark):
    """One address in a third of all rows, rows without address, nulls."""
    urls = [f"https://a.com/{i % 40}" if i % 3 else "http://www.a.com/hot.html?x=1" for i in range(600)] + [None, "no scheme", "x://", "x://?q"] * 20
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("a.com/hot",), ("a.com/7",), ("b.com/1",), (None,)], "key string")
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    hit = lambda u: bool(u) and (u.split("?")[0].endswith("/hot.html") or u == "https://a.com/7")
    assert got == {i: (hit(u), "block" if hit(u) else "allow") for i, u in enumerate(urls)}


def test_token_counts_match_one_token_at_a_time(spark, small, docs):
    import public_tokenizers

    encoder, _ = token_counts.byte_encoder(queries.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = collections.defaultdict(dict)
    for r in queries.op5_token_counts(spark, small).collect():
        got[r.doc_id][r.section] = (r.start, r.stop, r.n_tokens)
    for k, t in texts_of(docs).items():
        raw, lines = t.encode(), t.splitlines(keepends=True) if not set(t) & set("\r\v\f\x1c\x1d\x1e\x85\u2028\u2029") else [x + "\n" for x in t.split("\n")[:-1]] + [x for x in t.split("\n")[-1:] if x]
        ends = np.cumsum([len(x) for x in lines] or [0])
        line_of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        char_of = np.repeat(np.arange(len(t)), [len(c.encode()) for c in t])
        counts, at = collections.Counter(), 0
        for token in encoder.encode(t, disallowed_special=()):
            n = len(encoder.decode_single_token_bytes(token))
            chars = sorted(set(char_of[at : at + n].tolist()))
            votes = collections.Counter(line_of[c] for c in chars)
            counts[min(votes, key=lambda s: (-votes[s], s))] += 1
            at += n
        assert at == len(raw)
        assert got[k] == {i: (int(e - len(x)), int(e), counts[i]) for i, (x, e) in enumerate(zip(lines or [""], ends))}


def test_verdict_of_the_learned_rules(spark, small, docs):
    """Rules as they were learned, applied to statistics counted in Python."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = decision_list.learn(decision_list.labelled_statistics(decision_list.statistics(docs), labels))
    assert rules
    texts = texts_of(docs)
    for r in queries.op6_quality_rules(spark, small).collect():
        t = texts[r.doc_id]
        n, chars, symbols, dup, repeat = brute_base(t)
        words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        share = lambda a, b: a / max(b, 1)
        s = {
            "n_words": n, "n_lines": len(lines), "mean_word": share(chars, max(n, 1)), "symbol_share": share(symbols, chars), "mark_share": share(sum(c in "!?" for c in t), chars),
            "digit_share": share(sum(c in "0123456789" for c in t), chars), "upper_share": share(sum(unicodedata.category(c) == "Lu" for c in t), chars),
            "dup_line_share": share(dup, len(lines)), "repeat_share": share(repeat, n), "distinct_share": share(len(set(words)), n),
        }
        first = next((i for i, rule in enumerate(rules, 1) if all(s[c] > cut if op == ">" else s[c] <= cut for c, op, cut in rule)), None)
        assert (r.rule, r.kept) == (first, first is None and not r.base_failed)


def test_texts_with_one_head_are_told_apart(spark):
    rows = [(i, f"https://site-{i % 50:02d}.example", i % 7, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")
    assert len(hilbert_shards.text_bounds(df, "source", 16)) == 15
    shards = {r.doc_id: r.shard for r in hilbert_shards.place(df, ["source", "n_chars"]).collect()}
    touched = [len({shards[i] for i in range(2000) if i % 50 == s}) for s in range(50)]
    assert np.mean(touched) <= 8  # a filter on one source leaves half of the shards, or more, unread


def test_a_cell_with_most_rows_is_split(spark):
    rows = [(i, "same" if i % 3 else f"s{i % 9}", "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = hilbert_shards.place(df, ["source"], bucket_rows=20).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(16) for i in range(sizes[s])]


def test_contraction_with_hubs(spark):
    """A star with more edges than a task is given, chains and pairs."""
    edges = [(1, i) for i in range(2, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(6001, 6000), (2999, 7000)]
    got = {r.rep: r.class_id for r in jaccard_join.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(2, 3000), 7000]}, **{i: 5000 for i in range(5001, 5041)}, 6001: 6000}


def test_secret_spans_match_every_stretch(spark, small, docs):
    """Base spans by a plain scan; what the models add is above the threshold, outside of base spans, and no other stretch is."""
    ratio = secret_markov.train(docs)
    code = secret_markov.Markov.CODE

    def score(run):
        c = code[np.frombuffer(run.encode(), np.uint8)]
        return float(np.sum(ratio[np.concatenate([[len(secret_markov.LETTERS)], c[:-1]]), c] - 1.0))

    texts = texts_of(docs)
    for r in queries.op9_secrets(spark, small).collect():
        t, spans = texts[r.doc_id], [s.split(":") for s in r.spans.split(",") if s]
        own = [(int(a), int(b)) for k, a, b in spans if k == "markov"]
        base = [(int(a), int(b)) for k, a, b in spans if k != "markov"]
        assert sorted(base) == sorted((s, e) for s, _, e in brute_base_spans(t)) and len(own) == r.n_markov
        assert all(e - s >= 12 and score(t[s:e].rstrip("=")) > -1e-6 for s, e in own)
        assert all(e <= a or b <= s for s, e in own for a, b in base)


def test_planted_secrets_of_every_alphabet_and_length(spark, small, docs):
    """A string by rule after each whole text: of 16 characters and more nearly all are found in every alphabet, in one span that covers them, and nothing else is."""
    ratio = secret_markov.train(docs)
    lengths = (16, 20, 24, 32, 40)
    rng, planted = random.Random(11), {}
    for k in sorted(r.doc_id for r in docs.select("doc_id").collect()):
        for i, alphabet in enumerate(secret_markov.ALPHABETS):
            planted[k, i] = "".join(rng.choices(alphabet, k=lengths[(k + i) % len(lengths)]))
    whole = texts_of(docs)
    rows = [(k * 100 + i, f"{whole[k]} seen {w} then") for (k, i), w in planted.items()]
    got = {r.doc_id: r for r in secret_markov.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), ratio).collect()}
    found, others = collections.defaultdict(list), 0
    for key, text in rows:
        k, i = divmod(key, 100)
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in got[key].spans.split(",") if s)]
        at = len(text) - len(" then") - len(planted[k, i])
        found[i, len(planted[k, i])].append(any(a <= at and b >= at + len(planted[k, i]) for a, b in spans))
        others += sum(b <= at - len(" seen") for a, b in spans) - len(secret_markov.base_spans(text[: at - len(" seen")]))
    recall = {key: np.mean(hits) for key, hits in found.items()}
    assert others == 0 and min(recall.values()) > 0.7 and np.mean([x for x in recall.values()]) > 0.93
