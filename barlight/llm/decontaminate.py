"""Benchmark decontamination: rare word n-grams as seeds, local alignment of what they find.

1. Words and n-grams of the test items are counted over all documents. The median count of an item's n-grams says how
   often it was copied; the words of so many copies are taken off. An n-gram is rare if the shares of its words in the rest, multiplied,
   give less than `rare`, or less than one in the rest: how often it would come up by chance, whatever the number of leaked
   copies. The `least` rarest of an item are seeds however frequent they are.
2. Documents keep, for each rare n-gram they share with some item, its hash and place; places that are closer than the
   longest item with such an n-gram form a passage. Passages join the items on the seeds' hashes.
3. Smith-Waterman over words aligns passage and item (match 2, mismatch -1, gap -1). The score is its share of the item's own
   alignment, 2 x words. From `threshold` on the document is contaminated by the item.

The seeds of the test set are broadcast while they are few (checked against `most_seeds`); a larger set is taken in
blocks of items with no more seeds each (or of one item), each block against all documents: two scans of them a block.

Defined cases: null or empty documents and items hold no seed; an item with fewer words than a seed has all of them as its
seed, one of a single word has none and is never found (`unsearchable` lists such items); repeated documents are judged each by themselves and reported once for an id; an empty table gives an empty result;
other columns are ignored. Rows without id are reported under a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import written
from barlight.llm.shingles import U, grams, words
from barlight.sources.scratch import cleared


def item_words(items: DataFrame, n: int) -> DataFrame:
    """item_id, n_words, words (their hashes), seeds (hashes of its n-grams, by place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t or "")[0] for t in batch.column("text").to_pylist()]
            seeds = [grams(w, n) if len(w) > 1 else w[:0] for w in found]
            signed = lambda arrays: pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))
            columns = [batch.column("item_id"), pa.array([len(w) for w in found], pa.int32()), signed(found), signed(seeds)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "n_words", "words", "seeds"])

    return items.mapInArrow(run, "item_id long, n_words int, words array<long>, seeds array<long>")


def unsearchable(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, reason (no words, one word) of the items that no document can be found to hold, a row each: a single word that a text shares with an item says nothing of where it is from."""
    known = item_words(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")), 2)
    return known.where("n_words < 2").select("item_id", F.when(F.col("n_words") == 0, "no words").otherwise("one word").alias("reason"))


def places(w: np.ndarray, seeds: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of so many words are among seeds (sorted hashes, not empty), in order, and which seeds they are."""
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for n in lengths:
        if len(w) >= n:
            g = grams(w, n)
            hit = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, g), len(seeds) - 1)] == g)
            at.append(hit)
            found.append(g[hit])
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


def occurrences(docs: DataFrame, vocabulary: np.ndarray, seeds: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each of these words and seeds (sorted hashes) occurs in all documents, and the number of all words."""
    n = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(n + len(seeds), np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    w = words(text.as_py())[0]
                    total += len(w)
                    at = np.searchsorted(vocabulary, w)
                    at[at == n] = 0
                    counts[:n] += np.bincount(at[vocabulary[at] == w], minlength=n)
                    np.add.at(counts, n + np.searchsorted(seeds, places(w, seeds, lengths)[1]), 1)
        kept = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(counts[kept], total))], ["word", "k"])

    out, total = np.zeros(n + len(seeds), np.int64), 0
    for batch in docs.mapInArrow(run, "word long, k long").groupBy("word").agg(F.sum("k").alias("k")).toArrow().to_batches():  # words and seeds of one block of items
        word, k = batch.column("word").to_numpy(), batch.column("k").to_numpy()
        out[word[word >= 0]] = k[word >= 0]
        total += int(k[word < 0].sum())
    return out[:n], out[n:], total


def rare_seeds(item: np.ndarray, grams_: np.ndarray, vocabulary: np.ndarray, counts: np.ndarray, every: np.ndarray, met: np.ndarray, total: int, rare: float, least: int) -> np.ndarray:
    """The seeds of one item (words and n-grams by place) that the rest of the corpus would hold less often than `rare`, and its `least` rarest."""
    copies = float(np.median(met[np.searchsorted(every, grams_)]))
    _, which, times = np.unique(item, return_inverse=True, return_counts=True)
    rest = max(1.0, total - copies * len(item))
    share = np.maximum(counts[np.searchsorted(vocabulary, item)] - copies * times[which], 0) / rest
    chance = np.convolve(np.log(np.maximum(share, 1e-12)), np.ones(len(item) - len(grams_) + 1), "valid")
    kept = chance < np.log(max(rare, 1 / rest))
    kept[np.argsort(chance, kind="stable")[:least]] = True
    return grams_[kept]


def around(hits: np.ndarray, reach: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """hits: places in order, reach: words around each. The runs of hits whose surroundings meet, with their first word and the one after the last."""
    starts, ends = np.maximum(hits - reach, 0), hits + longest + reach
    order = np.argsort(starts, kind="stable")
    upto = np.maximum.accumulate(ends[order])
    cuts = np.flatnonzero(starts[order][1:] > upto[:-1]) + 1
    for part in np.split(np.arange(len(hits)), cuts):
        yield order[part], int(starts[order[part[0]]]), int(upto[part[-1]])


def passages(docs: DataFrame, seeds: np.ndarray, lengths: list[int], reach: np.ndarray) -> DataFrame:
    """Passages of docs around seeds (sorted hashes; reach: words around each): doc_id, row, passage, words, found (seeds in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, number, kept, found = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                if not text.is_valid:
                    continue
                w = words(text.as_py())[0]
                hits, g = places(w, seeds, lengths)
                if not len(hits):
                    continue
                for i, (part, first, stop) in enumerate(around(hits, reach[np.searchsorted(seeds, g)], lengths[-1])):
                    source.append(row)
                    number.append(i)
                    kept.append(w[first:stop].tobytes())
                    found.append(np.unique(g[part]).view(np.int64))
            columns = [batch.column("doc_id").take(pa.array(source, pa.int32())), pa.array(number, pa.int32()), pa.array(kept, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "passage", "words", "found"])

    return docs.mapInArrow(run, "doc_id long, passage int, words binary, found array<long>")


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment of two word sequences; one row of b at a time.

    A gap costs one for each word, so along a row the best gap is a running maximum of score plus place.
    """
    best, row, place = 0, np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for word in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == word, 2, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + place) - place, 0)
        best = max(best, int(row.max()))
    return best


def find(docs: DataFrame, items: DataFrame, n: int = 3, rare: float = 1e-7, threshold: float = 0.5, most_seeds: int = 500_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 8) -> DataFrame:
    """doc_id, item_id, score of every contaminated document and item, the best score if they meet more than once."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with cleared(docs.sparkSession) as keep:
        tests = written(item_words(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")), n), "items")
        return keep(written(_find(given, tests, n, rare, least, threshold, most_seeds), "found"))


def _find(given: DataFrame, tests: DataFrame, n: int, rare: float, least: int, threshold: float, most_seeds: int) -> DataFrame:
    out = None
    for some in in_blocks(tests, most_seeds):
        part = _find_block(given, some, n, rare, least, threshold)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return given.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def in_blocks(tests: DataFrame, most_seeds: int) -> Iterator[DataFrame]:
    """tests in blocks whose seeds are most_seeds at most, or those of a single item."""
    parts = max(1, 4 * -(-(tests.agg(F.sum(F.size("seeds"))).first()[0] or 0) // most_seeds))
    while True:
        part = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts))
        sizes = tests.groupBy(part.alias("part")).agg(F.sum(F.size("seeds")).alias("seeds"), F.count_distinct("words").alias("n")).orderBy("part").collect()  # `parts` rows
        if all(r.seeds <= most_seeds or r.n == 1 for r in sizes):
            break
        parts *= 2
    first, total = 0, 0
    for r in sizes:
        if total and total + r.seeds > most_seeds:
            yield tests.where(part.between(first, r.part - 1))
            first, total = r.part, 0
        total += r.seeds
    if total:
        yield tests.where(part >= first) if first else tests


def _find_block(docs: DataFrame, tests: DataFrame, n: int, rare: float, least: int, threshold: float) -> DataFrame:
    rows = tests.select("words", "seeds").where(F.size("seeds") > 0).collect()  # most_seeds bounds this block
    if not rows:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    own = [(np.array(r.words, np.int64).view(U), np.array(r.seeds, np.int64).view(U)) for r in rows]
    vocabulary, every = (np.unique(np.concatenate(x)) for x in zip(*own))
    lengths = sorted({min(n, len(w)) for w, _ in own})
    counts, met, total = occurrences(docs, vocabulary, every, lengths)
    chosen = [rare_seeds(w, g, vocabulary, counts, every, met, total, rare, least) for w, g in own]
    seeds = np.unique(np.concatenate(chosen))
    reach = np.zeros(len(seeds), np.int64)
    for (w, _), g in zip(own, chosen):
        np.maximum.at(reach, np.searchsorted(seeds, g), len(w))
    near = passages(docs, seeds, lengths, reach)
    of_item = F.broadcast(tests.select("item_id", F.explode(F.array_distinct("seeds")).alias("seed")))  # most_seeds rows at most
    met = near.withColumn("seed", F.explode("found")).drop("found").join(of_item, "seed")
    pairs = met.groupBy("doc_id", "passage", F.xxhash64("words").alias("_words"), "item_id").agg(F.first("words").alias("passage_words"))
    pairs = pairs.join(F.broadcast(tests.select("item_id", F.col("words").alias("item_words"))), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for words_, item in zip(batch.column("passage_words"), batch.column("item_words")):
                own = np.array(item.as_py(), np.int64).view(U)
                scores.append(align(own, np.frombuffer(words_.as_py(), U)) / (2 * len(own)))
            columns = [batch.column("doc_id"), batch.column("item_id"), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score"]).filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return pairs.select("doc_id", "item_id", "passage_words", "item_words").mapInArrow(run, "doc_id long, item_id long, score double")
