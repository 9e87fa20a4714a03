"""Interaction of filters: what each removes, alone and after others, in every order, from sorted posting lists.

Every document is marked with the filters that it fails. A posting list holds, for one part and one filter, the sorted ids of the failing
documents within a range of ids; documents that share id, part and marks are one entry with a count. A task has some whole ranges
of ids, in order, and merges their lists batch by batch: the union of each set of filters grows by one galloping merge from a smaller one, the
difference of a filter's list and each union is what the filter removes after that set. Only sizes leave the task. They are summed,
and all orders are read off the sums: 2^m sets instead of m! orders. An order and step is a set and a filter.

Defined cases: a null text is empty; a null part is the empty string; documents without id fail no comparison of ids and have no label; repeated rows are
each a document (equal ids: neither is the smaller); contradictory labels of an id count as either; very long texts are read in pieces;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import written
from barlight.sources.scratch import cleared

FILTERS = "ABCDE"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
INNER = bytes(range(0x80, 0xC0))  # bytes that begin no character
PIECE = 1 << 20
RANGE_IDS = 256
PART_SUMS = "part string, before int, filter int, n long, failing long, union_n long, removed long, good long, toxic long"


def counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words of a text, read in pieces that end at a space."""
    n, distinct, at = 0, set(), 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        words = raw[at:end].split()  # for bytes these are exactly the spaces above
        n += len(words)
        distinct.update(words)
        at = end
    return n, len(distinct)


def failures(raw: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    n, distinct = counts(raw)
    points = len(raw.translate(None, INNER))
    upper = len(raw) - len(raw.translate(None, UPPER))
    marked = len(raw) != len(raw.translate(None, MARKS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, id, digest (16 bytes of the text's sha256) and mask (A to D) of each document."""
    given = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for x in batch.column("raw"):
                raw = x.as_py()
                digests.append(hashlib.sha256(raw).digest()[:16])
                masks.append(failures(raw))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["part", "id", "digest", "mask"])

    return given.mapInArrow(run, "part string, id long, digest binary, mask int")


def repeats(rows: DataFrame, bit: int) -> DataFrame:
    """rows (part, id, digest, mask) as entries part, id, mask, n; the bit is set where a smaller id has the same text.

    Texts that make up over a thousandth of the rows, at most a thousand of them, are broadcast, so no text is one task.
    """
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    firsts = written(firsts, "repeats")
    many = max(1000, rows.count() // 1000)
    hot = F.broadcast(firsts.where(F.col("k") > many).drop("k"))
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    met = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(firsts.where(F.col("k") <= many).drop("k"), "digest", "left"))
    return met.groupBy("part", "id", F.when(late, F.col("mask").bitwiseOR(1 << bit)).otherwise(F.col("mask")).alias("mask")).agg(F.count("*").alias("n"))


def gallop(keys: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the first place in the sorted target that is not smaller: doubling steps from a guess of even spread, then halving."""
    if not len(target):
        return np.zeros(len(keys), np.int64)
    low = np.arange(len(keys)) * len(target) // max(len(keys), 1)
    step, back = 1, np.flatnonzero(target[low] >= keys)
    while len(back := back[(low[back] > 0) & (target[low[back]] >= keys[back])]):
        low[back] = np.maximum(low[back] - step, 0)
        step *= 2
    high, step, ahead = low.copy(), 1, np.arange(len(keys))
    while len(ahead := ahead[(high[ahead] < len(target)) & (target[np.minimum(high[ahead], len(target) - 1)] < keys[ahead])]):
        low[ahead] = high[ahead] + 1
        high[ahead] = np.minimum(high[ahead] + step, len(target))
        step *= 2
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less = target[middle] < keys[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


def difference(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are not in target, and their places there."""
    at = gallop(keys, target)
    new = (at == len(target)) | (target[np.minimum(at, len(target) - 1)] != keys) if len(target) else np.ones(len(keys), bool)
    return keys[new], at[new]


def set_sizes(lists: list[np.ndarray], weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(set, filter, size of the set's union, sizes of the filter's list without it), each set of lists and each list not in it.

    lists hold sorted places of rows of weights; sizes are sums of the first weight and of all weights.
    """
    union = {0: np.zeros(0, np.int64)}
    for s in range(1 << len(lists)):
        size = weights[union[s], 0].sum()
        for f in range(len(lists)):
            if not s >> f & 1:
                new, at = difference(lists[f], union[s])
                yield s, f, size, weights[new].sum(0)
                if s < 1 << f:  # each larger set grows from the one without its last filter
                    union[s | 1 << f] = np.insert(union[s], at, new)


def interactions(entries: DataFrame, filters: int) -> DataFrame:
    """entries: part, id, mask, n, good, toxic (whether). Sums by part, set of filters before (bits) and filter.

    n: documents of the part; failing: this filter; union_n: any filter before; removed, good, toxic: by this one after those.
    """
    ranged = entries.withColumn("range", F.coalesce(F.expr(f"id div {RANGE_IDS}"), F.lit(-1)))
    # Whole ranges of ids go to a task, many of them, and are read in order.
    dealt = ranged.repartition("part", "range").sortWithinPartitions("part", "id", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, (mask, n, good, toxic) = batch.column("part").dictionary_encode(), (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "n", "good", "toxic"))
            codes, out = parts.indices.to_numpy(), []
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                weights = np.stack([n[own], n[own] * good[own], n[own] * toxic[own]], 1)
                lists = [np.flatnonzero(mask[own] >> f & 1) for f in range(filters)]  # places in the order of ids
                failing = [int(weights[x, 0].sum()) for x in lists]
                out += [(int(code), s, f, int(weights[:, 0].sum()), failing[f], int(size), *map(int, new)) for s, f, size, new in set_sizes(lists, weights)]
            columns = list(zip(*out))
            names = parts.dictionary.take(pa.array(columns[0]))
            yield pa.RecordBatch.from_arrays(
                [names, *[pa.array(c, t) for c, t in zip(columns[1:], [pa.int32()] * 2 + [pa.int64()] * 6)]],
                ["part", "before", "filter", "n", "failing", "union_n", "removed", "good", "toxic"])

    sizes = dealt.select("part", "mask", "n", "good", "toxic").mapInArrow(run, PART_SUMS)
    return sizes.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n", "failing", "union_n", "removed", "good", "toxic")])


def in_every_order(sums: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step; sums as of interactions()."""
    m, every = len(names), (1 << len(names)) - 1
    n_before = F.bit_count("before").cast("int")
    orders_with = F.element_at(F.array(*[F.lit(factorial(i) * factorial(m - 1 - i)).cast("long") for i in range(m)]), n_before + 1)
    alone = F.col("before").bitwiseOR(F.expr("shiftleft(1, filter)")) == every
    by_filter = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders_with).alias("shapley"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"))
    steps = [("".join(names[f] for f in order), i + 1, sum(1 << f for f in order[:i]), f) for order in permutations(range(m)) for i, f in enumerate(order)]
    orders = F.broadcast(sums.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int"))  # m * m! rows
    kept = F.col("n") - F.col("union_n") - F.col("removed")
    return sums.join(by_filter, ["part", "filter"]).join(orders, ["before", "filter"]).select(
        "part", "filter_order", "step", kept.alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters over documents, labels: doc_id, quality, toxic."""
    with cleared(docs.sparkSession) as keep:
        rows = written(marked(docs, doc_id, text, part), "marked")
        entries = repeats(rows, FILTERS.index("E"))
        said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        known = entries.join(said, "id", "left").select("part", "id", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        sums = keep(written(interactions(known, len(FILTERS)), "sums"))
    return in_every_order(sums, FILTERS)


ORACLE = r"""
WITH given AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM given),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask FROM worded LEFT JOIN said USING (doc_id)),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM orders, range(1, 6) s(step)),
counted AS (SELECT s.filter_order, s.step, s.bit, m.part, count(*) FILTER (WHERE mask & (before | bit) = 0) AS kept,
  count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed, count(*) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant,
  count(*) FILTER (WHERE mask = bit) AS unique_fails, count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND good) AS good_lost,
  count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND toxic) AS toxic_lost FROM steps s, marked m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""
