"""URL filter: a blocked Bloom filter lets possible hits through to an exact join with the list.

The filter is a table of blocks of 512 bits, each held as eight 64-bit words; a canonical URL's hash picks one block and
one bit in `probes` of its words, so a probe reads one row. Its size is chosen from the list's count and never
passes `most_blocks`; beyond that only the share of false hits grows. Rows that the filter stops are never shuffled, nor are those
without an address. The addresses of the others, each once, meet the list in an exact hash join, so
verdicts do not depend on the filter; what is listed goes back to their rows by (address, salt), so that a repeated URL is many tasks.

Defined cases: a null URL or one without `://` has empty host and path and is never listed; repeated rows get the same
verdict; an empty list blocks nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule text and verdict.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBES = 4
SALTS = 16  # tasks that the rows of one address are dealt to


def host(url: Column) -> Column:
    """After the first ://, up to one of / ? # or the end; A to Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One text for the forms of an address: no scheme, www., query, fragment, .html or closing slash. Null without host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    texts, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest last, so tried first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        texts, verdicts = F.when(fits, F.lit(rule)).otherwise(texts), F.when(fits, F.lit(verdict)).otherwise(verdicts)
    return texts, verdicts


def probe(key: Column, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """Block of a key, and for each probe its word and bit there; from two 64-bit hashes."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    part = lambda at, bits: F.shiftrightunsigned(b, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.pmod(a, F.lit(blocks)), [(part(9 * i + 6, 3), part(9 * i, 6)) for i in range(PROBES)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """listed: column key. Rows of block, words (eight longs)."""
    block, masks = probe(F.col("key"), blocks)
    one = F.lit(1).cast("long")
    words = [reduce(lambda x, y: x.bitwiseOR(y), [F.when(w == i, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("long")) for w, bit in masks]) for i in range(8)]
    return listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def screened(keys: DataFrame, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Rows of keys (column key) with maybe: whether the filter lets them through."""
    block, masks = probe(F.col("key"), blocks)
    words = F.array(*[F.col(f"w{i}") for i in range(8)])
    table = F.broadcast(filter_table.select(F.col("block").alias("_block"), words.alias("_words")))  # at most most_blocks rows of 72 bytes
    met = keys.withColumn("_block", block).join(table, "_block", "left")
    hit = reduce(lambda x, y: x & y, [F.call_function("getbit", F.element_at("_words", word + 1), bit) == 1 for word, bit in masks])
    return met.select(*keys.columns, (F.col("key").isNotNull() & F.coalesce(hit, F.lit(False))).alias("maybe"))


def possible(keys: DataFrame, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Rows of keys that the filter lets through."""
    return screened(keys, filter_table, blocks).where("maybe").drop("maybe")


def blocks_for(n: int, most_blocks: int = 1 << 18, bits_per_key: int = 16) -> int:
    return max(1, min(most_blocks, -(-n * bits_per_key // 512)))


def may_have(docs: DataFrame, doc_id: str, ids: DataFrame, name: str) -> DataFrame:
    """row (all of docs) and maybe: false only where the id is not among ids. The filter spares the other rows a shuffle."""
    blocks = blocks_for(ids.count())
    table = bloom(ids.select(F.col(name).alias("key")), blocks)
    return screened(docs.select(F.col(doc_id).cast("long").alias("key"), F.struct(*docs.columns).alias("row")), table, blocks)


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", most_blocks: int = 1 << 18, bits_per_key: int = 16) -> DataFrame:
    """listed: column key of canonical URLs. Returns page_id, host, path, rule, verdict, listed."""
    given = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    keyed = given.withColumn("key", canonical(F.col("host"), F.col("path")))
    names = listed.where(F.col("key").isNotNull()).select("key").distinct()
    n = names.count()
    blocks = blocks_for(n, most_blocks, bits_per_key)
    marked = screened(keyed, bloom(names, blocks), blocks)
    near = marked.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int"))
    hits = near.select("key").distinct().join(names, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("listed", F.lit(True))
    met = near.join(hits, ["key", "salt"], "left").select(*keyed.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    out = met.unionByName(marked.where("not maybe").select(*keyed.columns, F.lit(False).alias("listed")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
