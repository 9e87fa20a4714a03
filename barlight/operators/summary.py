"""Extractive summaries and keyword digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions import text as ft


def _coded(tokens: pa.Array) -> tuple[np.ndarray, ...]:
    """Of texts as lists of sentences as lists of words: sentences of each text, words of each sentence, text of each sentence, sentence and number of each word, and the different words."""
    parts = tokens.flatten()
    words = pc.dictionary_encode(parts.flatten())
    of_text, of_part = pc.list_value_length(tokens).to_numpy(), pc.list_value_length(parts).to_numpy()
    return of_text, of_part, np.repeat(np.arange(len(tokens)), of_text), np.repeat(np.arange(len(parts)), of_part), words.indices.to_numpy().astype(np.int64), words.dictionary


def _scores(tokens: pa.Array) -> pa.Array:
    """For each sentence of each text the mean over its words of ln(sentences / (1 + sentences with the word)); 0 without words."""
    of_text, of_part, text, part, word, names = _coded(tokens)
    each, k = np.unique(part * max(len(names), 1) + word, return_counts=True)
    part, word = np.divmod(each, max(len(names), 1))
    _, at, df = np.unique(text[part] * max(len(names), 1) + word, return_inverse=True, return_counts=True)
    sums = np.bincount(part, k * np.log(of_text[text[part]] / (1 + df[at])), len(of_part))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(of_text)]).astype(np.int32), pa.array(sums / np.maximum(of_part, 1)))


def _terms(tokens: pa.Array, k: int) -> pa.Array:
    """For each text its k best words by count times ln(sentences / (1 + sentences with the word)); ties in order of first occurrence."""
    of_text, _, text, part, word, names = _coded(tokens)
    n = max(len(names), 1)
    own, first, at, tf = np.unique(text[part] * n + word, return_index=True, return_inverse=True, return_counts=True)
    met = np.unique(part * len(own) + at) % max(len(own), 1)
    of = own // n
    score = np.rint(tf * np.log(of_text[of] / (1 + np.bincount(met, minlength=len(own)))) * 1e9) / 1e9
    order = np.lexsort((first, -score, of))
    of = of[order]
    size = np.bincount(of, minlength=len(of_text))
    order = order[np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < k]
    rows = pa.StructArray.from_arrays([names.take(pa.array(own[order] % n)), pa.array(score[order])], ["term", "score"])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.minimum(size, k))]).astype(np.int32), rows)


def _in_parts(docs: DataFrame, text: str) -> DataFrame:
    """docs with the sentences of the text and their words: a text stays one row, in its own task."""
    return docs.withColumn("_parts", ft.sentences(F.col(text))).withColumn("_words", F.transform("_parts", ft.tokens))


def _scored(docs: DataFrame, text: str) -> DataFrame:
    score = F.arrow_udf(_scores, "array<double>")
    return _in_parts(docs, text).withColumn("_score", score("_words"))


def sentence_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, sentence, n (sentences of the text), score: mean over tokens of ln(n / (1 + sentences with the token))."""
    scored = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    each = scored.select("doc_id", F.size("_parts").cast("long").alias("n"), F.posexplode(F.arrays_zip("_parts", "_score")).alias("pos", "x"))
    return each.select("doc_id", "pos", F.col("x._parts").alias("sentence"), "n", F.round("x._score", 9).alias("score"))


def summarised(docs: DataFrame, keywords: Column | None = None, middle: int = 5, text: str = "text") -> DataFrame:
    """docs with summary, n_sentences and kept: first, last and the best middle sentences in text order; short texts stay whole."""
    head = F.coalesce(keywords, F.lit("")) if keywords is not None else F.lit("")
    n = F.size("_parts")
    ranked = F.array_sort(F.transform(F.slice("_score", F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct((0.0 - F.round(x, 9)).alias("low"), (i + 1).alias("pos"))))
    best = F.array_sort(F.transform(F.slice(ranked, 1, middle), lambda x: x["pos"]))
    every = F.transform("_parts", lambda _, i: i)
    kept = _scored(docs.withColumn("_head", head), text).withColumn("_kept", F.when(n <= middle + 2, every).otherwise(F.concat(F.array(F.lit(0)), best, F.array(n - 1))))
    body = F.when(n <= middle + 2, ft.strip(F.coalesce(text, F.lit("")))).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_parts", i)), " "))
    made = kept.withColumn("_body", body)
    return made.select(
        *docs.columns, F.when(F.col("_head") != "", F.concat(F.lit("Keywords: "), "_head", F.lit("\n"), "_body")).otherwise(F.col("_body")).alias("summary"),
        n.cast("long").alias("n_sentences"), F.array_join(F.transform("_kept", lambda i: i.cast("string")), ",").alias("kept"))


def summaries(docs: DataFrame, keywords: Column | None = None, middle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, summary, n_sentences, kept: first, last and the best middle sentences in text order; short texts stay whole."""
    return summarised(docs, keywords, middle, text).select(F.col(doc_id).alias("doc_id"), "summary", "n_sentences", "kept")


def _best_terms(docs: DataFrame, k: int, text: str) -> DataFrame:
    best = F.arrow_udf(lambda words: _terms(words, k), "array<struct<term:string,score:double>>")
    return _in_parts(docs, text).withColumn("_best", best("_words"))


def digest_terms(docs: DataFrame, k: int = 15, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, score, rank: the k best terms by count times sentence-level idf; ties in order of first occurrence."""
    each = _best_terms(docs, k, text).select(F.col(doc_id).alias("doc_id"), F.posexplode("_best").alias("rank", "x"))
    return each.select("doc_id", "x.term", "x.score", (F.col("rank") + 1).alias("rank"))


def digested(docs: DataFrame, k: int = 15, text: str = "text") -> DataFrame:
    """docs with digest: the terms as a bullet list, null if there are none."""
    listed = F.array_join(F.transform("_best", lambda x: F.concat(F.lit("  - "), x["term"])), "\n")
    return _best_terms(docs, k, text).select(*docs.columns, F.when(F.size("_best") > 0, F.concat(F.lit("Key concepts:\n"), listed)).alias("digest"))


def digests(docs: DataFrame, k: int = 15, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest: the terms as a bullet list."""
    return digested(docs, k, text).where("digest is not null").select(F.col(doc_id).alias("doc_id"), "digest")


def due(level: Column, days: Column) -> Column:
    """Level a note is to be compressed to, else null."""
    return F.when((level == "raw") & (days > 7), "daily").when((level == "daily") & (days > 30), "digest")
