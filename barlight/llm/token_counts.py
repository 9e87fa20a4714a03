"""Token counts by section from one encoding of the whole document.

A document is encoded once, every token gets the characters it covers, and the sorted token spans are
interval-joined to the sorted section spans of the same document. Rule for a token that crosses a boundary:
`overlap` (it counts for the section that holds most of its characters, the earlier one if equal) or `start`
(the section that holds its first character). Tokens outside every section are counted by none.

Defined cases: null text is empty; an empty text has one empty section with no tokens; repeated rows are
counted each by themselves (with given sections, those of the id go to every copy of the row); an empty table gives
an empty result; other columns are ignored. Section spans of one document must not overlap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long"


@lru_cache(1)
def byte_encoder(path: str, pattern: str):
    """The byte-level BPE of a rank file, and how many bytes each id stands for; one for all tasks of a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(ids: np.ndarray, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last one of each token; a split character counts for each part."""
    ends = np.cumsum(size[ids])
    begins = ends - size[ids]
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[begins], char[ends - 1] + 1


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted for each section, and how many of them reach beyond it."""
    n = len(starts)
    a = np.searchsorted(stops, first, "right")  # the first section that ends after the token's first character
    b = np.searchsorted(starts, last, "left") - 1  # the last one that starts before its end
    inside = (a == b) & (a < n)
    inside[inside] = (starts[a[inside]] <= first[inside]) & (last[inside] <= stops[a[inside]])
    counts = np.bincount(a[inside], minlength=n)
    crossing = np.zeros(n, np.int64)
    for k in np.flatnonzero(~inside):
        near = range(a[k], min(b[k], n - 1) + 1)
        if rule == "start":
            own = [s for s in near if starts[s] <= first[k] < stops[s]][:1]
        else:
            share = [(min(stops[s], last[k]) - max(starts[s], first[k]), -s) for s in near]
            own = [-max(share)[1]] if share and max(share)[0] > 0 else []
        for s in own:
            counts[s] += 1
            crossing[s] += 1
    return counts, crossing


def line_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with the line break that ends it."""
    data = np.frombuffer(raw, np.uint8)
    heads = data[(data & 0xC0) != 0x80]
    breaks = np.flatnonzero(heads == 10) + 1
    cuts = np.concatenate([[0], breaks, [len(heads)]])
    if len(cuts) > 2 and cuts[-1] == cuts[-2]:
        cuts = cuts[:-1]
    return cuts[:-1], cuts[1:]


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, sections: DataFrame | None = None, rule: str = "overlap", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """sections: doc_id, start, stop (character spans); without it the lines of each text are its sections."""
    if rule not in ("overlap", "start"):
        raise ValueError(f"no such rule: {rule}")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if sections is not None:
        spans = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.array(F.col("start").cast("long"), F.col("stop").cast("long")))).alias("spans"))
        given = given.join(spans, "doc_id", "left")
    by_line = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = byte_encoder(tokenizer, pattern)
        for batch in batches:
            source, rows = [], [[np.zeros(0, np.int64)] for _ in range(5)]
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py() or ""
                raw = text.encode("utf-8")
                if by_line:
                    starts, stops = line_spans(raw)
                else:
                    pairs = np.array(batch.column("spans")[row].as_py() or [], np.int64).reshape(-1, 2)
                    starts, stops = pairs[:, 0], pairs[:, 1]
                ids = encoder.encode_to_numpy(text, disallowed_special=())
                if len(ids) and len(starts):
                    counts, crossing = allocate(*token_spans(ids, raw, size), starts, stops, rule)
                else:
                    counts = crossing = np.zeros(len(starts), np.int64)
                source.append(np.full(len(starts), row))
                for column, x in zip(rows, (np.arange(len(starts)), starts, stops, counts, crossing)):
                    column.append(x)
            ids = batch.column("doc_id").take(pa.array(np.concatenate([np.zeros(0, np.int64), *source])))
            columns = [pa.array(np.concatenate(x).astype(k)) for x, k in zip(rows, (np.int32, *[np.int64] * 4))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return given.mapInArrow(run, COUNTS)
