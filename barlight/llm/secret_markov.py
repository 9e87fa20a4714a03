"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled samples: values that the fixed patterns find and strings drawn from
the alphabets that keys are written in (random strings), and other identifiers of the same texts, also joined by pairs and in capitals, and drawn numbers and dates (ordinary). What no fixed pattern covers is cut into runs of characters, and these
at / + = _ - into segments. The neighbouring segments with the largest sum of log-likelihood ratio less threshold, over their characters, are
a secret where that sum is above 0, as is a whole run of FULL characters or more whose sum is (a stretch shorter than FULL characters pays the threshold for as many); then the segments
on either side are tried in the same way. The sample is
about `sample_docs` different texts with a secret and as many of any kind, those with the smallest hash (all of them if there are fewer); every text
is scanned whole.

Defined cases: null text is empty and has no spans; with no labelled secrets at all the random model knows
the drawn strings alone; repeated rows are scanned each by themselves; an empty table gives an empty
result; other columns stay out of the result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of base patterns, in the order in which ties are listed, and what follows them.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST, FULL, SHORT = 12, 16, 4  # characters of a secret: at least, and those whose evidence is asked for; shorter segments beside one go with it
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SEGMENT = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
CAPITALS, SMALL, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = CAPITALS + SMALL + DIGITS + "+/_=-."
#: Alphabets that keys are written in; strings drawn from each are labelled as random, beside the values found.
ALPHABETS = [DIGITS + "abcdef", DIGITS + "ABCDEF", CAPITALS + "234567", CAPITALS + DIGITS, SMALL + DIGITS, CAPITALS + SMALL + DIGITS, CAPITALS + SMALL + DIGITS + "+/", CAPITALS + SMALL + DIGITS + "-_"]
DRAWN = 400  # strings of an alphabet, of 32 characters


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    return [ASSIGN.match(text, s)[2] if k == 0 else text[s:e] for s, k, e in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class Markov:
    """Log-probabilities of a first character and of each next one. Where few followers were seen, those of all characters together stand in (with the weight of one follower for each
    character; their own counts are add-one smoothed)."""

    CODE = np.full(256, len(LETTERS), np.int64)
    CODE[[ord(c) for c in LETTERS]] = range(len(LETTERS))

    def __init__(self, pairs: np.ndarray):
        n = len(pairs)
        whole = (pairs.sum(0) + 1.0) / (pairs.sum() + n)
        self.log = np.log((pairs + n * whole) / (pairs.sum(1, keepdims=True) + n))

    @classmethod
    def pairs(cls, counts: dict[str, int]) -> np.ndarray:
        n = len(LETTERS) + 1
        out = np.zeros((n, n))
        for word, k in counts.items():
            c = cls.CODE[np.frombuffer(word.encode("ascii", "replace"), np.uint8)]
            np.add.at(out, (np.concatenate([[n - 1], c[:-1]]), c), k)
        return out


def drawn(alphabets: list[str], seed: int = 9) -> Counter:
    """Random strings of each alphabet, the same every time."""
    rng = random.Random(seed)
    return Counter("".join(rng.choices(a, k=32)) for a in alphabets for _ in range(DRAWN))


def pairs_of(words: list[str]) -> np.ndarray:
    """Markov.pairs of words written in LETTERS, each counted as often as it is listed, and no word kept by itself: a line feed between words has the code of a start."""
    n = len(LETTERS) + 1
    c = Markov.CODE[np.frombuffer("\n".join(["", *words]).encode(), np.uint8)]
    out = np.bincount(c[:-1] * n + c[1:], minlength=n * n).reshape(n, n)
    out[:, n - 1] = 0  # from a word's last character to the line feed
    return out


def count_pairs(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """label, a, b, k: how often character b follows a in the ordinary (0) and the random (1) strings of a batch of texts. Memory: the strings of `most` neighbouring words of one text."""
    n = len(LETTERS) + 1
    for batch in batches:
        total = np.zeros((2, n, n), np.int64)
        for value in batch.column("text"):
            t = value.as_py()
            spans = base_spans(t)
            total[1] += pairs_of(secret_values(t, spans))
            at = 0
            for s, _, e in [*spans, (len(t), 0, 0)]:
                words = WORD.finditer(t, at, max(at, s))
                last, i = None, 0
                while found := [m[0] for m in islice(words, most)]:
                    joined_ = found if last is None else [last, *found]
                    paired = [a + (b[:1].upper() + b[1:] if j % 4 == 3 else "_-/"[j % 4] + b) for j, (a, b) in enumerate(zip(joined_, joined_[1:]), i)]  # as in paths and longer names
                    last, i = found[-1], i + len(paired)
                    found += paired
                    total[0] += pairs_of([*found, *[u for w in found if (u := w.upper()) != w]])
                at = max(at, e)
        where = np.nonzero(total)
        columns = [*(x.astype(np.int32) for x in where), total[where]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["label", "a", "b", "k"])


def train(docs: DataFrame, sample_docs: int = 4000, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Table of log-likelihood ratios, random over ordinary, by previous and next character (67 x 67)."""
    n = len(LETTERS) + 1

    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("turn", F.xxhash64("text"))
    low = F.lower("text")
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in KEYWORDS]) | F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    # Hashes are even, so the share of the different texts that gives sample_docs of them is a bound on the hash; texts go nowhere.
    number = texts.agg(F.approx_count_distinct("turn").alias("all"), F.approx_count_distinct(F.when(marked, F.col("turn"))).alias("marked")).first()
    bound = lambda k: F.lit(min(2**63 - 1, -(2**63) + int(2**64 * sample_docs / max(1, k))))
    wanted = (F.col("turn") <= bound(number["all"])) | ((F.col("turn") <= bound(number["marked"])) & marked)
    table = np.zeros((2, n, n))
    once = texts.where(wanted).groupBy("turn").agg(F.first("text").alias("text"))  # equal texts
    sample = once.select("text").mapInArrow(count_pairs, "label int, a int, b int, k long")
    for row in sample.groupBy("label", "a", "b").agg(F.sum("k").alias("k")).collect():  # 2 * 67 * 67 rows at most
        table[row.label, row.a, row.b] = row.k
    plain = drawn([DIGITS])
    table[0] += Markov.pairs(plain) + Markov.pairs(Counter("-".join((w[:4], w[4:6], w[6:8])) for w in plain))
    table[1] += Markov.pairs(drawn(ALPHABETS))
    return Markov(table[1]).log - Markov(table[0]).log


def best_stretches(run: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the secrets in one run of characters: whole segments, the best first tried."""
    c = Markov.CODE[np.frombuffer(run.encode(), np.uint8)]
    first = ratio[len(LETTERS), c] - threshold
    sums = np.concatenate([[0.0], np.cumsum(ratio[np.concatenate([[len(LETTERS)], c[:-1]]), c] - threshold)])
    if len(run) >= FULL and sums[-1] > 0:
        return [(0, len(run))]
    segments = [m.span() for m in SEGMENT.finditer(run)]
    found, open_ = [], [(0, len(segments))]
    while open_:
        i, j = open_.pop()
        best, start, where = 0.0, None, None
        gain = 0.0  # of starting at the segment `start`, less the sum up to it
        for k in range(i, j):
            s, e = segments[k]
            fresh = first[s] - sums[s + 1]  # a stretch that starts here does not follow the character before
            if start is None or fresh > gain:
                start, gain = k, fresh
            total = gain + sums[e]
            if total > best:
                best, where = total, (start, k)
        if where is None:
            continue
        a, b = where
        s, e = segments[a][0], segments[b][1]
        if e - s >= LEAST and best > threshold * max(0, FULL - (e - s)):
            while a > i and len(run[slice(*segments[a - 1])]) < SHORT:
                a -= 1
            while b < j - 1 and len(run[slice(*segments[b + 1])]) < SHORT:
                b += 1
            e = len(run) if b == len(segments) - 1 else segments[b][1]  # with the padding of base64
            found.append((segments[a][0], e))
        open_ += [(i, a), (b + 1, j)]
    return sorted(found)


def markov_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Secrets outside of the base spans, by place."""
    found, at = [], 0
    for x, _, y in [*base, (len(text), 0, len(text))]:
        for m in CANDIDATE.finditer(text, at, max(at, x)):
            found += [(m.start() + s, 3, m.start() + e) for s, e in best_stretches(m[0], ratio, threshold)]
        at = max(at, y)
    return found


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, ratio: np.ndarray, threshold: float = 1.0, redact: bool = False, carry: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts, digest and list of spans; redact adds the text with each span blanked out.

    carry adds all other columns of docs as one struct named row."""
    row = [F.struct(*[c for c in docs.columns if c != text]).alias("row")] if carry else []
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    handed, schema = given.columns[2:], T.StructType.fromDDL(FOUND)
    for field in given.schema.fields[2:]:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for value in batch.column("text"):
                text = value.as_py()
                t = text or ""
                base = base_spans(t)
                spans = sorted([*base, *markov_spans(t, base, ratio, threshold)])
                n = Counter(k for _, k, _ in spans)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                for column, x in zip(rows, (n[0], n[1], n[2], n[3], digest, joined(spans), blanked(text, spans) if redact else None)):
                    column.append(x)
            columns = [pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(rows)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "redacted", *handed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *(batch.column(c) for c in handed)], names)

    return given.mapInArrow(run, schema)


def blanked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each run of overlapping spans replaced by [SECRET]."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
