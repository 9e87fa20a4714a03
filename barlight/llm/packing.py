"""Best-fit packing of token sequences.

Each document is encoded once, closed by an end id and, only if it is longer than a sequence, cut into
full pieces and a rest. Pieces are dealt by hash to tasks; each task packs its stream online: a fixed number of
bins is open, a bitset keyed by free space finds the fullest bin that still takes the piece, and when one bin
too many is open the fullest closes. State of a task: the open bins alone.

Defined cases: null text is empty and gives one piece that holds the end id alone; repeated rows are packed as
often as they occur, dealt to tasks by their number in an Arrow batch; ties between bins of equal free space go to the newest; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
COPY = "copy int"  # rows of the id before it in its Arrow batch: tells repeats apart when they are dealt out
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordEncoder:
    """ids of the word-end BPE, remembering what each word gave.

    That tokenizer normalises, drops white space and encodes each letter run, digit and symbol run by itself, so
    a text's ids are those of its words in order, and a token that ends a word shows where one word's ids stop. Texts are cut into words and
    these numbered in Arrow, some four million characters at a time; only words not met before go to the tokenizer, by themselves. That holds
    for texts of plain Latin characters, which are all composed; any other text goes to the tokenizer whole.
    """

    ODD = r"[^\t\n\v\f\r\x20-\x7eÀ-ÖØ-öø-ÿ“”‘’–—…¿¡«»€]|<\|"
    APART = r"'(?:s|t|re|ve|m|ll|d)|[^\t\n\v\f\r a-zß-öø-ÿ0-9]+|[0-9]"  # what is a word without white space around it

    def __init__(self, path: str, most: int = 600_000, at_once: int = 1 << 22):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.of_words, self.most, self.at_once = Tokenizer.from_file(path), Tokenizer.from_file(path), most, at_once
        self.of_words.normalizer = normalizers.Sequence([])  # words are normalised and cut already
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.words, self.ends, self.ids = {"": 0}, np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        some, n = [], 0
        for text in texts:
            some.append(text)
            n += len(text)
            if n >= self.at_once:
                yield from self._encoded(some)
                some, n = [], 0
        yield from self._encoded(some)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        given = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(given, self.ODD)
        plain = pc.utf8_lower(pc.if_else(odd, pa.scalar("", pa.large_string()), given))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, self.APART, r" \0 "))
        coded = pc.dictionary_encode(lists.flatten())
        word = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begins = np.concatenate([[0], self.ends[:-1]])[word]
        counts = self.ends[word] - begins
        stops = np.cumsum(counts)
        ids = self.ids[np.repeat(begins - stops + counts, counts) + np.arange(counts.sum())]
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        for text, whole, a, e in zip(texts, odd.to_pylist(), bounds, bounds[1:]):
            yield np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes() if whole else ids[a:e].tobytes()

    def _numbers(self, words: list[str], step: int = 2000) -> np.ndarray:
        """The number of each word; those not met before are learnt, and if there are too many by then all others are forgotten."""
        if len(self.words) > self.most:
            self._forget()
        unseen, ids = [w for w in words if w not in self.words], [self.ids]
        for at in range(0, len(unseen), step):
            [found] = self.of_words.encode_batch_fast([" ".join(unseen[at : at + step])], add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
        self.words.update(zip(unseen, range(len(self.words), len(self.words) + len(unseen))))
        new = np.concatenate(ids[1:]) if unseen else self.ids[:0]
        self.ends = np.concatenate([self.ends, len(self.ids) + 1 + np.flatnonzero(self.last[new])])
        self.ids = np.concatenate(ids)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, budget: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece, with its place in the document; keep_ids adds the ids themselves as bytes."""
    end, width = end_id.to_bytes(4, "little"), 4 * budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer)
        for batch in batches:
            source, out, seen, copies = [], [], Counter(), []
            for i in batch.column("doc_id").to_pylist():
                copies.append(seen[i])
                seen[i] += 1
            texts = (t.as_py() or "" for t in batch.column("text"))
            for row, ids in enumerate(encoder.encode(texts)):
                ids += end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    source.append(row)
                    out.append((at // width, at // 4, len(part) // 4, zlib.crc32(part), copies[row], part if keep_ids else None))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())[: 5 + keep_ids]
            columns = [pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "copy", "ids"][: 6 + keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source, pa.int32())), *columns], names)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"{PIECES}, {COPY}" + ", ids binary" * keep_ids)


class OpenBins:
    """At most `most` open bins; bit f of `free` is set while a bin with f free places is open."""

    def __init__(self, budget: int, most: int):
        self.budget, self.most, self.open, self.made = budget, most, 0, 0
        self.free = 0
        self.at: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this length."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bins = self.at[space]
            which = bins.pop()
            if not bins:
                self.free ^= 1 << space
            self.open -= 1
        else:
            space, which = self.budget, self.made
            self.made += 1
        left = space - length
        if left:
            if not (self.free >> left) & 1:
                self.free |= 1 << left
                self.at[left] = []
            self.at[left].append(which)
            self.open += 1
            if self.open > self.most:
                self._close()
        return which, self.budget - space

    def _close(self) -> None:
        fullest = (self.free & -self.free).bit_length() - 1
        bins = self.at[fullest]
        bins.pop()
        if not bins:
            self.free ^= 1 << fullest
        self.open -= 1


def pack(parts: DataFrame, budget: int = 4096, open_bins: int = 512) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece, length and, so that repeated rows are many tasks, copy (which is left out then).

    The order in a task is a fixed pseudo-random one, so a retried task numbers its bins as before.
    """
    fields, kept = [f for f in parts.schema.fields if f.name != "copy"], [c for c in parts.columns if c != "copy"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(budget, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [bins.place(n) for n in batch.column("length").to_pylist()]
            added = [pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], [*kept, "sequence_id", "offset"])

    turn: Column = F.xxhash64(*[c for c in ("doc_id", "piece", "length", "copy") if c in parts.columns])
    dealt = parts.withColumn("_turn", turn).repartition("_turn")
    ties = [c for c in ("doc_id", "piece", "length", "ids_crc32") if c in parts.columns]
    return dealt.sortWithinPartitions("_turn", *ties).select(*kept).mapInArrow(run, schema)


def best_fit(docs: DataFrame, tokenizer: str, budget: int = 4096, open_bins: int = 512, **columns) -> DataFrame:
    return pack(pieces(docs, tokenizer, budget, **columns), budget, open_bins)
