"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every token of the vocabulary becomes a piece: its bytes are written as 256 letters of their own (U+0100 to U+01FF) and its score is the
negative rank, so the library's best-score-first, leftmost-first merging is the merging by ranks. Normalisation is the identity: no dummy
prefix, no removed or escaped spaces. A text is cut by the pattern, each match is encoded by itself (one that is a token as a whole is
that token), and ids are decoded through the model's pieces by the inverse letters.

The pattern's \\p{L}, \\p{N} and \\s are spelled out as the code points that the tiktoken library counts as such, since regular-expression
modules follow other versions of Unicode.

Defined cases: a null text is empty and gives no ids; repeated rows and rows without id are encoded each by themselves; very long texts are
cut in blocks of matches, so beside the text only its ids are held; bytes that are no UTF-8 are read as U+FFFD; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NORMAL, UNKNOWN, CONTROL, BPE = 1, 2, 3, 2  # fixed values: piece types and the model type of the file format
LETTERS = {b: 0x100 + b for b in range(256)}
BLOCK = 1 << 14  # matches that are encoded at once
CACHED = 1 << 18  # pre-tokens that a worker remembers, each of at most CACHED_CHARS characters
CACHED_CHARS = 64
GROUP_CHARS = 1 << 20
EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(LETTERS)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The model file: a piece for each id, unused ids as control pieces, an unknown piece after the last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary has to hold every single byte")
    model, piece_of = pb.ModelProto(), {i: raw for raw, i in ranks.items()}
    size = max(piece_of) + 1
    for i in range(size):
        if i in piece_of:
            model.pieces.add(piece=mapped(piece_of[i]), score=-i, type=NORMAL)
        else:
            model.pieces.add(piece=f"<unused {i}>", score=0, type=CONTROL)
    model.pieces.add(piece="<unknown>", score=0, type=UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id, spec.unk_piece = BPE, size + 1, size, -1, -1, -1, "<unknown>"
    plain = model.normalizer_spec
    plain.name, plain.add_dummy_prefix, plain.remove_extra_whitespaces, plain.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


@lru_cache
def members(kind: str) -> np.ndarray:
    """The code points that the tiktoken library matches by this class."""
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return np.array([ord(c) for c in bytes(single.encode_ordinary(EVERY)).decode()], np.int64)


def ranges(points: np.ndarray) -> str:
    """Sorted code points as ranges of a character class."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.concatenate([[0], cuts + 1])], points[np.concatenate([cuts, [len(points) - 1]])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts))


@lru_cache
def splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern, frozenset[str]]:
    """The pattern with its classes spelled out; the pattern as it is, for texts without the code points on which modules differ; these."""
    out, inside, differ = [], False, np.zeros(0, np.int64)
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in (r"\s", r"\S") or part[:2] in (r"\p", r"\P"):
            kind, negated = part[0] + part[1].lower() + part[2:], part[1].isupper()
            if inside and negated:
                raise ValueError(f"{part} in brackets is not supported")
            own = members(kind)
            differ = np.union1d(differ, np.setxor1d(own, [ord(c) for c in regex.findall(kind, EVERY)]))
            out.append(ranges(own) if inside else f"[{'^' * negated}{ranges(own)}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out)), regex.compile(pattern), frozenset(map(chr, differ))


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialised(self.ranks))
        self.exact, self.alike, self.disputed, self.cache = *splitters(pattern), {}
        used = set(self.ranks.values())
        self.bytes_of = [unmapped(self.model.id_to_piece(i)) if i in used else b"" for i in range(max(used) + 1)]

    def split(self, text: str) -> re.Pattern | regex.Pattern:
        return self.alike if text.isascii() or self.disputed.isdisjoint(text) else self.exact

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of these pre-tokens into the cache, all at once."""
        new = list(tokens.difference(self.cache))
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(tokens)
        raw = [t.encode() for t in new]
        whole = [self.ranks.get(r) for r in raw]
        merged = iter(self.model.encode([mapped(r) for r, i in zip(raw, whole) if i is None], out_type=int, num_threads=1))
        self.cache.update((t, array.array("i", next(merged) if i is None else [i]).tobytes()) for t, i in zip(new, whole))

    def joined(self, tokens: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, tokens))

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, in blocks of matches."""
        parts, matches = [], (m.group() for m in self.split(text).finditer(text))
        while block := list(islice(matches, BLOCK)):
            own = set(block)
            self.learn(own)
            parts.append(self.joined(block))
            for t in own:
                if len(t) > CACHED_CHARS:
                    del self.cache[t]
        return np.frombuffer(b"".join(parts), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; at most GROUP_CHARS characters together, but for one text."""
        if sum(map(len, texts)) > GROUP_CHARS:
            return [self.encode_long(t) for t in texts]
        tokens = [self.split(t).findall(t) for t in texts]
        own = set().union(*tokens)
        self.learn(own)
        found = [np.frombuffer(self.joined(t), np.int32) for t in tokens]
        for t in own:
            if len(t) > CACHED_CHARS:
                del self.cache[t]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; tokenizer: path of a rank file."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)

        def made(keys: pa.Array, first: int, lists: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
            return pa.RecordBatch.from_arrays([keys.slice(first, len(lists)), ids], ["doc_id", "ids"])

        for batch in batches:
            keys, texts, first, held = batch.column("doc_id"), [], 0, 0
            for row, raw in enumerate(batch.column("raw")):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                if texts and held + len(text) > GROUP_CHARS:
                    yield made(keys, first, own.encode(texts))
                    texts, first, held = [], row, 0
                texts.append(text)
                held += len(text)
            yield made(keys, first, own.encode(texts))

    return given.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (bytes) of rows of doc_id and ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(np.array([len(x) if x.is_valid else 0 for x in ids])))]).astype(np.int64)
            raw = pa.array([own.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, raw], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
