"""Whole texts to token ids with a public tokenizer, word by word and remembered.

The tokenizers used here never let a token cross from a character that is no
white space to white space behind it, nor from a letter to a stop or comma, so a
text may be cut there and its parts encoded on their own. Parts recur, thus each
step looks up its distinct parts and has the library encode those that the worker
has not met. A part that is one word of Latin letters goes straight to the
library's model, if that agrees with the library on a list of probes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import SpanHash, arrow_schema, flat, steps

#: Parts a worker remembers before it starts anew; memory only, results don't depend on it.
MOST_PARTS = 1 << 19
_SEED = 20240916
#: A word of Latin letters with the blank before it, if any.
_WORD = re.compile(r" ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending positions at which texts begin or may be cut."""
    blank = (data == 0x20) | (data == 0x0A)
    blank[:3] = False
    at = np.flatnonzero(blank)
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    # Wide blanks are C2 xx, E1 9A xx, E2 80 xx, E2 81 xx or E3 80 xx.
    wide = (two == 0xC2) | (
        (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))
    )
    at = at[(one > 0x20) & ~((one >= 0x80) & wide)]
    stop = (data == 0x2C) | (data == 0x2E)
    stop[:2] = False
    stops = np.flatnonzero(stop)
    one, two = data[stops - 1], data[stops - 2]
    small = one | 0x20
    accented = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    stops = stops[((small >= 0x61) & (small <= 0x7A) & (one < 0x80)) | accented]
    marks = np.zeros(len(data), bool)
    marks[at] = marks[stops] = marks[starts] = True
    return np.flatnonzero(marks)


class _Known:
    """Sorted part hashes with each part's length, its place in the bytes kept, and its ids."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.fields = np.zeros((4, 0), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, fields: np.ndarray) -> None:
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.fields = np.concatenate((self.fields, fields), axis=1)[:, order]


def _grown(pool: np.ndarray, size: int) -> np.ndarray:
    while size > len(pool):
        pool = np.concatenate((pool, np.zeros_like(pool)))
    return pool


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """A tokenizer with the parts this worker has encoded so far.

    Parts are looked up by a hash and compared byte by byte; a step in which two
    different parts share a hash is left to the library as whole texts, and so is every
    text that has the name of a special token, which the library looks for first.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Names that are sought in a text as it stands; with others, all goes to the library.
        self.simple = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        names = [re.escape(t.content.encode()) for t in added]
        self.names = re.compile(b"|".join(names) if names else b"(?!)")
        self.short = self._short_way()
        self.hash = SpanHash(_SEED)
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = _Known(), _Known()
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.kept = np.zeros(1 << 16, np.uint8), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _short_way(self):
        """How to spell a word for the model, with its blank or in small letters without."""
        from tokenizers import pre_tokenizers

        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = {c: spell(chr(c))[0][0] for c in range(32, 256) if c == 32 or chr(c).isalpha()}
        probes = ["e", " e", " The", "THe", " \u00c9t\u00e9", "\u00e9Tat", "is", " don", " s", "stra\u00dfe"]
        probes += [a + chr(c) + b for c in letters if c > 32 for a, b in ((" ", "er"), ("An", ""))]
        for spelled in (
            lambda part: part.translate(letters),
            lambda part: part.strip().lower().translate(letters),
        ):
            if all(self._model(spelled(x)) == y for x, y in zip(probes, self.library(probes))):
                return spelled
        return None

    def _model(self, word: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(word)]

    def _ids(self, parts: list[str]) -> list[list[int]]:
        if self.short is None:
            return self.library(parts)
        found = [
            self._model(self.short(part)) if _WORD.fullmatch(part) else None for part in parts
        ]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.library([parts[k] for k in rest])):
            found[k] = ids
        return found

    def _learn(self, parts: list[bytes]) -> np.ndarray:
        """Length, place of the bytes, place and number of the ids of new parts."""
        found = self._ids([p.decode("utf-8", "replace") for p in parts])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self.pool = _grown(self.pool, self.filled + len(ids))
        self.pool[self.filled : self.filled + len(ids)] = ids
        starts = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        body = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.bytes = _grown(self.bytes, self.kept + len(body))
        self.bytes[self.kept : self.kept + len(body)] = body
        places = self.kept + np.cumsum(sizes) - sizes
        self.kept += len(body)
        return np.stack((sizes, places, starts, counts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids begin (n + 1 places)."""
        if not self.simple:
            return self._plain(data, offsets)
        named = [m.start() for m in self.names.finditer(data.tobytes())]
        if not named:
            return self._by_parts(data, offsets)
        rows = np.unique(np.searchsorted(offsets, named, "right") - 1)
        sizes = np.diff(offsets)
        rest = sizes.copy()
        rest[rows] = 0
        ids, at = self._by_parts(data[_places(offsets[:-1], rest)], np.append(0, np.cumsum(rest)))
        own = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        for k, found in zip(rows, self.library([self._text(data, offsets, k) for k in rows])):
            own[k] = np.array(found, np.uint32)
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    @staticmethod
    def _text(data: np.ndarray, offsets: np.ndarray, k: int) -> str:
        return data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")

    def _by_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = np.flatnonzero(np.diff(offsets))
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first = cuts(data, offsets[texts])
        last = np.append(first[1:], len(data))
        sizes = last - first
        hashes = self.hash(data, first, last)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        keys, sample = ranked[new], order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        twin = sample[inverse]
        if not np.array_equal(sizes[twin], sizes):
            return self._plain(data, offsets)
        if not np.array_equal(data[np.repeat(first[twin] - first, sizes) + np.arange(len(data))], data):
            return self._plain(data, offsets)
        if len(self.old.keys) + len(self.new.keys) + len(keys) > MOST_PARTS:
            self._forget()
        fields = np.zeros((4, len(keys)), np.int64)
        unknown = np.ones(len(keys), bool)
        for known in (self.old, self.new):
            at = known.find(keys)
            hit = np.flatnonzero(at >= 0)
            found, where = known.fields[:, at[hit]], sample[hit]
            if not np.array_equal(found[0], sizes[where]):
                return self._plain(data, offsets)
            kept = self.bytes[_places(found[1], found[0])]
            if not np.array_equal(kept, data[_places(first[where], found[0])]):
                return self._plain(data, offsets)
            fields[:, hit] = found
            unknown[hit] = False
        if unknown.any():
            where = sample[unknown]
            raw = data.tobytes()
            learned = self._learn([raw[a:b] for a, b in zip(first[where].tolist(), last[where].tolist())])
            fields[:, unknown] = learned
            self.new.add(keys[unknown], learned)
            if len(self.new.keys) > 4096 + len(self.old.keys) // 4:
                self.old.add(self.new.keys, self.new.fields)
                self.new = _Known()
        each = fields[3][inverse]
        before = np.append(0, np.cumsum(each))
        return self.pool[_places(fields[2][inverse], each)], before[np.searchsorted(first, offsets)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts by the library."""
        found = self.library([self._text(data, offsets, k) for k in range(len(offsets) - 1)])
        ends = np.cumsum([0, *map(len, found)])
        return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1])), ends


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encoded(
    batch: pa.RecordBatch, tokenizer: str, end_id: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose last column holds the texts, with their ids.

    Each text's ids end with ``end_id``; the places are of the range's ids.
    """
    data, offsets = flat(batch.column(batch.num_columns - 1))
    for first, last in steps(offsets):
        part = offsets[first : last + 1]
        ids, at = encoder(tokenizer).encode(data[part[0] : part[-1]], part - part[0])
        yield first, last, np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def tokenized(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 4,
) -> DataFrame:
    """(doc_id, n_tokens, ids): every whole text's ids as little-endian integers of ``width`` bytes.

    NULL is an empty text, whose only id is ``end_id``. ``tokenizer`` is a file
    name of the public tokenizers or a path that all executors have.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = arrow_schema(
        [("doc_id", rows.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ids, at in encoded(batch, tokenizer, end_id):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(at)),
                        binaries(ids.astype(f"<u{width}"), at),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ``values`` as binary rows, without going through Python objects."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(),
        len(at) - 1,
        [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())],
    )
