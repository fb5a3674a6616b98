"""Problem 7: exact ids of every text in a public byte-level BPE vocabulary.

Method: per-prefix dynamic programming.  An automaton over the vocabulary (of Aho and Corasick: its suffix links list every token that
ends at a position) proposes the last token of each prefix; exactly one proposal is pair-compatible with the last token of the prefix
before it, and that one is stored.  Following the stored tokens back from the end gives the ids.  No merge is ever simulated.

The work is done once per distinct word in every Python worker: a text is a sequence of units (an optional space and a run
of other characters, or white space), whose ids do not depend on their neighbours, so a text's ids are the
joined ids of its units.  The caches are bounded; they only save time.

Defined results: null, empty text -> []; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Code points with the property White_Space.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# Fixed pattern of this vocabulary family; units are already parted at white space.
_PRETOKEN = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
CACHE_UNITS, CACHE_LENGTH = 400_000, 48


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files of this family."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Ids of one pretoken by the dynamic programme over its prefixes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.length = {i: len(t) for t, i in vocab.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for left, right in merges:
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = t
            self.parts[t] = (a, b)
        self.automaton = ahocorasick.Automaton()
        single = {i for t, i in vocab.items() if len(t) == 1}
        for t, i in vocab.items():
            if i in self.parts or i in single:  # a token that no merge makes can never be emitted
                self.automaton.add_word("".join(chr(alphabet[c]) for c in t), i)
        self.automaton.make_automaton()
        self.compatible = lru_cache(maxsize=1_000_000)(self._compatible)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay side by side when their bytes are encoded together.

        Undo merges from the latest to the earliest.  Whenever the inner ends that remain could have merged before the
        token just undone came to be, the boundary would not have survived.  Equal merges happen from left to right.
        """
        bound = None
        while True:
            t = self.joined.get((left, right))
            if t is not None and (bound is None or t < bound):
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            if l and (not r or left > right):
                bound, left = left, l[1]
            elif r:
                bound, right = right + 1, r[0]
            else:
                return True

    def __call__(self, word: bytes) -> list[int]:
        n = len(word)
        last: list[int] = [-1] * (n + 1)
        length = self.length
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[end] = token
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]


class UnitIds(dict):
    """unit -> its ids as packed 32-bit integers, computed when first asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encode = PrefixEncoder(path)
        self.words: dict[str, list[int]] = {}

    def _word(self, w: str) -> list[int]:
        ids = self.words.get(w)
        if ids is None:
            ids = self.encode(w.encode("utf-8", "replace"))
            if len(w) <= CACHE_LENGTH:
                if len(self.words) >= CACHE_UNITS:
                    self.words.clear()
                self.words[w] = ids
        return ids

    def __missing__(self, unit: str) -> bytes:
        ids = [i for w in _PRETOKEN.findall(unit) for i in self._word(w)]
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(unit) <= CACHE_LENGTH:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = packed
        return packed

    def text(self, t: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _UNIT.findall(t))) if t else b""


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    """One cache per worker process and vocabulary."""
    return UnitIds(path)


def shipped(df: DataFrame, path: str) -> str:
    """The name under which executors find the vocabulary: it travels with the job wherever the driver can read it."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)
    return path


def _found(path: str) -> str:
    """The vocabulary on this machine: the file of the job, else the path itself."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


def encode_texts(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids) for every row of df; the driver or every executor must be able to read the vocabulary at this path."""
    vocabulary = shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_ids(_found(vocabulary))
        for b in batches:
            packed = [units.text(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens) for every row of df."""
    vocabulary = shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_ids(_found(vocabulary))
        for b in batches:
            n = [len(units.text(t)) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
