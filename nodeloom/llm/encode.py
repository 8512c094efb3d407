"""Token ids of whole texts by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can't be merged across, so a cut between
its bytes is certain. Cuts are only made between characters, and not where the pre-tokenizer would
look across them: after a blank (it looks ahead in runs of blanks) or before an apostrophe (it may
open a contraction). The fragments, mostly a word with its blank, are encoded independently, the
common ones once per task, and their ids concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nodeloom.session import spread

#: Folder of the public tokenizers' files; pass another where they lie elsewhere.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenizer's pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONGEST_KEPT, _MOST_KEPT = 48, 1 << 18


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


class Encoder:
    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        import tiktoken

        ranks = _ranks(f"{folder}/{name}.tiktoken")
        self._encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.never = np.ones((256, 256), bool)
        for token in ranks:
            for pair in zip(token, token[1:]):
                self.never[pair] = False
        cp = np.arange(0x110000, dtype=np.uint32)
        self.last = np.where(cp < 0x80, cp, 0x80 | (cp & 0x3F)).astype(np.uint8)
        lead = np.where(cp < 0x80, cp, np.where(cp < 0x800, 0xC0 | cp >> 6, np.where(cp < 0x10000, 0xE0 | cp >> 12, 0xF0 | cp >> 18)))
        self.first = lead.astype(np.uint8)
        self.blank = np.zeros(0x110000, bool)
        self.blank[[c for c in range(0x3001) if chr(c).isspace()]] = True
        self.kept: dict[str, list[int]] = {}

    def cuts(self, text: str) -> list[int]:
        """Positions inside the text where a cut is certain."""
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        before, after = a[:-1], a[1:]
        sure = self.never[self.last[before], self.first[after]] & ~self.blank[before] & (after != 39)
        return (np.flatnonzero(sure) + 1).tolist()

    def fragments(self, text: str) -> list[str]:
        at = self.cuts(text)
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def _fragment(self, fragment: str) -> list[int]:
        ids = self._encode(fragment)
        if len(fragment) <= _LONGEST_KEPT:
            if len(self.kept) >= _MOST_KEPT:
                self.kept.clear()
            self.kept[fragment] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; [] for an empty or null one."""
        if not text:
            return []
        out: list[int] = []
        kept, more, extend = self.kept.get, self._fragment, out.extend
        for f in self.fragments(text):
            extend(kept(f) or more(f))
        return out


@lru_cache(2)
def encoder(name: str, folder: str) -> Encoder:
    """One per Python worker."""
    return Encoder(name, folder)


def _rows(batch: pa.RecordBatch, step: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def encode_texts(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id") -> DataFrame:
    """(key, ids): the whole text of every row as token ids; null and empty texts give []."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in (part for b in batches for part in _rows(b)):
            flat, offsets = [], [0]
            for text in batch.column(1):
                flat.append(np.array(enc.ids(text.as_py()), np.int32))
                offsets.append(offsets[-1] + len(flat[-1]))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [key, "ids"])

    return spread(docs.select(key, "text")).mapInArrow(run, f"{key} long, ids array<int>")


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens): length of the id list of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            n = [len(enc.ids(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return spread(docs.select(key, "text")).mapInArrow(run, f"{key} long, n_tokens long")
