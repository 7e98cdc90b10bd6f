"""Token counts by rank-synchronous merging of many pre-tokens at once.

Method. Texts are cut at the special strings and then into pre-tokens by the tokenizer's pattern. All pre-tokens of a batch that have not
been counted yet lie in one ragged array of symbol ids (values and the sequence each belongs to). Every round looks up the rank of
every neighbouring pair, takes each sequence's lowest rank, and merges all places of that pair in all sequences at the same time,
from the left where places overlap; a sequence without a ranked pair is done and leaves the array. What is left is the count.

Merging all places of a pair at once equals merging them one by one when every merge makes a token that no other merge makes, which
is checked when the ranks are read.

Defined cases: a null text is empty and has 0 tokens; special strings in a text are one token each, as the tokenizers library does by
default; there is no truncation. Repeated rows are counted alike; other columns are never looked at. Memory: one Arrow batch, a
bounded memory of counts, and the pieces of one text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import no_nulls

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 800_000  # chunks, some 150 bytes each
AT_ONCE = 1 << 20  # bytes of pre-tokens merged together


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in vocabulary files of this kind: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Ranks:
    pairs: np.ndarray  # left * size + right, sorted
    rank: np.ndarray
    made: np.ndarray
    byte_ids: np.ndarray
    size: int
    specials: tuple[str, ...]


@functools.cache
def read_ranks(path: str) -> Ranks:
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    vocab = said["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if len(set(made)) != len(made):
        raise ValueError("two merges make the same token; all places of a pair can't be merged at once")
    size = max(vocab.values()) + 1
    pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(pairs)
    byte_ids = np.zeros(256, dtype=np.int64)
    for sign, byte in byte_signs().items():
        byte_ids[byte] = vocab[sign]
    specials = tuple(t["content"] for t in said.get("added_tokens", ()))
    return Ranks(pairs[order], order.astype(np.int64), np.array(made, dtype=np.int64)[order], byte_ids, size, specials)


def merged_counts(pieces: list[bytes], ranks: Ranks) -> np.ndarray:
    """Symbols left of each piece once no pair of neighbours has a rank."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    left = lengths.copy()
    symbols = ranks.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    unranked = len(ranks.pairs)
    while len(symbols) > 1:
        pair = symbols[:-1] * ranks.size + symbols[1:]
        place = np.searchsorted(ranks.pairs, pair)
        place[place == unranked] = 0
        known = (ranks.pairs[place] == pair) & (owner[:-1] == owner[1:])
        rank = np.where(known, ranks.rank[place], unranked)
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        # The last symbol of a sequence starts no pair of its own.
        lowest = np.minimum.reduceat(np.append(rank, unranked), begins)
        per_symbol = np.repeat(lowest, np.diff(np.append(begins, len(owner))))
        chosen = known & (rank == per_symbol[:-1])
        # Of places that overlap (a run of the same symbol), every second counts, from the left.
        at = np.flatnonzero(chosen)
        if len(at):
            run_start = np.concatenate(([True], np.diff(at) != 1))
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
        symbols[at] = ranks.made[place[at]]
        keep = per_symbol < unranked  # others are done
        keep[at + 1] = False
        done = np.flatnonzero(lowest == unranked)
        left[owner[begins[done]]] = np.diff(np.append(begins, len(owner)))[done]
        gone = np.bincount(owner[at], minlength=len(pieces)) if len(at) else 0
        left = np.where(gone, left - gone, left) if len(at) else left
        symbols, owner = symbols[keep], owner[keep]
    return left


class Counter:
    """Counts the tokens of texts; remembers a bounded number of chunks.

    A chunk is white space and what follows up to the next white space. No pre-token reaches over the end of a chunk, since none has
    white space after another character, so chunks are cut into pre-tokens and counted once and then looked up.
    """

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(PATTERN)
        # The controls U+001C to U+001F are white space for Python only.
        self.chunk = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
        self.special = re.compile("|".join(map(re.escape, self.ranks.specials))) if self.ranks.specials else None
        self.known: dict[str, int] = {}

    def chunks(self, text: str) -> tuple[int, list[str]]:
        """How many special strings a text holds, and the chunks between them."""
        if self.special is None or not any(s in text for s in self.ranks.specials):
            return 0, self.chunk.findall(text)
        parts = self.special.split(text)
        return len(parts) - 1, [c for part in parts for c in self.chunk.findall(part)]

    def _learn(self, new: list[str]) -> None:
        begin = size = 0
        for k, chunk in enumerate(new):
            size += len(chunk)
            if size >= AT_ONCE or k == len(new) - 1:
                some = new[begin : k + 1]
                cut = [self.pattern.findall(c) for c in some]
                pieces = [p.encode() for found in cut for p in found]
                upto = np.concatenate(([0], np.cumsum(merged_counts(pieces, self.ranks))))
                ends = np.cumsum([len(found) for found in cut])
                counts = upto[ends] - upto[np.concatenate(([0], ends[:-1]))]
                self.known.update(zip(some, counts.tolist()))
                begin, size = k + 1, 0

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Texts are taken together until there is enough to merge at once."""
        done: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        size = 0

        def settle() -> None:
            nonlocal size
            self._learn(sorted(new))
            done.extend(n + sum(map(self.known.__getitem__, found)) for n, found in waiting)
            waiting.clear()
            new.clear()
            size = 0
            if len(self.known) > REMEMBERED:
                self.known.clear()

        for text in texts:
            n, found = self.chunks(text or "")
            waiting.append((n, found))
            new.update(set(found).difference(self.known))
            size += len(text or "")
            if size >= AT_ONCE:
                settle()
        settle()
        return done


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.col(key).alias("key"), no_nulls(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(counter.counts(t.as_py() for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), n_bytes, n_tokens], ["key", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
