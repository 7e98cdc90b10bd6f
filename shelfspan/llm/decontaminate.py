"""Benchmark decontamination by SimHash of item-sized windows.

Method. Words are runs of letters and digits, lower case. For each benchmark item, every window of the item's own number of words in a
document is a candidate place. Windows and items get a 64-bit SimHash of their shingles of `size` words, repeats included. Items
are indexed by blocks of their fingerprint: with radius r and m blocks, a fingerprint within r bits differs in at most r // m bits
in some block, so entering each item under all neighbours of its blocks that near finds all fingerprints within the radius. The
candidates are then verified exactly: the similarity of the weighted shingle sets (weight: how often a shingle stands in the
window), sum of the smaller over sum of the larger weights, must be at least `least`. Of an item's overlapping windows in a
document the most similar one counts, the first of equals.

No fingerprint is made for a window that shares no shingle with an item of its length, since its similarity is 0: fingerprints of
all windows of all lengths would cost about 80 ns for each word and length.

Items are the stated query set. They are sent to the tasks in blocks of at most `block` items and `block_words` words, so what is
broadcast has a bound, and every block looks at all documents. Documents are scanned once a block, without a shuffle.

Defined cases: null texts have no words; an item without words matches nothing, one of fewer than `size` words is one shingle and
needs the same words; a null item id is an id like any other; repeated documents or items are each reported. Extra columns are
carried along by clean() and not looked at by leaks().
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspan.llm.common import let, no_nulls

SIZE = 5
LEAST = 0.8
RADIUS = 16
BLOCKS = 8
BLOCK_ITEMS = 5_000
BLOCK_WORDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(F.lower(no_nulls(text)), r"[^\p{L}\p{M}\p{N}]+", " "))
    words = let(spaced, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ", -1)))
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each place (len - size + 1 of them)."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mixed(out * ODD + words[k : k + n])
    return out


def simhashes(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of grams[s : s + width] for each start: a bit is set if more than half of them have it."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), 4096):
        some = starts[at : at + 4096]
        low, high = int(some.min()), int(some.max()) + width
        if high - low <= 16 * (len(some) + width):
            upto = np.zeros((high - low + 1, 64), np.int32)
            bits = np.unpackbits(grams[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.cumsum(bits, axis=0, dtype=np.int32, out=upto[1:])
            counts = upto[some - low + width] - upto[some - low]
        else:
            rows = grams[some[:, None] + np.arange(width)].astype("<u8")
            bits = np.unpackbits(rows.view(np.uint8).reshape(len(some), width, 8), axis=2, bitorder="little")
            counts = bits.sum(axis=1, dtype=np.int32)
        out[at : at + 4096] = np.packbits(2 * counts > width, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _sizes(length: int, size: int) -> tuple[int, int]:
    """Words of a shingle and number of shingles of a window; a short window is one shingle."""
    width = min(size, length)
    return width, length - width + 1


@dataclass(frozen=True)
class Item:
    place: int  # in the block
    length: int
    print_: int
    grams: np.ndarray  # distinct, sorted
    weights: np.ndarray


class Index:
    """The items of one block: by length, with the blocks of their fingerprints and their neighbours."""

    def __init__(self, words: list[np.ndarray], size: int, radius: int, blocks: int):
        self.size, self.radius, self.blocks, self.bits = size, radius, blocks, 64 // blocks
        self.items: dict[int, list[Item]] = {}
        for place, w in enumerate(words):
            if len(w):
                width, n = _sizes(len(w), size)
                grams = shingles(w, width)
                distinct, weights = np.unique(grams, return_counts=True)
                print_ = simhashes(grams, np.zeros(1, np.int64), n)[0]
                self.items.setdefault(len(w), []).append(Item(place, len(w), print_, distinct, weights))
        near = [sum(1 << b for b in flips) for k in range(radius // blocks + 1) for flips in itertools.combinations(range(self.bits), k)]
        self.near = np.array(near, np.uint64)
        self.grams = {n: np.unique(np.concatenate([i.grams for i in items])) for n, items in self.items.items()}
        # One look at each shingle of a document: the lengths whose items hold it.
        full = [g for n, g in self.grams.items() if n >= size]
        self.all_grams = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        self.prints = {n: np.array([i.print_ for i in items], np.uint64) for n, items in self.items.items()}
        self.tables = {n: self._table(n) for n in self.items}

    def _blocks_of(self, prints: np.ndarray) -> np.ndarray:
        shifts = np.arange(self.blocks, dtype=np.uint64) * np.uint64(self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        return ((prints[:, None] >> shifts) & mask) | (np.arange(self.blocks, dtype=np.uint64) << np.uint64(self.bits))

    def _table(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (block number and value, near values included) and the item under each."""
        keys = (self._blocks_of(self.prints[length])[:, :, None] ^ self.near).reshape(len(self.prints[length]), -1)
        item = np.repeat(np.arange(len(keys)), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        return keys.ravel()[order], item[order]

    def candidates(self, length: int, prints: np.ndarray) -> np.ndarray:
        """(window, item) for all fingerprints within the radius."""
        keys, item = self.tables[length]
        asked = self._blocks_of(prints).ravel()
        low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        n = high - low
        window = np.repeat(np.repeat(np.arange(len(prints)), self.blocks), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(window * len(self.prints[length]) + item[np.repeat(low, n) + within])
        window, at = np.divmod(pair, len(self.prints[length]))
        near = np.bitwise_count(prints[window] ^ self.prints[length][at]) <= self.radius
        return np.stack([window[near], at[near]], axis=1)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted table; a small filter passes over most of them."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    bits = np.zeros(1 << 18, bool)
    bits[(table >> np.uint64(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values >> np.uint64(46)).astype(np.int64)])
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    out = np.zeros(len(values), bool)
    out[maybe[table[at] == values[maybe]]] = True
    return out


def similarity(grams: np.ndarray, item: Item) -> float:
    distinct, counts = np.unique(grams, return_counts=True)
    at = np.searchsorted(distinct, item.grams)
    at[at == len(distinct)] = 0
    both = np.where(distinct[at] == item.grams, np.minimum(counts[at], item.weights), 0).sum()
    return float(both / (counts.sum() + item.weights.sum() - both))


def found_in(words: np.ndarray, ends: np.ndarray, index: Index, least: float) -> list[tuple[int, int, int, int, float]]:
    """(document, item, first word, words, similarity) of documents that lie one behind the other in words, up to their ends."""
    begins = np.concatenate(([0], ends[:-1]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    grams_by_width = {}

    def grams_of(width: int) -> np.ndarray:
        if width not in grams_by_width:
            grams_by_width[width] = shingles(words, width)
        return grams_by_width[width]

    hits = np.flatnonzero(_among(grams_of(index.size), index.all_grams))
    for length, items in index.items.items():
        width, n = _sizes(length, index.size)
        grams = grams_of(width)
        at = hits if width == index.size else np.arange(len(grams))
        at = at[_among(grams[at], index.grams[length])]
        if not len(at):
            continue
        doc = np.searchsorted(ends, at, "right")
        # Windows that hold one of these shingles and lie within its document.
        low = np.maximum(at - n + 1, begins[doc])
        high = np.minimum(at, ends[doc] - length) + 1
        low = np.maximum(low, np.maximum.accumulate(np.concatenate(([0], high[:-1]))))
        some = high > low
        low, high = low[some], high[some]
        if not len(low):
            continue
        many = high - low
        starts = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        pairs = index.candidates(length, simhashes(grams, starts, n))
        for window, place in pairs.tolist():
            start, item = int(starts[window]), items[place]
            value = similarity(grams[start : start + n], item)
            if value >= least:
                d = int(np.searchsorted(ends, start, "right"))
                key = (d, item.place)
                if key not in best or (-value, start) < (-best[key][0], best[key][1]):
                    best[key] = (value, start, length)
    return [(d, place, start - int(begins[d]), length, value) for (d, place), (value, start, length) in sorted(best.items())]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All words one behind the other, and where each document ends."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    return values, (offsets[1:] - offsets[0]).astype(np.int64)


@dataclass(frozen=True)
class Search:
    size: int = SIZE
    least: float = LEAST
    radius: int = RADIUS
    blocks: int = BLOCKS
    block: int = BLOCK_ITEMS
    block_words: int = BLOCK_WORDS


def item_blocks(items: DataFrame, key: str, text: str, search: Search) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and words of the items, in blocks of bounded size (an item longer than a block's words is a block of its own)."""
    ids, words, held = [], [], 0
    rows = items.select(F.col(key).alias("id"), word_hashes(F.col(text)).alias("words")).orderBy("id", F.xxhash64("words"))
    for row in rows.toLocalIterator():
        w = np.array(row["words"], np.int64).view(np.uint64)
        if ids and (len(ids) >= search.block or held + len(w) > search.block_words):
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row["id"])
        words.append(w)
        held += len(w)
    if ids:
        yield ids, words


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", search: Search = Search()
) -> DataFrame:
    """(key, item, first_word, n_words, similarity): the best window of each item in each document that holds one."""
    rows = docs.select(F.col(key).alias("key"), word_hashes(F.col(text)).alias("words"))
    kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, first_word long, n_words long, similarity double"
    parts = []
    for ids, words in item_blocks(items, item, text, search):
        sent = docs.sparkSession.sparkContext.broadcast((ids, words))

        def looked(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, item_words = sent.value
            index = Index(item_words, search.size, search.radius, search.blocks)
            item_type = pa.array(names).type
            for batch in batches:
                flat, ends = _flat(batch.column("words"))
                found = found_in(flat, ends, index, search.least)
                d, place, first, n, value = zip(*found) if found else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(d, pa.int64())),
                        pa.array([names[p] for p in place], item_type),
                        pa.array(first, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(value, pa.float64()),
                    ],
                    ["key", "item", "first_word", "n_words", "similarity"],
                )

        parts.append(rows.mapInArrow(looked, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed({"key": key, "item": item})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", search: Search = Search()) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for ids, words in item_blocks(items, item, text, search):
        sent = docs.sparkSession.sparkContext.broadcast(words)

        def passed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, search.size, search.radius, search.blocks)
            for batch in batches:
                flat, ends = _flat(batch.column(1))
                good = np.ones(len(batch), bool)
                good[[f[0] for f in found_in(flat, ends, index, search.least)]] = False
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], ["row"])

        rows = docs.select(F.struct("*").alias("row"), word_hashes(F.col(text)).alias("words"))
        docs = rows.mapInArrow(passed, StructType([rows.schema["row"]])).select("row.*")
    return docs
