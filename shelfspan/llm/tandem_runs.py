"""Periodic run detection over words, by the branching-tandem test on an enhanced suffix array.

Method. The words of many documents are numbered and laid end to end, each document closed by a sign of its own, so no repeat
crosses a document. A suffix array is built by prefix doubling (every round's ranks are kept), the LCP array from those ranks, and
the LCP intervals from the nearest smaller LCP values on either side; no tree nodes are made. For each interval of depth d, the
suffixes i of every child but the largest check whether i + d (and i - d) lies in the interval but in another child: then the
square at i (or i - d) of period d is branching, its next word differs. Each branching square is rotated to the left as far as the
period holds (the leftmost start found by a binary search over longest common extensions) and ends where it is; equal stretches are
merged and keep their smallest period. A run is such a stretch of length >= max(6, 4 * period).

A word is dropped if a run holds it after that run's first `period` words; the kept words are the collapsed text.

Defined cases: a null text has no words; a document without runs has n_runs 0 and null start, length, period, exponent; of runs of
equal length the one with the smallest start, then period, is the longest; repeated rows are scanned alike; a null key is carried.
Work is done on slices of at most `AT_ONCE` words of whole documents (a longer document is a slice of its own), so memory grows with
the largest document, not with the partition.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

AT_ONCE = 1 << 18  # words of one slice
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's change: for h = crc32(decimal id) with h % 10 = 0, a periodic tail from word a on; null ids are left alone."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_ranks(seq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and the rank arrays of prefix doubling: ranks[j][i] orders suffix i by its first 2**j symbols."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    first = np.empty(n, np.int64)
    sorted_seq = seq[order]
    head = np.r_[True, sorted_seq[1:] != sorted_seq[:-1]]
    first[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks = [first]
    h = 1
    while True:
        rank = ranks[-1]
        key_head = rank[order]
        unsettled = np.r_[key_head[1:] == key_head[:-1], False] | np.r_[False, key_head[1:] == key_head[:-1]]
        if not unsettled.any():
            return order, ranks
        at = np.flatnonzero(unsettled)
        members = order[at]
        follow = np.where(members + h < n, rank[np.minimum(members + h, n - 1)], -1)
        resort = np.lexsort((follow, rank[members]))
        members, follow, heads = members[resort], follow[resort], rank[members][resort]
        order[at] = members
        new = rank.copy()
        change = np.r_[True, (heads[1:] != heads[:-1]) | (follow[1:] != follow[:-1])]
        new[members] = np.maximum.accumulate(np.where(change, at, 0))
        ranks.append(new)
        h *= 2


def extension(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension of suffixes a and b, pairwise, from the kept ranks."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < n) & (y < n)
        same = ok & (ranks[j][np.minimum(x, n - 1)] == ranks[j][np.minimum(y, n - 1)])
        length += np.where(same, 1 << j, 0)
    return length


def _nearest_smaller(lcp: np.ndarray, table: list[np.ndarray], at: np.ndarray, step: int) -> np.ndarray:
    """For each place k of at, the nearest place to the left (step -1) or right (+1) whose value is smaller than lcp[k].

    table[j][i] is the least of lcp[i : i + 2**j]; blocks of falling size are passed over while none is smaller.
    """
    m, value = len(lcp), lcp[at]
    for j in range(len(table) - 1, -1, -1):
        w = 1 << j
        lo = at - w if step < 0 else at + 1
        ok = (lo >= 0) & (lo + w <= m)
        low = table[j][np.clip(lo, 0, len(table[j]) - 1)]
        at = np.where(ok & (low >= value), at - w if step < 0 else at + w, at)
    return at - 1 if step < 0 else at + 1


def branching_squares(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching squares."""
    n = len(order)
    isa = np.empty(n, np.int64)
    isa[order] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = extension(ranks, order[:-1], order[1:])
    inner = np.flatnonzero(lcp > 0)
    if len(inner) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = [lcp]
    while (1 << len(table)) <= len(lcp):
        w = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    left = _nearest_smaller(lcp, table, inner, -1)  # the interval starts at this suffix-array place
    right = _nearest_smaller(lcp, table, inner, 1) - 1  # and ends here
    depth = lcp[inner]
    by = np.lexsort((inner, depth, left))
    k, left, right, depth = inner[by], left[by], right[by], depth[by]
    node_start = np.r_[True, (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])]
    node = np.cumsum(node_start) - 1
    # Children: [left, k1), [k1, k2), ..., [km, right]; the first child of a node begins at its left end.
    child_lo = np.concatenate([left[node_start], k])
    child_node = np.concatenate([node[node_start], node])
    nxt = np.r_[k[1:], 0]
    last_of_node = np.r_[node_start[1:], True]
    child_hi = np.concatenate([k[node_start] - 1, np.where(last_of_node, right, nxt - 1)])
    lo_node = left[node_start][child_node]
    hi_node = right[node_start][child_node]
    d_node = depth[node_start][child_node]
    size = child_hi - child_lo + 1
    # One largest child per node is skipped (the first of equal size is kept out by its place).
    by_size = np.lexsort((child_lo, -size, child_node))
    skip = np.zeros(len(size), bool)
    first_of = np.r_[True, child_node[by_size][1:] != child_node[by_size][:-1]]
    skip[by_size[first_of]] = True
    keep = ~skip
    lo, hi, s = child_lo[keep], child_hi[keep], size[keep]
    places = np.repeat(lo - np.r_[0, np.cumsum(s)[:-1]], s) + np.arange(s.sum())
    node_lo, node_hi, d = np.repeat(lo_node[keep], s), np.repeat(hi_node[keep], s), np.repeat(d_node[keep], s)
    own_lo, own_hi = np.repeat(lo, s), np.repeat(hi, s)
    i = order[places]
    starts, periods = [], []
    for j, start in ((i + d, i), (i - d, i - d)):
        ok = (j >= 0) & (j < n)
        r = isa[np.clip(j, 0, n - 1)]
        hit = ok & (r >= node_lo) & (r <= node_hi) & ((r < own_lo) | (r > own_hi))
        starts.append(start[hit])
        periods.append(d[hit])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def runs_of(seq: np.ndarray, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Rows (start, end, period) of maximal periodic stretches of length >= 2 * period, smallest period each, by start."""
    square, period = branching_squares(order, ranks)
    if len(square) == 0:
        return np.empty((0, 3), np.int64)
    end = square + 2 * period
    # Leftmost p <= square with extension(p, p + period) >= end - period - p: a binary search of the rotation.
    lo, hi = np.zeros(len(square), np.int64), square.copy()  # offsets back from square
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        p = square - mid
        holds = extension(ranks, p, p + period) >= end - period - p
        lo, hi = np.where(holds, mid, lo), np.where(holds, hi, mid - 1)
    start = square - lo
    found = np.stack([start, end, period], axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.r_[True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])]
    return found[first]


def detect(docs: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For documents as word lists: their runs (start, length, period) and the mask of kept words."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not docs:
        return out
    sizes = np.array([len(w) for w in docs], np.int64)
    ids = pd.factorize(pd.Series(list(itertools.chain.from_iterable(docs)), dtype=object))[0].astype(np.int64)
    seq = np.empty(sizes.sum() + len(docs), np.int64)
    where = np.cumsum(sizes + 1) - 1  # places of the closing signs
    closing = np.zeros(len(seq), bool)
    closing[where] = True
    seq[~closing] = ids
    seq[closing] = -1 - np.arange(len(docs))
    order, ranks = suffix_ranks(seq)
    found = runs_of(seq, order, ranks)
    begins = where - sizes
    doc_of = np.searchsorted(where, found[:, 0]) if len(found) else np.empty(0, np.int64)
    length = found[:, 1] - found[:, 0]
    long_enough = length >= np.maximum(6, 4 * found[:, 2])
    found, doc_of, length = found[long_enough], doc_of[long_enough], length[long_enough]
    for d, n in enumerate(sizes):
        mine = doc_of == d
        rows = found[mine]
        start = rows[:, 0] - begins[d]
        runs = np.stack([start, length[mine], rows[:, 2]], axis=1) if len(rows) else np.empty((0, 3), np.int64)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
        np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
        out.append((runs, np.cumsum(marks)[:n] == 0))
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def summary(doc_id: int | None, runs: np.ndarray, kept: np.ndarray, words: list[str]) -> dict:
    if len(runs):
        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]]
        start, length, period = (int(v) for v in best)
        exponent = (1000 * length) // period
    else:
        start = length = period = exponent = None
    return {
        "doc_id": doc_id,
        "n_words": len(words),
        "n_runs": len(runs),
        "start": start,
        "length": length,
        "period": period,
        "exponent_milli": exponent,
        "runs_sha256": _sha("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())),
        "collapsed_sha256": _sha(" ".join(w for w, k in zip(words, kept.tolist()) if k)),
    }


SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """One row per row of docs, SCHEMA: runs of words (with the contract's planted tails when plant is set)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [WORD.findall(t or "") for t in texts]
            if plant:
                words = [planted(i, w) for i, w in zip(ids, words)]
            rows: list[dict] = []
            at = 0
            while at < len(words):
                end, total = at + 1, len(words[at])
                while end < len(words) and total + len(words[end]) <= AT_ONCE:
                    total += len(words[end])
                    end += 1
                for k, (runs, kept) in enumerate(detect(words[at:end])):
                    rows.append(summary(ids[at + k], runs, kept, words[at + k]))
                at = end
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(scanned, SCHEMA)


def _arrow_schema() -> pa.Schema:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.schema([(name, pa.string() if name.endswith("sha256") else pa.int64()) for name in names])
