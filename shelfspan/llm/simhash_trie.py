"""SimHash near-dedup by a self-join of a binary trie of the fingerprints.

Method. The distinct fingerprints are the leaves of a binary trie. The join walks pairs of its nodes together, from the root with
itself: a node with itself leads to its two children with themselves and to the two together; two nodes lead to all four pairs of
children, of which the unlike ones add one differing bit. A pair beyond the error budget is pruned; two leaves left over are a link.

On Spark. Two fingerprints within two bits agree in at least one whole third of their bits. So the trie is taken in three orders
of the bits, each with another third first, and in each order the budget is zero for that third: down to there only nodes with
themselves survive, which makes the subtrees groups of equal thirds that Spark deals out. A subtree of more than `most` leaves is
not walked in one task: its node pairs are expanded by Spark, some bits at a time, until each holds few enough (fingerprints are
distinct, so it ends). Tasks walk many node pairs at once, one bit a step, in arrays. They return each fingerprint's smallest
fellow, not all pairs; components of these links are the groups.

Defined cases: a null text has no words; a text without words has fingerprint zero and is linked like any other; copies share a
fingerprint and are joined as one leaf. A null id never becomes a group's id unless the group has no other. Repeated rows share
their group. Other columns are never looked at (the stage carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpointed, no_nulls
from shelfspan.llm.components import components

BITS = 64
THIRDS = ((0, 22), (22, 21), (43, 21))  # first bit from the top, width
MOST = 16_384
STEP = 6
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit k is set if it is set in more than half of the XXH64 of all shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(BITS, np.int64)
    n = len(words) - size + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 1 << 15):
        some = words[at : min(at + (1 << 15), n) + size - 1]
        hashes = np.fromiter([digest(join(s), SEED) for s in zip(*(some[k:] for k in range(size)))], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per row of docs: key, a hash of the text, and the fingerprint as a signed long."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), no_nulls(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column("text")), np.uint64, len(batch))
            columns = [batch.column("key"), batch.column("text_hash"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "fingerprint"])

    return rows.mapInArrow(printed, f"key {kind}, text_hash long, fingerprint long")


def walk(values: np.ndarray, sides: list[tuple[int, int, int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked values below node pairs (begin, end, other begin, other end); each range is sorted and distinct."""
    at = np.array(sides, np.int64).reshape(-1, 4)
    a0, a1, b0, b1 = at.T
    differ = np.zeros(len(at), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(BITS - 1, -2, -1):
        alone = (a0 == b0) & (a1 == b1)
        # Two single leaves are compared at once; a single leaf with itself is no pair.
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & ~alone
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            found.append((i[near], j[near]))
        more = ~single & ~(alone & (a1 - a0 < 2))
        a0, a1, b0, b1, differ, alone = (x[more] for x in (a0, a1, b0, b1, differ, alone))
        if not len(a0) or bit < 0:
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        pairs = [(a0, am, b0, bm, differ), (am, a1, bm, b1, differ), (a0, am, bm, b1, differ + 1)]
        two = ~alone  # of a node with itself, the unlike children are one pair
        pairs.append(tuple(x[two] for x in (am, a1, b0, bm, differ + 1)))
        a0, a1, b0, b1, differ = (np.concatenate(x) for x in zip(*pairs))
        keep = (a1 > a0) & (b1 > b0) & (differ <= budget)
        a0, a1, b0, b1, differ = (x[keep] for x in (a0, a1, b0, b1, differ))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def smallest_fellows(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected to."""
    low = np.arange(n)
    while True:
        before = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(low, i, both)
        np.minimum.at(low, j, both)
        np.minimum.at(low, before[i], both)
        np.minimum.at(low, before[j], both)
        low = low[low]
        if (low == before).all():
            return low


def _walked(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by node pair; whole node pairs are put together until there are enough to walk at once."""
    names = ["turn", "left", "right", "side", "value"]
    rest: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["value"].to_numpy(np.int64).view(np.uint64)
        heads = rows[["turn", "left", "right"]].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], (heads[1:] != heads[:-1]).any(axis=1))))
        ends = np.append(begins[1:], len(rows))
        side = rows["side"].to_numpy()
        second = np.array([b + np.searchsorted(side[b:e], 1) for b, e in zip(begins, ends)])
        whole = heads[begins, 1] == heads[begins, 2]
        sides = [(b, e, b, e) if w else (b, m, m, e) for b, e, m, w in zip(begins, ends, second, whole) if e - b > 1]
        # Signed longs sort otherwise than their bits, so each side is put in the order of its bits.
        order = np.lexsort((values, side, np.repeat(np.arange(len(begins)), ends - begins)))
        values = values[order]
        i, j = walk(values, [s for s in sides if s[1] > s[0] and s[3] > s[2]], budget)
        turn = rows["turn"].to_numpy()[order].astype(np.uint64)
        shift = np.array([t[0] for t in THIRDS], np.uint64)[turn]
        plain = (values >> shift) | np.where(shift > 0, values << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        plain = np.where(shift > 0, plain, values)
        low = smallest_fellows(len(values), i, j)
        moved = np.flatnonzero(low != np.arange(len(values)))
        return pd.DataFrame({"a": plain[moved].view(np.int64), "b": plain[low[moved]].view(np.int64)})

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        head = rows[["turn", "left", "right"]].to_numpy()
        if len(rows) < MOST or (head[0] == head[-1]).all():
            rest = rows
            continue
        cut = len(rows) - int((head[::-1] != head[-1]).any(axis=1).argmax())
        rest = rows.iloc[cut:]
        yield links(rows.iloc[:cut].reset_index(drop=True))
    if rest is not None and len(rest):
        yield links(rest[names].reset_index(drop=True))


def _top(value: Column, width: int) -> Column:
    return F.shiftrightunsigned(value, BITS - width)


def _expanded(pairs: DataFrame, depth: int, budget: int) -> DataFrame:
    """Every row below the children of its node pair, STEP bits down, as far as the budget allows."""
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << STEP) if m.bit_count() <= budget))
    mine = F.shiftrightunsigned("value", BITS - depth - STEP)
    other = mine.bitwiseXOR(F.col("mask"))
    rows = pairs.withColumn("mask", F.explode(masks))
    # With itself: the smaller child comes first. Two nodes: each row stays on its side.
    alone = F.col("left") == F.col("right")
    first = F.when(alone, mine <= other).otherwise(F.col("side") == 0)
    parted = F.col("left").bitwiseXOR(F.col("right"))
    allowed = F.bit_count("mask") + F.bit_count(parted) <= budget
    return rows.where(allowed).select(
        "turn",
        F.when(first, mine).otherwise(other).alias("left"),
        F.when(first, other).otherwise(mine).alias("right"),
        F.when(first, 0).otherwise(1).alias("side"),
        "value",
    )


def links(prints: DataFrame, budget: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fingerprint) within the budget of differing bits (at most 2)."""
    if budget > len(THIRDS) - 1:
        raise ValueError("three orders of the bits serve at most two differing bits")
    turned = []
    for turn, (first, width) in enumerate(THIRDS):
        value = F.col("fingerprint")
        if first:
            value = F.shiftleft(value, first).bitwiseOR(F.shiftrightunsigned(value, BITS - first))
        turned.append(F.struct(F.lit(turn).alias("turn"), _top(value, width).alias("left"), value.alias("value")))
    rows = prints.select(F.explode(F.array(*turned)).alias("t")).select(
        "t.turn", "t.left", F.col("t.left").alias("right"), F.lit(0).alias("side"), "t.value"
    )
    pair = ["turn", "left", "right"]
    ready: DataFrame | None = None
    depth = 0
    while True:
        large = checkpointed(rows.groupBy(*pair).count().where(F.col("count") > most).select(pair))
        down = {t: width + depth for t, (_, width) in enumerate(THIRDS)}
        if large.isEmpty() or min(down.values()) + STEP > BITS:
            done = rows
        else:
            done = rows.join(large, pair, "left_anti")
        # Names of nodes tell their depth apart by a leading one.
        named = done.select("turn", *((F.col(c) + F.lit(1 << 62 if depth > 40 else 1 << (22 + depth))).alias(c) for c in ("left", "right")), "side", "value")
        ready = named if ready is None else ready.unionByName(named)
        if done is rows:
            break
        below = rows.join(large, pair, "left_semi")
        parts = [_expanded(below.where(F.col("turn") == t), down[t], budget) for t in range(len(THIRDS))]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows, depth = checkpointed(rows), depth + STEP
    dealt = ready.repartition(*pair).sortWithinPartitions(*pair, "side")
    return dealt.mapInPandas(lambda batches: _walked(batches, budget), "a long, b long")


def groups(prints: DataFrame, budget: int = 2, most: int = MOST) -> DataFrame:
    """(fingerprint, root) of all distinct fingerprints; the root names the group."""
    distinct = prints.select("fingerprint").distinct()
    found = components(links(distinct, budget, most))
    return distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of docs: key, text_hash, fingerprint (hex), component_id (the group's smallest key)."""
    prints = checkpointed(fingerprints(docs, key, text, size))
    least = prints.groupBy("fingerprint").agg(F.min("key").alias("least"))
    grouped = groups(prints, budget).join(least, "fingerprint")
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(grouped.join(ids, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select(
        F.col("key").alias(key), "text_hash", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """The rows of docs (columns doc_id, text, and any others) of which each group keeps the one with the smallest doc_id, then text hash.

    Rows equal in doc_id and text are one document and stay once, whichever of their other columns come first.
    """
    found = near_duplicates(docs, size=size, budget=budget)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("own"))
    kept = best.agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    once = rows.groupBy("row_id", "row_hash").agg(F.first("row").alias("row"))
    same = F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_hash") == F.col("kept_hash"))
    return once.join(kept, same, "left_semi").select("row.*")
