"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes, cut into groups where both end together.

Method. Both tokenizations of a text give byte lengths per token, and cumulative ends (of a slice of texts laid end to end). Each
side keeps a dictionary from end to token index; the intersection of the two key sets is the set of common ends, and the sorted
common keys slice both id lists into groups. Within a group, the links are the pairs of an A and a B token whose byte ranges
overlap: every piece between neighbouring merged ends lies under one A and one B token. Links are counted per (A id, B id) over the
whole corpus by a grouped sum; a link is best when its count is the highest of any pair with its B id (ties included).

Defined cases: texts that are null, empty, or whose joined token bytes of either side differ from the encoded bytes have no tokens
(all counts zero, digest ''); special strings inside texts are plain text; repeated rows count each; a null key is carried; only
the key and the text are read. Skew: per-document pairs are summed inside the task first; pairs of the corpus whose count exceeds
1/`hot_parts` of all links (at most `hot_parts` of them, a proven bound) are joined by broadcast, the rest by a shuffle in which no
key holds more than that share.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspan.llm.common import checkpointed, slices
from shelfspan.llm.token_counts import byte_signs

MARK = "▁"
AT_ONCE = 1 << 20  # characters of texts encoded before their rows are handed on
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<struct<a:int,b:int,m:long>>"
)


@functools.cache
def sides(path_a: str, path_b: str) -> tuple[tiktoken.Encoding, sentencepiece.SentencePieceProcessor, list[bytes], list[bytes]]:
    """Both tokenizers, and the bytes of every id of each.

    A's vocabulary is read from its tokenizer file; its ids are its merge ranks, so a rank-ordered byte-pair encoder with the
    library's pre-tokenizing pattern gives the same ids as the file's own library (tests hold them equal), some four times faster.
    Special strings are ordinary text to it.
    """
    signs = byte_signs()
    vocabulary = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True)
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        bytes_a[i] = bytes(signs[ch] for ch in token) if all(ch in signs for ch in token) else token.encode()
    plain = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=False)
    a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes_a[i]: i for i in plain.values()}, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_b = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            bytes_b.append(bytes([int(piece[3:5], 16)]))
        else:
            bytes_b.append(piece.replace(MARK, " ").encode())
    return a, b, bytes_a, bytes_b


def align(
    ids_a: np.ndarray, ids_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end, with the token counts before each and at the end: where both id lists are cut into groups (token
    counts up to each common end, for A and for B), and the links as arrays of the places of their A and B tokens: first those
    whose piece ends with a B token, then the others, each in byte order."""
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    cut_a, cut_b = [], []
    for (from_a, to_a), (from_b, to_b) in zip(itertools.pairwise(stop_a.tolist()), itertools.pairwise(stop_b.tolist())):
        of_a, of_b = ends_a[from_a:to_a].tolist(), ends_b[from_b:to_b].tolist()
        at_a, at_b = dict(zip(of_a, range(from_a + 1, to_a + 1))), dict(zip(of_b, range(from_b + 1, to_b + 1)))
        cut_a += filter(None, map(at_a.get, of_b))  # ends rise, so both are in order; counts are never zero
        cut_b += filter(None, map(at_b.get, of_a))
    cut_a, cut_b = np.array(cut_a, np.int64), np.array(cut_b, np.int64)
    # Every piece between neighbouring ends of the merged set lies under one A token and one B token: one link each.
    alone = np.ones(len(ids_a), bool)
    alone[cut_a - 1] = False
    alone = np.flatnonzero(alone)
    link_a = np.concatenate([np.searchsorted(ends_a, ends_b), alone])
    link_b = np.concatenate([np.arange(len(ids_b)), np.searchsorted(ends_b, ends_a[alone])])
    return cut_a, cut_b, link_a, link_b


@functools.cache
def _spelled(size_a: int, size_b: int) -> np.ndarray:
    """Decimal ids with the sign that follows them: of A inside a group, of A at its end, of B inside, of B at its end."""
    signs = ((size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";"))
    return np.array([f"{i}{sign}" for size, sign in signs for i in range(size)], dtype=object)


def spelled_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, size_a: int, size_b: int) -> list[str]:
    """The parts of `a1,a2|b1;a3|b2,b3;`: the ids of each group with the signs after them, A before B, groups in order."""
    per_a, per_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    # An A token comes after the B tokens of earlier groups, a B token after the A tokens of its own group too.
    spelling = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a - 1], last_b[cut_b - 1] = size_a, size_b
    spelling[np.arange(len(ids_a)) + np.repeat(cut_b - per_b, per_a)] = ids_a + last_a
    spelling[np.arange(len(ids_b)) + np.repeat(cut_a, per_b)] = ids_b + last_b + 2 * size_a
    return _spelled(size_a, size_b)[spelling].tolist()


def _aligned_rows(rows: list, keys: list, texts: list, sides_of: tuple) -> list[list]:
    """ALIGNED rows of one slice of texts, which are laid end to end: both tokenizations end where a text does, so none reaches
    into the next. The pairs of all its documents are counted together."""
    a, b, bytes_a, bytes_b, length_a, length_b = sides_of
    present = [k for k, t in enumerate(texts) if t]
    encoded_a = a.encode_ordinary_batch([" " + texts[k] for k in present], num_threads=1) if present else []
    encoded_b = b.encode([texts[k] for k in present], num_threads=1) if present else []
    found = []
    for k, ids_a, ids_b in zip(present, encoded_a, encoded_b):
        want = (" " + texts[k]).encode("utf-8", "surrogatepass")
        if a.decode_bytes(ids_a) == want and b"".join(map(bytes_b.__getitem__, ids_b)) == want:
            found.append((k, ids_a, ids_b))
    out = [[row, doc, 0, 0, 0, 0, ""] for row, doc in zip(rows, keys)]
    key = m = np.empty(0, np.int64)
    if found:
        stop_a, stop_b = (np.cumsum([0, *(len(f[side]) for f in found)]) for side in (1, 2))
        ids_a, ids_b = (np.concatenate([np.array(f[side], np.int64) for f in found]) for side in (1, 2))
        cut_a, cut_b, link_a, link_b = align(ids_a, ids_b, length_a, length_b, stop_a, stop_b)
        doc_of = np.repeat([f[0] for f in found], np.diff(stop_a))  # of every A token
        # ids of A below 2**16, of B below 2**16
        key, m = np.unique((doc_of[link_a] << 32) + (ids_a[link_a] << 16) + ids_b[link_b], return_counts=True)
        n_links = np.bincount(doc_of[link_a], minlength=len(texts))
        groups = np.searchsorted(cut_a, stop_a, side="right")
        parts = spelled_groups(ids_a, ids_b, cut_a, cut_b, len(bytes_a), len(bytes_b))
        for d, (k, of_a, of_b) in enumerate(found):
            text = "".join(parts[stop_a[d] + stop_b[d] : stop_a[d + 1] + stop_b[d + 1]])[:-1]
            digest = hashlib.sha256(text.encode()).hexdigest()
            out[k][2:] = [len(of_a), len(of_b), int(groups[d + 1] - groups[d]), int(n_links[k]), digest]
    at = np.searchsorted(key >> 32, np.arange(len(texts) + 1))
    for k, r in enumerate(out):
        part = slice(at[k], at[k + 1])
        r.append({"a": ((key[part] >> 16) & 0xFFFF).astype(np.int32), "b": (key[part] & 0xFFFF).astype(np.int32), "m": m[part]})
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs (ALIGNED): counts, the digest of the groups, and the document's links summed by id pair."""
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, bytes_a, bytes_b = sides(path_a, path_b)
        sides_of = (a, b, bytes_a, bytes_b, np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b]))
        for batch in batches:
            rows, keys, texts = (batch.column(k).to_pylist() for k in range(3))
            for at, end in slices([len(t or "") for t in texts], AT_ONCE):  # so that encodings of a batch never pile up
                yield _batch(_aligned_rows(rows[at:end], keys[at:end], texts[at:end], sides_of))

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")
    )
    return rows.mapInArrow(worked, ALIGNED)


def _batch(out: list[list]) -> pa.RecordBatch:
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())])
    offsets = np.cumsum([0, *(len(r[7]["m"]) if r[7] else 0 for r in out)]).astype(np.int32)
    parts = [r[7] for r in out if r[7]]
    flat = {n: np.concatenate([p[n] for p in parts]) if parts else np.empty(0, t) for n, t in (("a", np.int32), ("b", np.int32), ("m", np.int64))}
    pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[n]) for n in "abm"], fields=list(pair)))
    columns = list(zip(*out)) if out else [[] for _ in range(8)]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = [pa.int64()] * 6 + [pa.string()]
    arrays = [pa.array(list(c), t) for c, t in zip(columns[:7], types)]
    return pa.RecordBatch.from_arrays([*arrays, pairs], names=[*names, "pairs"])


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hot_parts: int = 4096) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = checkpointed(aligned(docs, path_a, path_b, key, text))
    pairs = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.m")
    counts = pairs.groupBy("a", "b").agg(F.sum("m").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    judged = checkpointed(
        counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    )
    total = judged.agg(F.sum("count")).first()[0] or 0
    line = total / hot_parts
    hot = F.broadcast(judged.where(F.col("count") > line))
    cold = judged.where(F.col("count") <= line)
    linked = pairs.join(hot, ["a", "b"]).unionByName(pairs.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(cold, ["a", "b"]))
    per_row = linked.groupBy("row").agg(
        F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum")
    )
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
