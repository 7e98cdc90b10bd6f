"""SentencePiece (merge type) encoding by a table of each prefix's last token, and decoding.

Method. For a merge-type model the tokens of a prefix end with one certain token, whatever follows the prefix; a token t can be the last
one of a prefix exactly if the prefix before it ends with a token u such that the two together encode to (u, t). So one pass over
the matches of an automaton of all pieces fills the table last[i], testing at every end i which matching piece goes with
last[i - len(piece)]; walking back from the end then gives the ids. Whether two pieces go together is found by merging their joined
text and is remembered.

Blanks become the mark U+2581, one more is put before the text, and nothing else is changed (models with other rules are refused). A
piece holds the mark only at its start or all through, so texts fall into runs of marks and what follows them, each encoded once
and looked up again. Runs of usual length are encoded side by side: a trie of the pieces, kept as arrays, finds all matches in all of
them at once, and last[i] is filled for all runs at i = 0, then 1, and so on, the pairs looked up in an array; long runs, and a few
runs alone, go through the automaton one by one. Characters without a piece become their UTF-8 bytes' pieces. Every run learnt is decoded from its ids; the
decoded text is kept beside them only where it is not the run itself.

Defined cases: a null text is empty and has no ids; repeated rows are encoded alike; other columns are never looked at. Memory: one
Arrow batch, slices of about 262,144 characters, bounded memories of runs and pairs, and the table of one run (a long run is one
table of its length).
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import no_nulls, slices

MARK = "▁"
AT_ONCE = 1 << 18  # characters of texts whose runs are learnt together
REMEMBERED_RUNS = 300_000  # some 200 bytes each
REMEMBERED_PAIRS = 1_000_000
USUAL = 64  # characters; longer runs are neither remembered nor encoded side by side
SIDE_BY_SIDE = 100  # runs; fewer are sooner done one by one
PAIR_SLOTS = 20  # bits; a pair remembered gives way to another one of its slot


class PieceTrie:
    """The pieces by their characters, in arrays: a node's child by a sign lies at the hash of the two or in the next slots."""

    def __init__(self, pieces: dict[str, int]):
        signs = sorted(set("".join(pieces)))
        self.sign = np.zeros(0x110000, np.uint16 if len(signs) < 1 << 16 else np.int32)  # of a character; 0: in no piece
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        nodes: dict[tuple[int, str], int] = {}
        token = [-1]
        for text, k in pieces.items():
            node = 0
            for c in text:
                child = nodes.setdefault((node, c), len(token))
                if child == len(token):
                    token.append(-1)
                node = child
            token[node] = k
        self.token = np.array(token, np.int32)
        self.n_signs = len(signs) + 1
        bits = (2 * len(nodes)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.children = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at = {c: k for k, c in enumerate(signs, 1)}
        keys = np.array([node * self.n_signs + at[c] for node, c in nodes], np.int64)
        for key, slot, child in zip(keys.tolist(), _hashed(keys, self.shift).tolist(), nodes.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.children[slot] = key, child

    def child(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The nodes' children; -1 where there is none."""
        key = node.astype(np.int64) * self.n_signs + sign
        slot = _hashed(key, self.shift)
        held = self.keys.take(slot)
        hit = held == key
        child = np.where(hit, self.children.take(slot), -1)
        seek = np.flatnonzero(~hit & (held >= 0))
        while len(seek):
            slot[seek] = (slot[seek] + 1) & self.mask
            held, wanted = self.keys[slot[seek]], key[seek]
            hit = held == wanted
            child[seek[hit]] = self.children[slot[seek[hit]]]
            seek = seek[~hit & (held >= 0)]
        return child

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a piece begins, its length and its number, for all pieces at all places of a text given by its characters' numbers."""
        sign = np.append(self.sign[codes], 0).astype(np.int64)
        begin = np.flatnonzero(sign)
        node = self.child(np.zeros(len(begin), np.int64), sign[begin])
        found, length = [], 0
        while len(begin):
            length += 1
            token = self.token.take(node)
            is_piece = token >= 0
            found.append((begin[is_piece], np.full(np.count_nonzero(is_piece), length, np.int64), token[is_piece]))
            follows = sign.take(begin + length)
            goes_on = np.flatnonzero(follows)
            begin, node = begin.take(goes_on), self.child(node.take(goes_on), follows.take(goes_on))
            goes_on = np.flatnonzero(node >= 0)
            begin, node = begin.take(goes_on), node.take(goes_on)
        return tuple(np.concatenate(part) if part else np.empty(0, np.int64) for part in (zip(*found) if found else ((), (), ())))


def _hashed(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64)


class PrefixTable:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(k) for k in range(n)]
        if model.normalize("ﬁ  ½ ") != MARK + "ﬁ" + MARK * 2 + "½" + MARK:
            raise ValueError("only models that leave texts as they are, with a mark before them, are supported")
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.control = {k for k in range(n) if model.is_control(k)}
        self.unknown = model.unk_id()
        self.size = n
        self.first_plain = 1 + max(k for k in range(n) if model.is_byte(k) or model.is_control(k) or model.is_unknown(k))
        for k, text in enumerate(self.piece):
            if model.is_byte(k):
                self.byte_of[k] = int(text[3:5], 16)
                self.bytes[int(text[3:5], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                if text.rfind(MARK) > 0 and text.strip(MARK):
                    raise ValueError(f"piece {text!r} reaches over the start of a run")
                self.id[text] = k
                self.rank[text] = -model.get_score(k)
        self.automaton = ahocorasick.Automaton()
        for text, k in self.id.items():
            self.automaton.add_word(text, (len(text), k))
        self.automaton.make_automaton()
        self.trie = PieceTrie(self.id)
        self.whole = np.full(n, -1, np.int8)  # whether a token's text merges into it; -1: not yet found out
        self.pair_slots = np.full(1 << PAIR_SLOTS, -2, np.int64)  # twice the pair's number, and one if the two go together
        self.run = re.compile(f"{MARK}({MARK}*[^{MARK}]+|{MARK}*)")
        self.pairs: dict[int, bool] = {}
        self.id_text = [str(k) for k in range(n)]
        signs = set("".join(self.piece))
        self.between = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in signs)
        self.marked = [t.startswith(MARK) for t in self.piece]
        # Of a run without its first mark: its ids joined by commas, and the text decoded from them if that is not the marked run.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}  # what was known when the memory was last half full; runs met again move over
        self.altered: dict[str, str] = {}
        self.chains: dict[int, tuple[bool, list, list]] = {}

    def text_of(self, token: int) -> str:
        """A token's text; numbers from the vocabulary's size on are characters without a piece."""
        return self.piece[token] if token < self.size else chr(token - self.size)

    def _chains(self, token: int) -> tuple[bool, list, list]:
        """Whether a token's text merges into it, and what stands at its right and at its left end while it does.

        Each chain is a list of (symbol, rank at which it is merged away): the highest rank of all merges since the symbol came up
        until it goes, as one of them may have to wait for another. The token itself is never merged away.
        """
        known = self.chains.get(token)
        if known is not None:
            return known
        parts = list(self.text_of(token))
        right, left = [], []
        wait_right = wait_left = -math.inf
        while len(parts) > 1:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1], math.inf)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            wait_right, wait_left = max(wait_right, best), max(wait_left, best)
            if at == len(parts) - 2:
                right.append((parts[-1], wait_right))
                wait_right = -math.inf
            if at == 0:
                left.append((parts[0], wait_left))
                wait_left = -math.inf
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        right.append((parts[-1], math.inf))
        left.append((parts[0], math.inf))
        known = self.chains[token] = (len(parts) == 1, right, left)
        return known

    def together(self, first: int, second: int) -> bool:
        """Whether the joined text of two tokens encodes to just these two: no merge ever reaches over where they meet."""
        key = first * (self.size + 0x110000) + second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._never_merge(first, second)
        return known

    def _never_merge(self, first: int, second: int) -> bool:
        whole, _, left = self._chains(second)
        if not whole:
            return False
        right = self._chains(first)[1]
        i = j = 0
        while True:
            (a, a_goes), (b, b_goes) = right[i], left[j]
            over = self.rank.get(a + b, math.inf)
            if a_goes <= b_goes:  # of merges of one rank the left one comes first
                if over < a_goes:
                    return False
                if a_goes == math.inf:
                    return True
                i += 1
            else:
                if over <= b_goes:
                    return False
                j += 1

    def tokens(self, runs: list[str]) -> list[list[int]]:
        """Tokens of runs, each without its first mark; a character without a piece is the vocabulary's size plus its number."""
        usual = [run for run in runs if len(run) <= USUAL]
        if len(usual) < SIDE_BY_SIDE:
            return self._tokens_one_by_one(runs)
        found = self._tokens_side_by_side(usual)
        if len(usual) == len(runs):
            return found
        rest = iter(self._tokens_one_by_one([run for run in runs if len(run) > USUAL]))
        some = iter(found)
        return [next(some if len(run) <= USUAL else rest) for run in runs]

    def _whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token's text merges into it."""
        for token in np.unique(tokens[self.whole[tokens] < 0]).tolist():
            self.whole[token] = self._chains(token)[0]
        return self.whole[tokens] > 0

    def _tokens_side_by_side(self, runs: list[str]) -> list[list[int]]:
        """As tokens, for runs of usual length: last[i] of all runs for one i after the other."""
        text = self.between.join([MARK + run for run in runs])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        starts = np.cumsum(sizes + 1) - sizes - 1
        place = (np.arange(len(codes)) - np.repeat(starts, sizes + 1)[: len(codes)]).astype(np.int16)  # within the run
        last = codes.astype(np.int64) + self.size
        width = np.ones(len(codes), np.int64)
        settled = np.zeros(len(codes), bool)
        begin, length, token = self.trie.matches(codes)
        end = begin + length - 1
        at_end = place.take(end)
        order = np.argsort(at_end, kind="stable")
        begin, length, token, end = begin.take(order), length.take(order), token.take(order).astype(np.int64), end.take(order)
        bounds = np.cumsum(np.bincount(at_end, minlength=1)).tolist()
        base, shift = self.size + 0x110000, np.uint64(64 - PAIR_SLOTS)
        for at, (first, stop) in enumerate(zip([0, *bounds], bounds)):
            if first == stop:
                continue
            ends, lengths, tokens = end[first:stop], length[first:stop], token[first:stop]
            # Only the piece that is the whole prefix has no token before it.
            alone = lengths > at
            fits = np.zeros(stop - first, bool)
            fits[alone] = self._whole(tokens[alone])
            key = last.take(begin[first:stop] - 1, mode="wrap") * base + tokens
            held = self.pair_slots.take(_hashed(key, shift))
            fits |= (held == key * 2 + 1) & ~alone
            settled[ends[fits]] = True
            ask = np.flatnonzero(~((held >> 1 == key) | alone | settled.take(ends)))
            if len(ask):
                pairs, which = np.unique(key[ask], return_inverse=True)
                go = np.array([self._never_merge(*divmod(pair, base)) for pair in pairs.tolist()])
                self.pair_slots[_hashed(pairs, shift)] = pairs * 2 + go
                fits[ask] = go[which]
            last[ends[fits]] = tokens[fits]
            width[ends[fits]] = lengths[fits]
        # Back from the ends: the k-th round finds each run's k-th token from its end.
        rounds, run, place_of_end = [], np.arange(len(runs)), starts + sizes - 1
        while len(run):
            rounds.append((run, last[place_of_end]))
            place_of_end = place_of_end - width[place_of_end]
            goes_on = np.flatnonzero(place_of_end >= starts[run])
            run, place_of_end = run[goes_on], place_of_end[goes_on]
        stops = np.cumsum(np.bincount(np.concatenate([run for run, _ in rounds]), minlength=len(runs)))
        found = np.empty(stops[-1], np.int64)
        for k, (run, tokens) in enumerate(rounds, 1):
            found[stops[run] - k] = tokens
        found, stops = found.tolist(), stops.tolist()
        return [found[a:b] for a, b in zip([0, *stops], stops)]

    def _tokens_one_by_one(self, runs: list[str]) -> list[list[int]]:
        """As tokens. The runs lie one behind the other in one text and one table, between characters that no piece holds."""
        text = self.between.join([MARK + run for run in runs])
        size, mark = self.size, MARK
        last = [size + ord(c) for c in text]  # of the prefix, of its run, that ends here
        width = [1] * len(text)
        pairs, together, base, marked = self.pairs, self.together, size + 0x110000, self.marked
        settled = -1  # only one token can be the last of a prefix
        for end, (length, token) in self.automaton.iter(text):
            if end == settled:
                continue
            begin = end - length
            if marked[token] and (begin < 0 or text[begin] != mark):
                fits = self._chains(token)[0]
            else:
                before = last[begin]
                fits = pairs.get(before * base + token)
                if fits is None:
                    fits = together(before, token)
            if fits:
                last[end] = token
                width[end] = length
                settled = end
        out, stop = [], len(text)
        for run in reversed(runs):
            begin = stop - len(run) - 1
            found, at = [], stop - 1
            while at >= begin:
                found.append(last[at])
                at -= width[at]
            found.reverse()
            out.append(found)
            stop = begin - 1
        out.reverse()
        return out

    def _bytes_spelled(self, tokens: list[int]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if token < self.size:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in chr(token - self.size).encode())
        return out

    def runs_of(self, text: str) -> list[str]:
        """The runs, each without its first mark; nothing of an empty text."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return self.run.findall(MARK + text.replace(" ", MARK))

    def learn(self, new: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids of runs, and the decoded text of those runs that it changes."""
        id_text, piece = self.id_text, self.piece
        learnt, altered = {}, {}
        for at, end in slices([len(run) for run in new], AT_ONCE):
            some = new[at:end]
            for run, tokens in zip(some, self.tokens(some)):
                if max(tokens) >= self.size or min(tokens) < self.first_plain:
                    tokens = self._bytes_spelled(tokens)
                    text = self.spelled(tokens)
                else:
                    text = "".join([piece[t] for t in tokens])
                learnt[run] = ",".join([id_text[t] for t in tokens])
                if text != MARK + run:
                    altered[run] = text
        return learnt, altered

    def rows(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids joined by commas, and decoded text of each text; texts are taken together to learn their runs at once."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(self.runs_of(text or ""))
            size += len(text or "")
            if size >= AT_ONCE:
                yield from self._settled(waiting)
                waiting, size = [], 0
        yield from self._settled(waiting)

    def _settled(self, waiting: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        """rows, of texts given by their runs; every distinct run of them is looked up once."""
        ids, altered = self._ids(set().union(*waiting))
        for found in waiting:
            joined = ",".join(map(ids.__getitem__, found))
            # A character's bytes never reach over the end of a run, so runs can be decoded one by one.
            if altered and not altered.keys().isdisjoint(found):
                text = "".join([altered.get(run, MARK + run) for run in found])
            else:
                text = MARK + MARK.join(found) if found else ""
            yield joined.count(",") + 1 if joined else 0, joined, self.unmarked(text)

    def _ids(self, runs: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids of runs, and the decoded text of those that it changes, remembered or learnt."""
        known, older = self.known, self.older
        ids = dict(zip(runs, map(known.get, runs)))
        new = []
        for run in [run for run, k in ids.items() if k is None]:
            if (k := older.get(run)) is None:
                new.append(run)
            else:
                ids[run] = known[run] = k
        learnt, altered = self.learn(new)
        ids.update(learnt)
        altered.update((run, self.altered[run]) for run in self.altered.keys() & runs)
        if max(map(len, learnt), default=0) > USUAL:
            learnt = {run: k for run, k in learnt.items() if len(run) <= USUAL}
        known.update(learnt)
        self.altered.update((run, k) for run, k in altered.items() if len(run) <= USUAL)
        if len(known) > REMEMBERED_RUNS // 2:
            self.known, self.older = {}, known
            self.altered = {run: k for run, k in self.altered.items() if run in known}
        return ids, altered

    def row(self, text: str | None) -> tuple[int, str, str]:
        return next(self.rows([text]))

    def encode(self, text: str | None) -> list[int]:
        return [k for tokens in self.tokens(self.runs_of(text or "")) for k in self._bytes_spelled(tokens)]

    def spelled(self, ids: Sequence[int]) -> str:
        """The marked text of ids: neighbouring byte pieces are read together, control ids say nothing."""
        out: list[str] = []
        pending = bytearray()
        for k in ids:
            byte = self.byte_of.get(k)
            if byte is not None:
                pending.append(byte)
                continue
            if pending:
                out.append(_utf8(pending))
                pending.clear()
            if k == self.unknown:
                out.append(" ⁇ ")
            elif k not in self.control:
                out.append(self.piece[k])
        if pending:
            out.append(_utf8(pending))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        return self.unmarked(self.spelled(ids))

    @staticmethod
    def unmarked(spelled: str) -> str:
        return spelled[spelled.startswith(MARK) :].replace(MARK, " ")


def _utf8(data: bytearray) -> str:
    """The text; every byte that is not part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_tokens, and SHA-256 of the ids and of the decoded text."""
    rows = docs.select(F.col(key).alias("key"), no_nulls(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for count, joined, spelled in table.rows(t.as_py() for t in batch.column("text")):
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(spelled.encode()).hexdigest())
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(encoded, schema).withColumnRenamed("key", key)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, the ids and the text decoded from them."""
    rows = docs.select(F.col(key).alias("key"), no_nulls(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            # A slice at a time, and numbers in arrays: lists of ids take many times the room of the texts.
            for at, end in slices(pc.utf8_length(batch.column("text")).to_pylist(), AT_ONCE):
                some = batch.slice(at, end - at)
                found = [(np.fromstring(ids, np.int32, sep=","), text) for _, ids, text in table.rows(t.as_py() for t in some.column("text"))]
                offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[0] for f in found]), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("key"), ids, pa.array([f[1] for f in found], pa.string())], ["key", "ids", "decoded"])

    return rows.mapInArrow(worked, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
