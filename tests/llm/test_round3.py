"""Cross-tokenizer alignment (op11), periodic runs (op12) and personal data (op13) against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from shelfspan.llm import pii_disclosure, tandem_runs, token_alignment
from shelfspan.llm.queries import QUERIES
from shelfspan.llm.token_counts import byte_signs

from brute import BLANK_WORD, sha

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- op12: periodic runs -------------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] == words[i + q]:
                j = i
                while j < n - q and words[j] == words[j + q]:
                    j += 1
                s, e = i, j + q
                if e - s >= 2 * q and ((s, e) not in found or q < found[(s, e)]):
                    found[(s, e)] = q
                i = j
            i += 1
    runs = sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))
    kept = [True] * n
    for s, length, q in runs:
        for k in range(s + q, s + length):
            kept[k] = False
    return runs, kept


def plain_summary(doc_id, text):
    words = BLANK_WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs, kept = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        doc_id, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for w, k in zip(words, kept) if k)),
    )


def test_runs_equal_plain_search_on_random_words():
    rng = random.Random(7)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(0, 50)
            words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(n)]
            if n and rng.random() < 0.4:
                p, at = rng.randint(1, 5), rng.randint(0, n - 1)
                words = words[:at] + [words[at + (i - at) % p] for i in range(at, n)]
            docs.append(words)
        for words, (runs, kept) in zip(docs, tandem_runs.detect(docs)):
            want, want_kept = plain_runs(words)
            assert [tuple(r) for r in runs.tolist()] == want
            assert kept.tolist() == want_kept


def test_runs_of_long_and_uniform_documents():
    for words in (["a"] * 30000, ["x", "y", "z"] * 9000, [str(k % 101) for k in range(40000)]):
        (runs, kept), = tandem_runs.detect([words])
        period = len(set(words))
        assert runs.tolist() == [[0, len(words), period]]
        assert kept.sum() == period


def test_op12_query_matches_plain(spark, documents, folder, sample_texts, rows):
    texts = [*sample_texts, "a b a b a b a b a b", "w " * 7 + "v", "p q r p q r p q r p q r p q r x"]
    # ids chosen so that some of them plant a periodic tail (crc32 % 10 == 0)
    planted = [k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 10 == 0][:8]
    docs = [(k, t) for k, t in enumerate(texts)] + [(k, "one two three four five six seven eight nine ten") for k in planted]
    docs += [(None, "a a a a a a"), (3, texts[3])]
    df = documents(docs, extra=True)
    got = rows(QUERIES["op12_periodic_runs"](spark, folder(df)).drop("n_words"))
    want = sorted((plain_summary(k, t) for k, t in docs), key=lambda t: [(v is None, str(v)) for v in t])
    assert got == want


def test_op12_empty_table(spark, documents, folder):
    assert QUERIES["op12_periodic_runs"](spark, folder(documents([]).limit(0))).count() == 0


@pytest.fixture
def folder(tmp_path):
    """A folder holding df as its documents table, as the queries read it."""
    made = iter(range(1000))

    def write(df):
        path = tmp_path / f"t{next(made)}"
        df.write.parquet(str(path / "documents.parquet"))
        return str(path)

    return write


# ---- op13: personal data -------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = "".join(ch for ch in value if ch.isdigit() and ch.isascii())
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in regex.finditer(pattern, text):
            if valid(kind, m[0]):
                norm = m[0].lower() if kind == "email" else "".join(ch for ch in m[0] if ch.isdigit())
                out.append((rank, m.start(), m.end(), kind, f"{kind}:{norm}"))
    return out


def plain_context(text, start, end, window=5, reach=200):
    letter, term = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")
    begin = max(start - reach, 0)
    before_text, after_text = text[begin:start], text[end : end + reach]
    before = [m[0] for m in term.finditer(before_text)]
    after = [m[0] for m in term.finditer(after_text)]
    if begin > 0 and letter.match(text[begin - 1]) and letter.match(before_text[:1]):
        before = before[1:]  # a term cut by the reach's edge
    if end + reach < len(text) and letter.match(text[end + reach]) and letter.match(after_text[-1:]):
        after = after[:-1]
    return [t.lower() for t in before[-window:] + after[:window]]


def plain_pii(docs, support=2, bits=1.0):
    term = regex.compile(r"\p{L}+")
    bases = [plain_base(t or "") for _, t in docs]
    near, held = collections.Counter(), collections.Counter()
    for (_, text), base in zip(docs, bases):
        text = text or ""
        near.update({(t, b[4]) for b in base for t in plain_context(text, b[1], b[2])})
        held.update({m[0].lower() for m in term.finditer(text)})
    disclosing = {t for (t, e), c in near.items() if c >= support and -np.log2(c / held[t]) <= bits}
    out = []
    for (key, text), base in zip(docs, bases):
        text = text or ""
        linked = [
            (4, m.start(), m.end(), "linked", m[0].lower())
            for m in term.finditer(text)
            if m[0].lower() in disclosing and not any(b[1] < m.end() and m.start() < b[2] for b in base)
        ]
        spans = sorted(base + linked)
        text_of = lambda ss: ",".join(f"{s[3]}:{s[1]}:{s[2]}" for s in ss)
        counts = collections.Counter(b[3] for b in base)
        out.append((key, counts["email"], counts["ip"], counts["card"], counts["phone"], sha(text_of(base)), text_of(spans), len(linked)))
    return out


PRIVATE = [
    "Write to Jane.Doe@Example.org or call +49 151 2345 6789 today.",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 1.2.3.4 and 256.1.1.1 and 01.02.03.004",
    "Quintarelli wrote from quintarelli@mail.example.com about the plan",
    "Quintarelli again: quintarelli@mail.example.com, phone +1 (555) 010-9999",
    "Quintarelli signs off.",
    "server 10.0.0.1.5 and 999999999999999999999.1.1.1 and a@b.c.d@e.f",
    "+12 34 +1234567 +1234567890123456789 +44 20 7946 0958",
    "4539 1488 0343 6467 1234567812345670 79927398713",
]


def test_op13_query_matches_plain(spark, documents, folder, sample_texts, rows):
    texts = [*sample_texts, *PRIVATE, "x" * 300 + " Zed zed@a.io", "Zed zed@a.io " + "y" * 300]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, PRIVATE[0]), (1, PRIVATE[2])]
    got = rows(QUERIES["op13_pii"](spark, folder(documents(docs, extra=True))).drop("sanitised_chars"))
    want = sorted(plain_pii(docs), key=lambda t: [(v is None, str(v)) for v in t])
    assert got == want
    assert any(r[7] > 0 for r in want)  # the repeated name is linked


def test_op13_sanitised_text(spark, documents):
    df = documents([(1, PRIVATE[2]), (2, PRIVATE[3]), (3, PRIVATE[4]), (4, None)])
    got = {r["doc_id"]: r["sanitised"] for r in pii_disclosure.scan(df).collect()}
    assert got[1] == " wrote from <email> about the plan"
    assert got[2] == " again: <email>, phone <phone>"
    assert got[4] == ""


def test_op13_texts_are_not_stored(spark, documents, monkeypatch):
    stored = []
    kept = pii_disclosure.checkpointed
    monkeypatch.setattr(pii_disclosure, "checkpointed", lambda df: stored.extend(df.columns) or kept(df))
    docs = [(1, PRIVATE[2]), (2, PRIVATE[3]), *[(3, PRIVATE[4])] * 3, *[(None, PRIVATE[2])] * 2, (None, None), (None, "")]
    found = pii_disclosure.scan(documents(docs).repartition(3))
    got = [(r["doc_id"], pii_disclosure.KINDS[s["rank"]], s["start"], s["end"]) for r in found.collect() for s in r["spans"]]
    want = [(r[0], *(int(k) if k.isdigit() else k for k in s.split(":"))) for r in plain_pii(docs) for s in r[6].split(",") if s]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert found.count() == len(docs)
    assert stored == ["term"]


def test_op13_empty_table(spark, documents, folder):
    assert QUERIES["op13_pii"](spark, folder(documents([]).limit(0))).count() == 0


# ---- op11: cross-tokenizer alignment -------------------------------------------------------------------------------------------


def plain_alignment(docs):
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    signs = byte_signs()
    spelled = {v: k for k, v in a.get_vocab().items()}

    def bytes_a(i):
        return bytes(signs[ch] for ch in spelled[i])

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    per_doc, counts = [], collections.Counter()
    for key, text in docs:
        if not text:
            per_doc.append((key, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(bytes_a, ids_a)) != want or b"".join(map(bytes_b, ids_b)) != want:
            per_doc.append((key, None))
            continue
        ranges = []
        for ids, spell in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, r = 0, []
            for i in ids:
                r.append((at, at + len(spell(i)), i))
                at += len(spell(i))
            ranges.append(r)
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups, last = [], 0
        for end in common:
            groups.append(([x[2] for x in ranges[0] if last < x[1] <= end], [y[2] for y in ranges[1] if last < y[1] <= end]))
            last = end
        counts.update(links)
        text_of = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        per_doc.append((key, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest())))
    top = collections.defaultdict(int)
    for (x, y), c in counts.items():
        top[y] = max(top[y], c)
    out = []
    for key, found in per_doc:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = found
        best = sum(counts[link] == top[link[1]] for link in links)
        out.append((key, n_a, n_b, n_groups, len(links), best, sum(counts[link] for link in links), digest))
    return out


def test_op11_query_matches_plain(spark, documents, folder, sample_texts, rows):
    texts = [*sample_texts, "hello  world\n\nagain", "ünïcödé ﬁ text", "<|endoftext|> <s> </s> plain", "the the the cat cat"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "hello world"), (2, texts[2]), (50, "hello world")]
    got = rows(QUERIES["op11_token_alignment"](spark, folder(documents(docs, extra=True))))
    want = sorted(plain_alignment(docs), key=lambda t: [(v is None, str(v)) for v in t])
    assert got == want
    assert sum(r[1] > 0 for r in want) > len(docs) // 2


def test_op11_hot_pairs_split_alike(spark, documents, rows):
    docs = [(k, "the cat sat on the mat " * (1 + k % 3)) for k in range(60)] + [(99, "rare words only here")]
    df = documents(docs)
    one = rows(token_alignment.alignment(df, PATH_A, PATH_B, hot_parts=1))
    many = rows(token_alignment.alignment(df, PATH_A, PATH_B, hot_parts=100000))
    assert one == many == sorted(plain_alignment(docs), key=lambda t: [(v is None, str(v)) for v in t])


def test_op11_empty_table(spark, documents, folder):
    assert QUERIES["op11_token_alignment"](spark, folder(documents([]).limit(0))).count() == 0


def test_op11_texts_laid_end_to_end_align_as_alone(sample_texts):
    a, b, bytes_a, bytes_b = token_alignment.sides(PATH_A, PATH_B)
    length_a, length_b = (np.array([len(x) for x in side]) for side in (bytes_a, bytes_b))
    texts = [t for t in sample_texts if t]
    ids = [(np.array(a.encode_ordinary(" " + t)), np.array(b.encode(t))) for t in texts]
    stops = [np.cumsum([0, *(len(pair[side]) for pair in ids)]) for side in (0, 1)]
    whole = [np.concatenate([pair[side] for pair in ids]) for side in (0, 1)]
    cut_a, cut_b, link_a, link_b = token_alignment.align(*whole, length_a, length_b, *stops)
    want_cuts, want_links = [], []
    for k, (ids_a, ids_b) in enumerate(ids):
        ends_a, ends_b = np.cumsum(length_a[ids_a]).tolist(), np.cumsum(length_b[ids_b]).tolist()
        common = sorted({*ends_a} & {*ends_b})
        want_cuts += [(stops[0][k] + ends_a.index(e) + 1, stops[1][k] + ends_b.index(e) + 1) for e in common]
        for i, end_a in enumerate(ends_a):
            for j, end_b in enumerate(ends_b):
                if end_a - length_a[ids_a[i]] < end_b and end_b - length_b[ids_b[j]] < end_a:
                    want_links.append((stops[0][k] + i, stops[1][k] + j))
    assert list(zip(cut_a, cut_b)) == want_cuts
    assert sorted(zip(link_a, link_b)) == want_links


def test_op11_slices_change_nothing(sample_texts):
    a, b, bytes_a, bytes_b = token_alignment.sides(PATH_A, PATH_B)
    sides = (a, b, bytes_a, bytes_b, np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b]))
    keys = list(range(len(sample_texts)))

    def plain(rows):
        return [[*map(str, r[:7]), *(r[7][n].tolist() for n in "abm")] for r in rows]

    together = token_alignment._aligned_rows(keys, keys, sample_texts, sides)
    alone = [r for k in keys for r in token_alignment._aligned_rows([k], [k], [sample_texts[k]], sides)]
    assert plain(together) == plain(alone)
