"""Token counts and SentencePiece against their libraries."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspan.llm import sentencepiece_table, token_counts
from shelfspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a" * 700, "▁▁ ▁a", "a ▁", "x<|endoftext|>y<|endoftext|>", "=" * 3000, " " * 300, "<0x41> <unk> </s>", "é漢 ▁x\n\n \t z ", "a\x00b"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_counts_equal_the_library(spark, documents, sample_texts):
    library = Tokenizer.from_file(BPE)
    known = texts(spark)
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    for r in got:
        text = known[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert len(got) == len(known)
    odd = sample_texts + MORE
    rows = [*enumerate(odd), (None, "again"), (0, None)]
    got = token_counts.count_tokens(documents(rows, extra=True), BPE, limit=10).collect()
    want = [(k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(k), n) for k, n in want)
    assert token_counts.count_tokens(documents([]), BPE, 5).count() == 0


def test_forgetting_changes_nothing(monkeypatch, sample_texts):
    want = token_counts.Counter(BPE).counts(sample_texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "AT_ONCE", 10)
    assert token_counts.Counter(BPE).counts(sample_texts) == want


def test_pieces_equal_the_library(spark, documents, sample_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = texts(spark)
    for r in QUERIES["op3_sentencepiece"](spark, SF).collect():
        ids = library.encode(known[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids))
    rows = [*enumerate(sample_texts + MORE), (None, "again"), (0, None)]
    got = sentencepiece_table.encoded(documents(rows, extra=True), PIECES).collect()
    want = [(k, library.encode(t or "")) for k, t in rows]
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(k), i, library.decode(i)) for k, i in want)
    assert sentencepiece_table.digests(documents([]), PIECES).count() == 0


def test_forgetting_runs_changes_nothing(monkeypatch, sample_texts):
    want = list(sentencepiece_table.PrefixTable(PIECES).rows(sample_texts + MORE))
    for name in ("REMEMBERED_RUNS", "REMEMBERED_PAIRS", "AT_ONCE"):
        monkeypatch.setattr(sentencepiece_table, name, 2)
    table = sentencepiece_table.PrefixTable(PIECES)
    assert list(table.rows(sample_texts + MORE)) == want
    assert table.decode([1, 260, 0, 230, 175, 169, 3, 200, 2]) == sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(
        [1, 260, 0, 230, 175, 169, 3, 200, 2]
    )


def test_runs_remembered_take_little_room():
    table = sentencepiece_table.PrefixTable(PIECES)
    words = [f"{k:06x}" for k in range(400_000)]
    texts = [" ".join(["the", *words[k : k + 1000]]) for k in range(0, len(words), 1000)]
    tracemalloc.start()
    n = sum(1 for _ in table.rows(texts))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert n == len(texts)
    assert held < 100e6


def test_frequent_runs_stay_remembered(monkeypatch):
    monkeypatch.setattr(sentencepiece_table, "REMEMBERED_RUNS", 40)
    monkeypatch.setattr(sentencepiece_table, "AT_ONCE", 10)
    table, learnt = sentencepiece_table.PrefixTable(PIECES), []
    learn = table.learn
    monkeypatch.setattr(table, "learn", lambda new: learnt.extend(new) or learn(new))
    texts = [f"the word{k} mark" for k in range(500)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [ids for _, ids, _ in table.rows(texts)] == [",".join(map(str, library.encode(t))) for t in texts]
    assert (learnt.count("the"), learnt.count("mark")) == (1, 1)


def test_text_is_decoded_from_the_ids(monkeypatch):
    monkeypatch.setattr(sentencepiece_table, "REMEMBERED_RUNS", 4)
    monkeypatch.setattr(sentencepiece_table, "AT_ONCE", 10)
    table = sentencepiece_table.PrefixTable(PIECES)
    table.piece[table.id["▁the"]] = "▁other"
    texts = ["the cat", "a the b", "the", *(f"more {k}" for k in range(9)), "at the end", " the  the"]
    assert [t for _, _, t in table.rows(texts)] == [t.replace("the", "other") for t in texts]


def odd_runs():
    rng = random.Random(7)
    signs = "aeinorst" * 4 + "AZ09.,-=_\n\té漢🎉\ue000\ue001▁\x00" + "".join(rng.sample([*map(chr, range(0x20, 0x3000))], 200))
    runs = {"".join(rng.choices(signs, k=rng.choice([1, 2, 3, 5, 8, 13, 30, 64, 65, 300]))).replace(" ", "") for _ in range(3000)}
    return sorted(runs | {"", "a", "the", "a" * 64, "a" * 65, "▁", "▁▁the", "=" * 64, "\ue000" * 3})


def test_runs_side_by_side_equal_the_library(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    runs = odd_runs()
    texts = [*runs, "\n".join(runs), " ".join(runs)]
    for slots in (20, 3):  # few slots: pairs give way all the time
        monkeypatch.setattr(sentencepiece_table, "PAIR_SLOTS", slots)
        table = sentencepiece_table.PrefixTable(PIECES)
        got = list(table.rows(texts))
        assert [[int(k) for k in ids.split(",") if k] for _, ids, _ in got] == [library.encode(t) for t in texts]
        assert [t for _, _, t in got] == [library.decode(library.encode(t)) for t in texts]
        alone = table._tokens_one_by_one(runs)
        assert table.tokens(runs) == alone
        short = [(run, tokens) for run, tokens in zip(runs, alone) if len(run) <= sentencepiece_table.USUAL]
        assert table._tokens_side_by_side([run for run, _ in short]) == [tokens for _, tokens in short]


def test_usual_runs_are_not_taken_one_by_one(monkeypatch):
    table = sentencepiece_table.PrefixTable(PIECES)
    monkeypatch.setattr(table, "automaton", None)
    texts = [" ".join(f"word{k}x{j}" for j in range(20)) for k in range(50)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [ids for _, ids, _ in table.rows(texts)] == [",".join(map(str, library.encode(t))) for t in texts]


def test_encoded_hands_on_slices(monkeypatch, spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(k, t) for k, t in enumerate(["x y " * 200_000, None, "", "one two", *(f"text {k}" for k in range(300)), "漢 " * 90_000])]
    got = sentencepiece_table.encoded(documents(rows).coalesce(1), PIECES).collect()
    want = [(k, library.encode(t or ""), t or "") for k, t in rows]
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got) == want
