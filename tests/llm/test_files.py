"""Chat trees and WARC archives: round trips, and what a damaged archive gives back."""

from __future__ import annotations

import collections
import hashlib
import io

import duckdb

from shelfspan.llm import chat_trie, warc
from shelfspan.llm.common import checkpointed
from shelfspan.llm.oracle import ORACLE
from shelfspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    answer = db.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(answer.columns)
    assert collections.Counter(tuple(r) for r in got.select(*answer.columns).collect()) == collections.Counter(answer.fetchall())


def test_chat_equals_sql(spark):
    same_as_sql(spark, "op4_chat_formatting")


def test_lines_equal_sql(spark):
    same_as_sql(spark, "op8_line_dedup")


def test_chat_trees(spark):
    hello = [(0, "user", "hello"), (1, "assistant", "hi <turn x> \\l \\\\ </turn>")]
    told = {
        1: hello, 2: [*hello, (2, "user", "more")], 3: [*hello, (2, "user", "more")], 4: [*hello, (2, "user", None)],
        5: [(0, None, None)], 6: [(None, "a>b<", "t"), (0, "user", "x"), (0, "user", "x")], None: [(0, "assistant", "no id")],
    }
    rows = [(c, *t, "x") for c, turns in told.items() for t in turns]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    nodes, convs = chat_trie.packed(table)
    laid = nodes.collect()
    for tree, some in _by(laid, "tree").items():
        some.sort(key=lambda n: n["start"])
        assert [n["start"] for n in some] == [0, *(n["end"] for n in some[:-1])]  # once each, no holes
        text = "".join(n["formatted"] for n in some)
        for n in some:
            above = n["attention"][:-1]
            assert n["position"] == sum(a["end"] - a["start"] for a in above) and n["attention"][-1]["end"] == n["end"]
            assert text[n["start"] : n["end"]] == n["formatted"]
            if above:  # depth first: right below the parent, or after a sibling's subtree
                assert above[-1]["end"] <= n["start"]
    assert len(laid) == 2 + 2 + 1 + 3 + 1
    back = {r["conv_id"]: r for r in chat_trie.read_back(nodes, convs).collect()}
    for c, turns in told.items():
        want = [(role or "", text or "") for _, role, text in turns]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["learnt"] == "".join(t for r, t in want if r == "assistant")
    assert chat_trie.read_back(*chat_trie.packed(table.where("conv_id = 99"))).count() == 0


def test_chat_chain_needs_one_interval(spark):
    rows = [(c, k, "user" if k % 2 else "assistant", f"{k} " + "x" * (k * 37 % 1500)) for c in (1, 2) for k in range(300)]
    rows += [(2, 300, "user", "last"), (3, 0, *rows[0][2:]), (3, 1, "user", "other")]
    nodes, convs = chat_trie.packed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 302
    spans = {r["conv_id"]: r["attention"] for r in convs.collect()}
    assert all(len(a) <= 3 for a in spans.values()) and nodes.where("size(attention) > 3").isEmpty()
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_trie.read_back(nodes, convs).collect()}
    assert back == {c: [r[2:] for r in rows if r[0] == c] for c in (1, 2, 3)}


def _by(rows, name):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def archived(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string")
    folder = f"file://{tmp_path}/warc"
    files = checkpointed(warc.write(pages, folder, **options))
    return files, warc.read(files, folder).collect()


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same", "x"), (2, "u\n2", "same", "x"), (2, "u2", "same", "x"), (5, None, None, "x"), (6, "u", "", "x"), (None, "n", "same", "x"), (7, "v", "é" * 9000, "x")]
    _, got = archived(spark, rows, tmp_path)
    said = collections.Counter((r["id"], r["type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)

    def sha(t):
        return warc.digest_of((t or "").encode())

    assert said == collections.Counter(
        [("3", "revisit", "2", 4, sha("same")), ("2", "response", None, 4, sha("same")), ("2", "response", None, 4, sha("same")),
         (None, "revisit", "2", 4, sha("same")), ("5", "response", None, 0, sha("")), ("6", "revisit", "5", 0, sha("")),
         ("7", "response", None, 18000, sha("é" * 9000))]
    )
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {b"same", b"", ("é" * 9000).encode()}
    assert archived(spark, [(1, "a", "b", "x")][:0], tmp_path / "none")[1] == []
    kept = archived(spark, rows, tmp_path / "least", least_bytes=5)[1]
    assert {r["type"] for r in kept} == {"response"}


def test_warc_of_whole_table(spark):
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for k in sorted(html):
        first.setdefault(html[k], k)
    got = QUERIES["op5_warc"](spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        body = html[r["page_id"]]
        one = first[body] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.digest_of(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if one else ("revisit", first[body]))


def test_salvage():
    records = [warc.record(k, f"u{k}", hashlib.sha512(bytes([k])).digest() * 40, warc.digest_of(hashlib.sha512(bytes([k])).digest() * 40), None, False) for k in range(5)]
    for pack in (warc.member, lambda r: r):
        packed = [pack(r) for r in records]
        whole = b"".join(packed)
        ends = [sum(map(len, packed[: k + 1])) for k in range(5)]
        assert [e[0] for e in warc.salvaged(io.BytesIO(whole))] == ["record"] * 5
        broken = bytearray(whole)
        broken[ends[0] + len(packed[1]) - 60] ^= 255  # in the second record
        damaged = bytes(broken[: ends[2]]) + b"junk\x1f\x8b\x08junk WARC/1. junk" + bytes(broken[ends[2] : -30])
        events = list(warc.salvaged(io.BytesIO(damaged)))
        assert sum(e[2] for e in events) == len(damaged)
        at = 0
        for _, offset, length, _ in events:
            assert offset == at
            at += length
        found = [e[3].fields["warc-target-uri"] for e in events if e[0] == "record"]
        assert found == ["u0", "u2", "u3"]
        assert [e[0] for e in events] == ["record", "gap", "record", "gap", "record", "gap"]
    assert list(warc.salvaged(io.BytesIO(b""))) == []
    assert [e[:3] for e in warc.salvaged(io.BytesIO(b"nothing here"))] == [("gap", 0, 12)]
