"""SimHash groups, benchmark passages and the pipeline against plain versions."""

from __future__ import annotations

import collections
import itertools
import random
import re

import brute
import corpus_pipeline
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from shelfspan.llm import decontaminate, quality_llr, simhash_trie, site_lines
from shelfspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = brute.BLANK_WORD.findall(brute.ascii_lower(text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, distance=2):
    values = sorted(set(values))
    low = {v: v for v in values}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                a_, b_ = find(a), find(b)
                low[max(a_, b_)] = min(a_, b_)
    return {v: find(v) for v in values}


def groups(rows):
    """(doc_id, fingerprint, component_id) of plain Python."""
    prints = [(k, fingerprint(t)) for k, t in rows]
    root = roots([p for _, p in prints])
    least = collections.defaultdict(list)
    for k, p in prints:
        if k is not None:
            least[root[p]].append(k)
    return collections.Counter((k, f"{p:016x}", min(least[root[p]], default=None)) for k, p in prints)


def test_simhash_of_whole_table(spark):
    known = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op6_simhash_dedup"](spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == groups(known)


def test_simhash_of_odd_texts(documents, sample_texts):
    rows = [*((k + 5, t) for k, t in enumerate(sample_texts)), (None, "only without id"), (None, sample_texts[5]), (2, sample_texts[-1]), (2, sample_texts[-1])]
    got = simhash_trie.near_duplicates(documents(rows, extra=True)).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == groups(rows)
    kept = simhash_trie.one_of_each(documents(rows, extra=True))
    assert kept.columns == documents(rows, extra=True).columns
    assert len(kept.collect()) == len({c for _, _, c in groups(rows)})
    assert simhash_trie.near_duplicates(documents([])).count() == 0 and simhash_trie.one_of_each(documents([])).count() == 0


def test_trie_join_expands_large_subtrees(spark):
    rng = random.Random(5)
    values, centre = {0, -1, 1, 3, 7}, rng.getrandbits(64)
    for _ in range(400):
        v = centre
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v - 2**64 if v >= 2**63 else v)
    values |= {rng.getrandbits(63) for _ in range(50)}
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    want = roots(values)
    for most in (10_000, 120):
        assert {r["fingerprint"]: r["root"] for r in simhash_trie.groups(prints, most=most).collect()} == want


def test_trie_join_keeps_links_through_many_expansions(spark):
    codes: list[int] = []  # at least three bits apart
    for code in range(1 << 9):
        if all((code ^ c).bit_count() > 2 for c in codes):
            codes.append(code)
    # Only bits of the middle third differ, and links in its first bits, so every order of the bits has to carry them on.
    values = [0x1234560000054321 | (head << 18 | code) << 21 for code in codes for head in (0b000, 0b100)]
    values += [-1, -2, -4, -8, -16]
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    want = roots(values)
    assert len(set(want.values())) < len(want)
    assert {r["fingerprint"]: r["root"] for r in simhash_trie.groups(prints, most=8).collect()} == want


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text):
    w = words(text)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def best_windows(docs, items, least=0.8):
    out = {}
    for k, text in docs:
        d = words(text)
        for i, item in items:
            b = words(item)
            width = min(5, len(b))
            if not b:
                continue
            want = collections.Counter(tuple(b[j : j + width]) for j in range(len(b) - width + 1))
            inside = [tuple(d[s : s + width]) in want for s in range(max(len(d) - width + 1, 0))]
            upto = [0, *itertools.accumulate(inside)]
            for s in range(len(d) - len(b) + 1):
                if upto[s + len(b) - width + 1] - upto[s] < least * sum(want.values()):
                    continue  # too few of the window's shingles are the item's
                have = collections.Counter(tuple(d[s + j : s + j + width]) for j in range(len(b) - width + 1))
                both = sum((have & want).values())
                value = both / (2 * sum(want.values()) - both)
                if value >= least and value > out.get((k, i), (0,))[0]:
                    out[k, i] = (value, s)
    return out


def test_passages_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = set().union(*(grams(t) for _, t in items))
    near = [(k, t) for k, t in docs if grams(t) & known]
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in QUERIES["op10_decontamination"](spark, SF).collect()}
    assert got == best_windows(near, items)


def test_passages_with_edits_ties_and_blocks(spark, documents, sample_texts):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(16, 60)))) for k in range(20)] + [(20, "three short words"), (21, None), (22, "")]
    rows = [(k, t) for k, t in enumerate(sample_texts)]
    for k, (_, item) in enumerate(items[:20]):
        w = item.split()
        if k % 2:
            w[len(w) // 2] = "changed"
        before, after = (" ".join(rng.choices(vocabulary, k=40)) for _ in range(2))
        rows.append((100 + k, f"{before}. {' '.join(w).upper()}, {after}"))
        rows.append((200 + k, f"{item} {item}"))
    rows.append((300, "before Three, SHORT words after"))
    want = best_windows(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    for search in (decontaminate.Search(), decontaminate.Search(block=7)):
        got = decontaminate.leaks(documents(rows, extra=True), table, search=search).collect()
        found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in got}
        assert found == want and len(got) == len(want)
        clean = decontaminate.clean(documents(rows, extra=True), table, search=search)
        assert clean.columns == documents(rows, extra=True).columns
        assert {r["doc_id"] for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in want}
    empty = table.where("item_id < 0")
    assert decontaminate.leaks(documents(rows), empty).count() == 0 and decontaminate.clean(documents(rows), empty).count() == len(rows)
    assert decontaminate.leaks(documents([]), table).count() == 0


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratio = quality_llr.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_llr.score(F.coalesce("text", F.lit("")), ratio).alias("s")).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if not brute.quality_counts(r[1])[5] and scores[r[0]] >= ratio.threshold]
    pages, held = collections.Counter(s for _, _, s in rows), collections.Counter()
    for _, text, source in rows:
        held.update({(source, line.strip(" \t\n\x0b\f\r")) for line in text.split("\n")})
    bad = {(s, line) for (s, line), n in held.items() if line and n >= site_lines.LEAST_PAGES and n > pages[s] * site_lines.RATIO}

    def cleaned(text, source):
        kept = [line for line in text.split("\n") if (source, line.strip(" \t\n\x0b\f\r")) not in bad]
        return "\n".join(kept) if any(line.strip(" \t\n\x0b\f\r") for line in kept) else text

    rows = [(k, cleaned(t, s)) for k, t, s in rows]
    first = {k for k, _, component in groups(rows) if k == component}
    rows = [r for r in rows if r[0] in first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = set().union(*(grams(t) for _, t in items))
    near = [(k, t) for k, t in rows if grams(t) & known]
    leaked = {k for k, _ in best_windows(near, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {k: (library.encode(t), library.decode(library.encode(t))) for k, t in rows if k not in leaked}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in got} == want and len(got) == len(want)
