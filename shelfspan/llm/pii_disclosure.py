"""PII: spans of personal data, and the words that give them away across the corpus.

Method (information-theoretic sanitisation). The base kinds (email, ip, card, phone) are entities; an entity is its kind and its
normalised value (emails in lower case, the digits of the others). A term is a run of letters, in lower case. For every occurrence
of an entity, the last `window` terms in the `reach` code points before it and the first `window` terms in the `reach` after it are
its context. Over the whole corpus, c(t, e) counts the rows in which term t stands in the context of entity e, n(t) the rows that
hold t anywhere. P(e | t) = c / n estimates how strongly t reveals e; a term that leaves at most `bits` bits of uncertainty about
an entity (-log2 P(e | t) <= bits) and was seen with it in at least `support` rows discloses it. Every occurrence of a disclosing
term in every row, outside base spans, becomes a span of kind `linked`; the sanitised text replaces base spans by their kind in
angle brackets (generalised) and removes linked terms.

Defined cases: a null text is empty and has no spans; a null key is carried; repeated rows are scanned alike and each counts as a
row in c and n; docs is read several times and must hold the same rows each time, in any order; a term cut by the edge of a context
reach is left out of that context; spans of different kinds may overlap (an ip can be an email's domain), the sanitised text then
hides their union; other columns are never looked at. Only DataFrame functions. Hot entities and terms shrink in partial sums before
they are shuffled. Texts are shuffled once and never stored: linked terms depend on the text alone, so a row meets its terms again by
its text's MD5 and its key's hash (the key deals copies of a text over the tasks; rows repeated with their key stay together, and
adaptive execution may split them). The set of disclosing terms is broadcast only when counted below `broadcast_terms`, else joined
by a shuffle that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpointed, let, matches, no_nulls

# Fixed by the contract: kind, pattern, in this order.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "linked")
TERM = r"\p{L}+"
NAME = ["key_hash", "text_hash"]  # what a row meets its terms by
SPAN = "array<struct<rank:int,start:int,end:int,kind:string,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(backwards, k + 1, 1).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return (n >= 16) & (n <= 19) & _luhn(_digits(value))
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _normal(kind: str, value: Column) -> Column:
    return F.lower(value) if kind == "email" else _digits(value)


def base_spans(text: Column) -> Column:
    """Array of struct(rank, start, end, kind, value): leftmost matches of each kind, failing ones dropped; by kind, then start."""

    def of_kind(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, BASE[kind]), lambda m: _valid(kind, m["g0"]))
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                F.concat(F.lit(kind + ":"), _normal(kind, m["g0"])).alias("value"),
            ),
        )

    return F.flatten(F.array(*(of_kind(rank, kind) for rank, kind in enumerate(BASE))))


def _context(text: Column, span: Column, window: int, reach: int) -> Column:
    """Terms near one span: the last `window` wholly inside the reach before it, the first `window` inside the reach after it."""
    start = span["start"]  # code points from 0
    begin = F.greatest(start - reach, F.lit(0))
    before = F.substring(text, begin + 1, start - begin)
    after = F.substring(text, span["end"] + 1, reach)
    cut_before = (begin > 0) & F.substring(text, begin, 1).rlike(TERM) & before.rlike("^" + TERM)
    cut_after = F.substring(text, span["end"] + reach + 1, 1).rlike(TERM) & after.rlike(TERM + r"\z")
    terms_before = F.regexp_extract_all(before, F.lit(TERM), 0)
    terms_after = F.regexp_extract_all(after, F.lit(TERM), 0)
    terms_before = F.when(cut_before, F.slice(terms_before, 2, 1 << 30)).otherwise(terms_before)
    terms_after = F.when(cut_after, F.slice(terms_after, 1, F.greatest(F.size(terms_after) - 1, F.lit(0)))).otherwise(terms_after)
    last = F.slice(terms_before, F.greatest(F.size(terms_before) - window + 1, F.lit(1)), window)
    return F.transform(F.concat(last, F.slice(terms_after, 1, window)), lambda t: F.lower(t))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by <kind> and linked terms removed; overlapping spans hide their union."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "linked", F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), out.otherwise(state["out"]).alias("out")
        )

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, 1 << 30))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 5,
    reach: int = 200,
    support: int = 2,
    bits: float = 1.0,
    broadcast_terms: int = 200_000,
) -> DataFrame:
    """One row per row of docs: key, base (spans), spans (base and linked, by kind as listed, then start), sanitised text.

    Spans are struct(rank, start, end, kind, value); code points from 0, end exclusive.
    """
    rows = docs.select(F.col(key).alias("key"), no_nulls(F.col(text)).alias("text"))
    seen = F.flatten(
        F.transform(
            base_spans(F.col("text")),
            lambda s: F.transform(_context(F.col("text"), s, window, reach), lambda t: F.struct(t.alias("term"), s["value"].alias("entity"))),
        )
    )
    contexts = (
        rows.select(F.explode(F.array_distinct(seen)).alias("c"))
        .groupBy("c.term", "c.entity")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= support)
    )
    held = (
        rows.select(F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    disclosing = (
        contexts.join(held, "term")
        .where(-F.log2(F.col("c") / F.col("n")) <= F.lit(bits))
        .select("term")
        .distinct()
    )
    disclosing = checkpointed(disclosing)
    if disclosing.count() <= broadcast_terms:
        disclosing = F.broadcast(disclosing)
    named = rows.select("*", F.xxhash64("key").alias("key_hash"), F.md5("text").alias("text_hash"))
    terms_of_row = (
        named.select(*NAME, F.explode(_terms(F.col("text"))).alias("term"))
        .join(disclosing, "term")
        .groupBy(*NAME)
        .agg(F.array_sort(F.collect_set("term")).alias("terms"))
    )
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    linked = F.when(F.col("terms").isNull(), F.array().cast(SPAN)).otherwise(
        F.transform(
            matches(F.col("text"), pattern),
            lambda m: F.struct(
                F.lit(len(BASE)).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit("linked").alias("kind"),
                F.lower(m["g0"]).alias("value"),
            ),
        )
    )

    def outside(found: Column) -> Column:
        return let(F.col("base"), lambda base: F.filter(found, lambda o: ~F.exists(base, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))))

    joined = named.withColumn("base", base_spans(F.col("text"))).join(terms_of_row, NAME, "left").withColumn("linked", outside(linked))
    spans = F.array_sort(F.concat("base", "linked"))
    return joined.select(
        F.col("key").alias(key), "base", spans.alias("spans"), _sanitised(F.col("text"), spans).alias("sanitised")
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
