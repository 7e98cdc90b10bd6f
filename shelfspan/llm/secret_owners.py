"""Secret scans: spans of candidate secrets, judged by how many repositories and owners hold the same value.

Method. Every candidate's value is hashed (SHA-256); over the whole corpus the distinct repositories and owners of each hash are
counted. Values of at least `copied_owners` owners are widely copied examples; values of one owner that look random (letters and
digits, at least `distinct_signs` different characters) are live-looking; the rest is unclear. Beside the base kinds (assign, access,
hex) the scan looks at long tokens of letters and digits; of these only the live-looking ones become spans, of kind `owned`, unless
they overlap a base span.

Defined cases: a null text is empty; null owners or repositories count as one owner or repository each; repeated rows are scanned
alike and add nothing to the counts of distinct holders; other columns are never looked at. Only DataFrame functions. Hot values
shrink in partial sums before they are shuffled: first distinct (value, owner, repository), then counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpointed, let, matches, no_nulls

# Fixed by the contract, except the last, which the method adds. kind: (pattern, group that is the secret).
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]{24,}+", 0),
    "owned": (r"(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}", 0),
}
BASE = ("assign", "access", "hex")


def candidates(text: Column) -> Column:
    """Array of struct(start, rank, end, kind, value), by start, then kind as listed."""

    def of_kind(rank: int, kind: str) -> Column:
        pattern, group = KINDS[kind]
        found = matches(text, pattern, (0, group))
        if kind == "assign":
            found = F.filter(found, lambda m: F.length(m["g1"]) >= 6)
        if kind == "access":
            found = F.filter(found, lambda m: m["end"] - m["start"] >= 20)
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(rank).alias("rank"),
                m["end"].alias("end"),
                F.lit(kind).alias("kind"),
                m["g1"].alias("value"),
            ),
        )

    base = F.flatten(F.array(*(of_kind(rank, kind) for rank, kind in enumerate(BASE))))

    def joined(base_spans: Column) -> Column:
        apart = F.filter(
            of_kind(len(BASE), "owned"),
            lambda o: ~F.exists(base_spans, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])),
        )
        return F.sort_array(F.concat(base_spans, apart))

    return let(base, joined)


def looks_random(value: Column, distinct_signs: int) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= distinct_signs
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    repository: str = "doc_id",
    owner: str = "source",
    copied_owners: int = 3,
    distinct_signs: int = 10,
) -> DataFrame:
    """One row per row of docs: key, base (array of spans), spans (array), n_copied, n_live, n_unclear.

    Spans are struct(start, rank, end, kind, verdict).
    """
    found = checkpointed(
        docs.select(
            F.col(key).alias("key"),
            F.struct(F.col(repository)).alias("repository"),
            F.struct(F.col(owner)).alias("owner"),
            F.transform(
                candidates(no_nulls(F.col("text"))),
                lambda c: F.struct(
                    c["start"], c["rank"], c["end"], c["kind"], F.sha2(c["value"], 256).alias("hash"),
                    looks_random(c["value"], distinct_signs).alias("random"),
                ),
            ).alias("found"),
        )
    )
    each = found.where(F.size("found") > 0).withColumn("c", F.explode("found"))
    holders = (
        each.select(F.col("c.hash").alias("hash"), "owner", "repository")
        .distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("holdings"))
    )
    # The same candidates of the same text have one verdict, so rows of texts are told apart by what was found in them.
    distinct = found.where(F.size("found") > 0).select("found").distinct().withColumn("id", F.sha2(F.to_json("found"), 256))
    verdict = (
        F.when(F.col("owners") >= copied_owners, "copied").when((F.col("owners") == 1) & F.col("c.random"), "live").otherwise("unclear")
    )
    judged = (
        distinct.withColumn("c", F.explode("found"))
        .select("id", "c", F.col("c.hash").alias("hash"))
        .join(holders, "hash")
        .withColumn("verdict", verdict)
        .where((F.col("c.kind") != "owned") | (F.col("verdict") == "live"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("c.start", "c.rank", "c.end", "c.kind", "verdict"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,verdict:string>>")
    rows = found.select(
        "key", F.when(F.size("found") > 0, F.sha2(F.to_json("found"), 256)).alias("row_id")
    )
    spans = F.coalesce("spans", none)

    def n(verdict: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long").alias(f"n_{verdict}")

    return rows.join(judged, F.col("row_id") == F.col("id"), "left").select(
        F.col("key").alias(key),
        F.filter(spans, lambda s: s["kind"] != "owned").alias("base"),
        spans.alias("spans"),
        n("copied"), n("live"), n("unclear"),
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
