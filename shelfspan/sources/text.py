"""Readers of delimited text: encodings, delimiters, parts, and the stock export."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan import fixed_values as fv
from shelfspan.functions.numeric import safe_long, whole_number
from shelfspan.functions.text import null_words_to_null, strip
from shelfspan.operators.conform import canonicalize, conform_part, normalize_columns
from shelfspan.operators.keys import conform_code_map
from shelfspan.schema import AREA_MAP, CODE_MAP, empty
from shelfspan.sources import quoted

DELIMITERS = (",", ";", "\t", "|")


def _place() -> Column:
    """Rows of a file in order: by the split they are in and their number inside the split.

    A split starts at least as many bytes after the one before as it has rows, so its start,
    taken 64 times, keeps the splits apart.
    """
    row = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    return F.col("_metadata.file_block_start") * F.lit(64) + row


def _file_name() -> Column:
    """Name of the file a row comes from, as it is spelled in the folder."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def survey(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Encoding and header, as hex, of each file by name.

    The encoding is the first of utf-8, cp1250 and latin-1 that all lines can be decoded
    with.  Lines are looked at as raw bytes where they are read, all files in one job.
    """
    # Bytes without a meaning in cp1250, told by asking the codec itself.
    gaps = [f"{b:02X}" for b in range(256) if not bytes([b]).decode("cp1250", "ignore")]
    raw = F.hex(F.col("value").cast("binary"))
    broken = ~F.is_valid_utf8("value")
    lines = spark.read.text(list(paths)).select(
        _file_name().alias("file"), "value", _place().alias("place")
    )
    found = lines.groupBy("file").agg(
        F.bool_or(broken).alias("broken"),
        F.bool_or(broken & raw.rlike(f"^(..)*({'|'.join(gaps)})")).alias("gap"),
        F.hex(F.min_by("value", "place").cast("binary")).alias("header"),
    )
    # One row per file.
    return {
        r.file: ("utf-8" if not r.broken else "latin-1" if r.gap else "cp1250", r.header)
        for r in found.collect()
    }


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Encoding of one file; an empty one is utf-8."""
    return next((encoding for encoding, _ in survey(spark, [path]).values()), "utf-8")


def _upper_half(encoding: str) -> tuple[str, str]:
    """The characters that differ between latin-1 and the encoding, in matching order."""
    pairs = [
        (bytes([b]).decode("latin-1"), bytes([b]).decode(encoding, "ignore"))
        for b in range(128, 256)
    ]
    changed = [(a, b) for a, b in pairs if b and a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str, encoding: str = "utf-8"
) -> DataFrame:
    """CSV with header, every column text, with each record's place in its file.

    Quoted values may hold line breaks, also where a file is read in many splits (see quoted.py).
    Words that mean a missing value become null.  Single-byte encodings are read as latin-1
    and mapped character by character.  Files read together share the first file's header.
    """
    return _fields(spark, csv_records(spark, path, encoding), sep)[0].drop("n_fields", "open")


def csv_records(spark: SparkSession, path: str | Sequence[str], encoding: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of the files (file, place, record, n_lines, open), those too long to gather, and the first record of each file.

    The first records (headers) are found in the first split of each file alone.
    """
    old, new = _upper_half(encoding) if encoding == "cp1250" else ("", "")
    value = F.col("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        _file_name().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        _place().alias("place"),
        (F.translate(value, old, new) if old else value).alias("value"),
    )
    records, overlong = quoted.quoted_records(lines)
    firsts, _ = quoted.quoted_records(lines.where(F.col("block") == 0))
    firsts = firsts.where(F.col("record") != "")
    top = firsts.groupBy("file").agg(F.min("place").alias("place"))
    return records, overlong, firsts.join(top, ["file", "place"]).select("file", "place", "record")


def _fields(spark: SparkSession, found: tuple[DataFrame, DataFrame, DataFrame], sep: str) -> tuple[DataFrame, int]:
    """Data records under the header's names, missing words null, with src_file and src_row; and the header's width."""
    records, _, headers = found
    heads = headers.collect()  # one row per file
    if not heads:
        return spark.createDataFrame([], "src_file string, src_row long, n_fields int, open boolean"), 0
    header = min(heads, key=lambda r: r.file).record.replace("\ufeff", "")
    names = quoted.header_names(header, sep)
    tops = spark.createDataFrame([(r.file, r.place) for r in heads], "file string, place long")
    body = records.where(F.col("record") != "").join(F.broadcast(tops), ["file", "place"], "left_anti")
    table = quoted.parsed(body, names, sep)
    values = [F.when(~F.col(f"`{n}`").isin(*fv.MISSING_WORDS), F.col(f"`{n}`")).alias(n) for n in names]
    return table.select(
        *values, F.col("file").alias("src_file"), F.col("place").alias("src_row"), "n_fields", "open"
    ), len(names)


def csv_rejects(spark: SparkSession, path: str | Sequence[str], sep: str, encoding: str = "utf-8") -> DataFrame:
    """Records that do not fit the header: surplus or missing fields, a quote open at the end, or too many lines to gather.

    src_file, src_row, n_fields, expected, reason; the data reader keeps the first of them (cut or filled with nulls).
    """
    found = csv_records(spark, path, encoding)
    table, width = _fields(spark, found, sep)
    overlong = found[1]
    if not width:
        return spark.createDataFrame([], "src_file string, src_row long, n_fields int, expected int, reason string")
    reason = (
        F.when(F.col("open"), "open quote")
        .when(F.col("n_fields") > width, "surplus fields")
        .when(F.col("n_fields") < width, "missing fields")
    )
    found = table.select("src_file", "src_row", F.col("n_fields").cast("int").alias("n_fields"), reason.alias("reason"))
    too_long = overlong.select(
        F.col("file").alias("src_file"), F.col("place").alias("src_row"), F.lit(None).cast("int").alias("n_fields"),
        F.lit("too many lines").alias("reason"),
    )
    return found.where("reason is not null").unionByName(too_long).select(
        "src_file", "src_row", "n_fields", F.lit(width).alias("expected"), "reason"
    )


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most in the first line; a comma when none does."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return max(DELIMITERS, key=line.count)


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """CSV with its delimiter taken from the first line and its encoding from the bytes."""
    return read_csv(spark, path, sniff_delimiter(spark, path), detect_encoding(spark, path))


def read_capacity_csv(spark: SparkSession, path: str) -> DataFrame:
    """Capacity rows of one semicolon-separated file holding all branches."""
    raw = read_csv(spark, path, ";", detect_encoding(spark, path))
    return canonicalize(conform_part(raw, ""), fv.CAPACITY_ALIASES)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Capacity rows of a folder in which every file is one branch, named after it.

    Parts may differ in columns, in how they spell them and in types; what a part lacks is null.
    Parts with the same header and types are read in one scan, so the plan grows with the number
    of distinct headers, not of files.  Aliases are resolved in each scan, and values are text
    until the capacity schema's own safe casts read them.
    """
    names = spark.read.format("binaryFile").load(path).select("path", F.lower("path").alias("low"))
    csv = [r.path for r in names.where("low like '%.csv'").orderBy("path").collect()]
    parquet = [r.path for r in names.where("low like '%.parquet'").orderBy("path").collect()]
    if not csv and not parquet:
        raise FileNotFoundError(f"no parts in {path}")
    groups = _csv_groups(spark, csv)
    scans = [read_csv(spark, parts, ";", encoding) for (encoding, _), parts in groups.items()]
    row = F.col("_metadata.row_index").alias("src_row")
    for alike in _by_schema(spark, parquet).values():
        scans.append(spark.read.parquet(*alike).select("*", _file_name().alias("src_file"), row))
    return union_parts([_part(s) for s in scans])


def _csv_names(spark: SparkSession, path: str) -> list[str]:
    names = spark.read.format("binaryFile").load(path).select("path", F.lower("path").alias("low"))
    return [r.path for r in names.where("low like '%.csv'").orderBy("path").collect()]


def _csv_groups(spark: SparkSession, csv: Sequence[str]) -> dict[tuple[str, str], list[str]]:
    """CSV parts by encoding and header, read together in one scan each; empty files have neither and are left out."""
    groups: dict[tuple[str, str], list[str]] = {}
    kinds = survey(spark, csv) if csv else {}
    for part in csv:
        kind = kinds.get(part.rsplit("/", 1)[-1])
        if kind is not None:
            groups.setdefault(kind, []).append(part)
    return groups


def capacity_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Records of the capacity file, or of its CSV parts, that do not fit their header (see csv_rejects)."""
    if path.lower().endswith(".csv"):
        return csv_rejects(spark, path, ";", detect_encoding(spark, path))
    found = [csv_rejects(spark, parts, ";", encoding) for (encoding, _), parts in _csv_groups(spark, _csv_names(spark, path)).items()]
    if not found:
        return spark.createDataFrame([], "src_file string, src_row long, n_fields int, expected int, reason string")
    return reduce(DataFrame.unionByName, found)


def rejected_fields(rejects: DataFrame) -> DataFrame:
    """One row of counts: records that do not fit, and of them surplus, missing, open quote and too long."""
    return rejects.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("reason") == "surplus fields").alias("surplus"),
        F.count_if(F.col("reason") == "missing fields").alias("missing"),
        F.count_if(F.col("reason") == "open quote").alias("open_quote"),
        F.count_if(F.col("reason") == "too many lines").alias("too_long"),
    )


def _by_schema(spark: SparkSession, parts: Sequence[str]) -> dict[str, list[str]]:
    """Parquet files by their columns and types; one footer is read per file."""
    groups: dict[str, list[str]] = {}
    for part in parts:
        groups.setdefault(spark.read.parquet(part).schema.json(), []).append(part)
    return groups


def _part(scan: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.col("src_file"), r"(?i)\.(csv|parquet)$", "")
    part = canonicalize(conform_part(scan, strip(name)), fv.CAPACITY_ALIASES)
    return part.select(*(F.col(f"`{c}`") if c == "src_row" else F.col(f"`{c}`").cast("string").alias(c) for c in part.columns))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts below each other by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_realloc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the reallocation CSV under the conformed names."""
    return canonicalize(normalize_columns(read_csv_auto(spark, path)), fv.REALLOC_CSV_ALIASES)


def read_area_map(spark: SparkSession, path: str | None) -> DataFrame:
    """Area map by branch number and, where given, by branch name."""
    if path is None:
        return empty(spark, AREA_MAP)
    df = canonicalize(normalize_columns(read_csv_auto(spark, path)), fv.AREA_MAP_ALIASES)
    if "area" not in df.columns:
        return empty(spark, AREA_MAP)
    none = F.lit(None).cast("string")
    number = F.col("branch_id") if "branch_id" in df.columns else none
    name = F.col("branch_name") if "branch_name" in df.columns else none
    return df.select(
        safe_long(number).alias("branch_id"),
        strip(name).alias("branch_name"),
        strip(F.col("area")).alias("area"),
        "src_file",
        "src_row",
    )


def read_code_map(spark: SparkSession, path: str | None) -> DataFrame:
    """Code map with matching keys, one row per branch and source code.

    A file without the required columns counts as no map.
    """
    if path is None:
        return empty(spark, CODE_MAP)
    df = canonicalize(normalize_columns(read_csv_auto(spark, path)), fv.CODE_MAP_ALIASES)
    if not {"branch_id", "source_code", "target_code"} <= set(df.columns):
        return empty(spark, CODE_MAP)
    return conform_code_map(df.withColumn("branch_id", safe_long(F.col("branch_id"))))


def is_data_line(line: Column) -> Column:
    """Whether a line of the stock export is a record, not banner, prompt or rule."""
    s, low = strip(line), F.lower(strip(line))
    noise = low.startswith("select ") | s.contains("===") | low.contains("constant")
    for word in fv.EXPORT_BANNERS:
        noise = noise | s.startswith(word)
    return s.rlike(r"^\d+\s*,") & ~noise


def parse_stock_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records of the stock export; lines that are none are left out.

    A count that is no number is zero, a branch that is none is null.
    """
    part = F.transform(F.split(F.col(line), ","), strip)
    found = lines.where(is_data_line(F.col(line))).withColumn("_part", part)

    def at(i: int) -> Column:
        return F.get("_part", F.lit(i))

    count = whole_number(F.replace(at(4), F.lit(" "), F.lit("")))
    records = found.where(F.size("_part") >= 6).select(
        whole_number(at(0)).alias("location_id"),
        whole_number(null_words_to_null(at(1))).alias("branch_id"),
        F.coalesce(null_words_to_null(at(2)), F.lit("")).alias("branch_name"),
        at(3).alias("code"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("stock_total"),
        at(5).alias("as_of"),
        *[c for c in ("src_file", "src_row") if c in lines.columns],
    )
    return records.where("location_id is not null")


def rejected_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that start like a record but do not have the fields of one."""
    parts = F.split(F.col(line), ",")
    short = (F.size(parts) < 6) | whole_number(strip(F.get(parts, F.lit(0)))).isNull()
    return lines.where(is_data_line(F.col(line)) & short)


def doubtful_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Counts of lines that become records but not as they stand, one row.

    A line of more than six fields has a comma inside a value, so that what follows is shifted;
    a branch or a count that is no number turns into null or zero.
    """
    part = F.transform(F.split(F.col(line), ","), strip)
    records = lines.where(is_data_line(F.col(line))).select(part.alias("_part"))
    records = records.where((F.size("_part") >= 6) & whole_number(F.col("_part")[0]).isNotNull())
    branch = null_words_to_null(F.col("_part")[1])
    count = F.replace(F.col("_part")[4], F.lit(" "), F.lit(""))
    return records.agg(
        F.count_if(F.size("_part") > 6).alias("shifted"),
        F.count_if(branch.isNotNull() & whole_number(branch).isNull()).alias("branch_unreadable"),
        F.count_if(whole_number(count).isNull()).alias("count_unreadable"),
    )


def read_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the export, bytes that are no UTF-8 replaced, with their place."""
    return spark.read.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        _file_name().alias("src_file"),
        _place().alias("src_row"),
    )


def parse_stock_export(spark: SparkSession, path: str) -> DataFrame:
    """Stock per location from the export of a SQL client; an export without any is an error."""
    records = parse_stock_lines(read_export_lines(spark, path))
    if records.isEmpty():
        raise ValueError(f"no stock records in {path}")
    return records
