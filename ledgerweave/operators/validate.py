"""Row validation with reasons, record identity, and quality gates as one aggregation each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import normalize as n

# Fields that each kind of record must have.
REQUIRED = {
    "COMBINED": ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid", "input_wallets", "output_wallets", "input_amount", "output_amount", "fee", "script_type", "geo_country", "asn"],
    "BLOCKCHAIN_TRANSACTION": ["txid", "timestamp", "input_wallets", "output_wallets", "input_amount", "output_amount", "fee"],
    "NETWORK_OBSERVATION": ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid"],
    "IP_INTELLIGENCE": ["ip", "network_type", "confidence"],
}
AMOUNTS, PORTS, IPS, TIMES, LISTS = ("input_amount", "output_amount", "fee"), ("src_port", "dst_port"), ("src_ip", "dst_ip", "ip"), ("timestamp", "valid_from", "valid_to"), ("input_wallets", "output_wallets")

_RULES: dict[str, Callable[[Column], Column]] = {
    **{f: lambda c: n.number(c) >= 0 for f in AMOUNTS},
    **{f: lambda c: n.port(c, integral=True).isNotNull() for f in PORTS},
    **{f: lambda c: n.ip(c).isNotNull() for f in IPS},
    **{f: lambda c: n.timestamp(c).isNotNull() for f in TIMES},
    "confidence": lambda c: n.confidence(c).isNotNull(),
    "network_type": lambda c: n.network_type(c).isNotNull(),
    # A JSON list must hold no null and no blank; other notations cannot
    **{f: lambda c: ~F.trim(c).startswith("[") | n.wallets_valid(F.from_json(c, "array<string>")) for f in LISTS},
}


def validated(records: DataFrame, kind: str) -> DataFrame:
    """``records`` (all fields text) with ``missing`` and ``invalid`` (arrays of field names) and ``valid``.

    A required field is missing when it is absent or blank; an optional one is
    checked only where it has a value.  An empty wallet list is valid.
    """
    required = REQUIRED[kind]
    blank = lambda f: F.coalesce(F.trim(F.col(f)) == "", F.lit(True))
    missing = [F.when(blank(f), F.lit(f)) if f in records.columns else F.lit(f) for f in required if f not in LISTS] + [F.lit(f) for f in LISTS if f in required and f not in records.columns]
    invalid = [F.when(~blank(f) & ~F.coalesce(rule(F.col(f)), F.lit(False)), F.lit(f)) for f, rule in _RULES.items() if f in records.columns]
    none = F.array().cast("array<string>")
    out = records.withColumn("missing", F.array_compact(F.array(*missing)) if missing else none).withColumn("invalid", F.array_compact(F.array(*invalid)) if invalid else none)
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("invalid") == 0))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the row's fields in name order, as JSON; nulls are kept apart from empty text."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def deduplicated(records: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """The first row of each fingerprint (by ``order``), with ``fingerprint`` and ``copies``; combined in the map tasks."""
    keyed = records.withColumn("fingerprint", fingerprint(columns))
    row = F.struct(*records.columns)
    first = F.min_by(row, order) if order is not None else F.first(row)
    return keyed.groupBy("fingerprint").agg(first.alias("r"), F.count("*").alias("copies")).select("r.*", "fingerprint", "copies")


def event_id(columns: list[str], length: int = 24) -> Column:
    """First hex digits of SHA-256 over the fields joined by ``|``; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256), 1, length)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that does not depend on row order: the count, and sum and xor of the first 52 bits of SHA-256 of each row (fields in name order, ``|`` between)."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)))
    h = F.conv(F.substring(F.sha2(row, 256), 1, 13), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def checks(df: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """check, failures: rows that break each condition (null counts as broken), in one pass; and repeated keys."""
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]
    if keys:
        counts.append((F.count("*") - F.countDistinct(*keys)).alias("unique_key"))
    one = df.agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("failures")) for c in one.columns))).alias("e")).select("e.*")


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """in_both, only_left, only_right over distinct keys, by one grouped union instead of three joins."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    side = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return side.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))


def column_audit(df: DataFrame) -> DataFrame:
    """column, nulls, distinct, infinite for every column, in one aggregation."""
    aggs = []
    for c, t in df.dtypes:
        bad = F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) if t in ("double", "float") else F.lit(0).cast("long")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__n"), F.countDistinct(F.col(c)).alias(f"{c}__d"), bad.alias(f"{c}__i")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("nulls"), F.col(f"{c}__d").alias("distinct"), F.col(f"{c}__i").alias("infinite")) for c in df.columns))).alias("e")).select("e.*")
