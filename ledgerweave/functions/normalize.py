"""Column functions that bring raw fields to their canonical form; a value that cannot be read becomes null."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Other names of fields, for every import and for the investigator's.
ALIASES = {
    "time": "timestamp",
    "time_stamp": "timestamp",
    "datetime": "timestamp",
    "tx_id": "txid",
    "transaction_id": "txid",
    "source_ip": "src_ip",
    "sourceip": "src_ip",
    "destination_ip": "dst_ip",
    "destinationip": "dst_ip",
    "source_port": "src_port",
    "sourceport": "src_port",
    "destination_port": "dst_port",
    "destinationport": "dst_port",
    "fee_btc": "fee",
    "input_amount_btc": "input_amount",
    "output_amount_btc": "output_amount",
}
INVESTIGATOR_ALIASES = {
    "input_addresses": "input_wallets",
    "input_address": "input_wallets",
    "input_wallet": "input_wallets",
    "output_addresses": "output_wallets",
    "output_address": "output_wallets",
    "output_wallet": "output_wallets",
    "networktype": "network_type",
    "network_type_name": "network_type",
    "provider_name": "provider",
    "confidence_score": "confidence",
    "validfrom": "valid_from",
    "validto": "valid_to",
    "country": "geo_country",
}
# Network types, and other names of them in a feed and in a lookup.
TYPES = ["VPN", "PROXY", "TOR_EXIT", "TOR_RELAY", "HOSTING", "DATACENTER", "RESIDENTIAL", "MOBILE", "EDUCATIONAL", "GOVERNMENT", "UNKNOWN"]
FEED_TYPES = {"TOR": "TOR_EXIT", "TOR EXIT": "TOR_EXIT", "TOR RELAY": "TOR_RELAY", "EXIT NODE": "TOR_EXIT", "TOR EXIT NODE": "TOR_EXIT", "DATA CENTER": "DATACENTER", "DATA-CENTER": "DATACENTER"}
LOOKUP_TYPES = {"TOR": "TOR_EXIT", "TOR EXIT": "TOR_EXIT", "TOR RELAY": "TOR_RELAY", "EXIT": "TOR_EXIT", "DATA CENTER": "DATACENTER"}


def canonical_name(name: str, investigator: bool = True) -> str:
    """Trimmed lower case and the canonical name of an alias; for an investigator's file, blanks and dashes are underscores and more aliases hold."""
    name = name.lstrip("\ufeff").strip().lower()
    if not investigator:
        return ALIASES.get(name, name)
    name = name.replace("-", "_").replace(" ", "_")
    return (ALIASES | INVESTIGATOR_ALIASES).get(name, name)


def rename_fields(df: DataFrame, investigator: bool = True) -> DataFrame:
    return df.toDF(*(canonical_name(c, investigator) for c in df.columns))


def wallet_list(c: Column, commas: bool = False) -> Column:
    """A JSON array of strings, or text split at the first of the separators that it has; blanks go, null gives an empty list."""
    text = F.trim(c)
    parsed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    split = F.when(text.contains("|"), F.split(text, r"\|")).when(text.contains(";"), F.split(text, ";"))
    if commas:
        split = split.when(text.contains(","), F.split(text, ","))
    every = F.coalesce(parsed, split, F.array(text))
    return F.filter(F.transform(every, lambda w: F.trim(w)), lambda w: w.isNotNull() & (F.length(w) > 0))


def number(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def port(c: Column, integral: bool = False) -> Column:
    """0 .. 65535 as an int; with ``integral`` a fraction is refused, otherwise cut off."""
    d = number(c)
    whole = F.floor(d)
    ok = whole.between(0, 65535)
    return F.when(ok & (d == whole) if integral else ok, whole.cast("int"))


def txid_plain(c: Column) -> Column:
    """Trimmed; a whole number's ``.0`` goes; null gives an empty string."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text), F.lit(""))


def txid_numeric(c: Column, null_policy: str | None = "") -> Column:
    """Integral numbers in any notation become integer text, all other text stays; null, blank and ``nan`` give ``null_policy``."""
    text = F.trim(c.cast("string"))
    d = text.try_cast("double")
    whole = F.when((d == F.floor(d)) & (F.abs(d) < 1e15) & text.rlike(_NUMBER), F.floor(d).cast("string"))
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(null_policy)).otherwise(F.coalesce(whole, text))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def txid_rounded(c: Column) -> Column:
    """As :func:`txid_numeric`, but other numbers are written with 15 significant digits, and infinite ones are blank."""
    text = F.trim(c.cast("string"))
    d = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    written = F.format_string("%.14e", d)
    power = F.regexp_extract(written, r"e([+-]\d+)$", 1).try_cast("int")
    # Without trailing zeros: fixed notation where the power of ten is -4 .. 14, scientific elsewhere
    plain = F.regexp_replace(F.regexp_replace(written.try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    fixed = F.when(d.isNotNull(), F.when(power.between(-4, 14), plain).otherwise(F.regexp_replace(written, r"\.?0*e", "e")))
    infinite = F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$")
    whole = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string"))
    return F.when(text.isNull() | (text == "") | infinite, "").otherwise(F.coalesce(whole, fixed, text))


def address(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.isNull() | (F.lower(text) == "nan"), "").otherwise(text)


def country(c: Column) -> Column:
    return F.upper(F.trim(c))


def country_code(c: Column) -> Column:
    """Two letters, or null."""
    text = country(c)
    return F.when(text.rlike("^[A-Z]{2}$"), text)


def asn(c: Column) -> Column:
    """A non-negative number with or without ``AS`` before it."""
    return F.when(F.upper(F.trim(c.cast("string"))).rlike(r"^(AS)?\d+$"), F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("long"))


def asn_name(c: Column) -> Column:
    """``AS`` and digits, or null."""
    digits = F.regexp_extract(F.upper(F.trim(c.cast("string"))), r"^(?:AS)?(\d+)$", 1)
    return F.when(F.length(digits) > 0, F.concat(F.lit("AS"), digits))


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def confidence(c: Column) -> Column:
    """Blank is 0; outside [0, 1] or not a number is null, to be rejected."""
    text = F.trim(c.cast("string"))
    d = number(F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "0").otherwise(text))
    return F.when(d.between(0, 1), d)


def network_type(c: Column, feed: bool = True) -> Column:
    """One of the known types, by alias if need be; blank is UNKNOWN, and null stands for anything else."""
    name = F.upper(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in ({t: t for t in TYPES} | (FEED_TYPES if feed else LOOKUP_TYPES)).items() for x in pair))
    return F.when(name.isNull() | (name == ""), "UNKNOWN").otherwise(F.try_element_at(known, name))


def wallets_valid(c: Column) -> Column:
    """Whether a list has no null and no blank element; an empty list has none."""
    return c.isNotNull() & F.coalesce(F.forall(c, lambda w: F.coalesce(F.length(F.trim(w)) > 0, F.lit(False))), F.lit(False))


def ipv4(c: Column) -> Column:
    """Canonical dotted form, or null, without leaving the JVM."""
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    text = F.trim(c)
    return F.when(text.rlike(rf"^{byte}(\.{byte}){{3}}$"), text)


@F.pandas_udf(StringType())
def _ipv6(texts: pd.Series) -> pd.Series:
    def canonical(t: str | None) -> str | None:
        try:
            return str(ipaddress.ip_address(t)) if t else None
        except ValueError:
            return None

    return texts.map(canonical)


def ip(c: Column) -> Column:
    """Canonical IPv4 or IPv6 text, or null; only texts with a colon go through Python, for the compressed form."""
    text = F.trim(c)
    return F.coalesce(ipv4(text), F.when(text.contains(":"), _ipv6(F.when(text.contains(":"), text))))
