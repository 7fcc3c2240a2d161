"""Element-wise ingestion: a bad element, row or file is a reject with its reason, never the end of the import.

JSON goes through the VARIANT type, so that elements of one array may differ in
shape and no schema is inferred from them; a file is one text, as the format asks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import normalize as n
from ledgerweave.operators import validate
from ledgerweave.sources import readers

# The columns of a network observation, and those that a file must have.
NETWORK_COLUMNS = ["network_event_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid", "geo_country", "asn", "protocol", "direction", "observation_source"]
NETWORK_REQUIRED = ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid", "geo_country", "asn"]


def json_elements(df: DataFrame, text: str, wrappers: tuple[str, ...] = readers.WRAPPERS) -> DataFrame:
    """The other columns of ``df``, with position, fault and fields (a map of texts) for each element of each row's JSON ``text``.

    An array gives its elements, an object the elements of the first of
    ``wrappers`` that is an array in it, or itself.  ``fault`` is null, or EMPTY (null or
    blank text), MALFORMED (no JSON), NO_RECORDS (a number, text, boolean or null) or
    NOT_AN_OBJECT (an element).  Scalars are given as text, arrays and objects as
    JSON; an empty array gives nothing.
    """
    others = [c for c in df.columns if c != text]
    v, kind = F.col("__v"), F.schema_of_variant("__v")
    rows = df.withColumn("__v", F.try_parse_json(text)).withColumn("__kind", F.when(v.isNotNull(), kind))
    wrapped = F.lit(None).cast("array<variant>")
    for w in reversed(wrappers):
        wrapped = F.coalesce(F.try_variant_get("__v", f"$['{w}']", "array<variant>"), wrapped)
    alone = F.array(F.col("__v"))
    listed = F.when(F.col("__kind").startswith("ARRAY"), F.try_variant_get("__v", "$", "array<variant>")).when(F.col("__kind").startswith("OBJECT"), F.coalesce(wrapped, alone)).otherwise(alone)
    fault = F.when(F.coalesce(F.trim(text) == "", F.lit(True)), "EMPTY").when(F.col("__kind").isNull(), "MALFORMED").when(~F.col("__kind").startswith("ARRAY") & ~F.col("__kind").startswith("OBJECT"), "NO_RECORDS")
    rows = rows.select(*others, fault.alias("__fault"), F.when(fault.isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(listed).alias("__list"))
    rows = rows.select(*others, "__fault", F.posexplode("__list").alias("position", "__e"))
    plain = F.schema_of_variant("__e").startswith("OBJECT")
    fields = F.when(F.col("__fault").isNull() & F.col("__e").isNotNull() & plain, F.try_variant_get("__e", "$", "map<string, variant>"))
    rows = rows.select(*others, "position", F.coalesce("__fault", F.when(F.col("__e").isNull() | ~plain, "NOT_AN_OBJECT")).alias("fault"), fields.alias("__fields"))
    as_text = lambda _, x: F.when(F.schema_of_variant(x).startswith("ARRAY") | F.schema_of_variant(x).startswith("OBJECT"), F.to_json(x)).otherwise(F.try_variant_get(x, "$", "string"))
    return rows.select(*others, "position", "fault", F.transform_values("__fields", as_text).alias("fields"))


def widened(elements: DataFrame, investigator: bool = True) -> DataFrame:
    """One text column for each field name that occurs, under its canonical name; of names that come to one, the first by name that has a value."""
    names = sorted(r[0] for r in elements.filter("fault is null").select(F.explode(F.map_keys("fields"))).distinct().collect())  # as many as there are names
    by: dict[str, list[str]] = {}
    for name in names:
        by.setdefault(n.canonical_name(name, investigator), []).append(name)
    return elements.filter("fault is null").select(*(F.coalesce(*(F.col("fields")[name] for name in raw)).alias(c) for c, raw in sorted(by.items())))


def named(records: DataFrame, investigator: bool = True) -> DataFrame:
    """Columns under their canonical names; of columns that come to one name, the first that has a value."""
    by: dict[str, list[int]] = {}
    for i, c in enumerate(records.columns):
        by.setdefault(n.canonical_name(c, investigator), []).append(i)
    numbered = records.toDF(*(f"c{i}" for i in range(len(records.columns))))
    return numbered.select(*(F.coalesce(*(F.col(f"c{i}") for i in at)).alias(c) for c, at in by.items()))


@dataclass
class Imported:
    """``status`` is PASS, WARNING (some rejects) or FAILED (``error`` says why, and both tables are empty)."""

    valid: DataFrame
    rejects: DataFrame
    status: str
    error: str | None
    counts: dict[str, int]
    imported_at: str


def _records(spark: SparkSession, path: str, investigator: bool) -> tuple[DataFrame, DataFrame | None]:
    """Records under canonical names, and what was no record (position, fault, source)."""
    if path.lower().endswith(".json"):
        readers.checked_path(spark, path)
        text = spark.read.text(path, wholetext=True)
        if text.isEmpty():  # a file without a byte has no row
            raise ValueError("the file is empty")
        elements = json_elements(text, "value")
        if (whole := elements.filter("fault in ('EMPTY', 'MALFORMED', 'NO_RECORDS')").first()) is not None:
            raise ValueError({"EMPTY": "the file is empty", "MALFORMED": "the file is no JSON", "NO_RECORDS": "JSON must be an object or an array of objects"}[whole.fault])
        return widened(elements, investigator), elements.filter("fault is not null").select("position", "fault")
    records = readers.read_records(spark, path)
    if not [c for c in records.columns if c.strip()]:
        raise ValueError("the file has no header row")
    return named(records, investigator), None


def import_file(spark: SparkSession, path: str, kind: str = "BLOCKCHAIN_TRANSACTION") -> Imported:
    """Reads, names, normalises and validates a file; a file that cannot be read gives an empty result with the reason.

    Of equal records the first by all fields stays.  ``rejects`` holds bad records with
    ``missing`` and ``invalid`` fields, and elements that are no records with ``fault``.
    """
    now, investigator = datetime.now(timezone.utc).isoformat(), kind != "COMBINED"
    try:
        records, faults = _records(spark, path, investigator)
        records = readers.normalised(records, investigator)
        if not records.columns:
            records = spark.createDataFrame([], "txid string")
        checked = validate.validated(records, kind).checkpoint()
    except Exception as e:
        empty = spark.createDataFrame([], "txid string")
        return Imported(empty, empty, "FAILED", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", dict.fromkeys(("read", "valid", "invalid", "duplicates"), 0), now)
    fields = records.columns
    valid = validate.deduplicated(checked.filter("valid").select(*fields), fields, F.struct(*sorted(fields)))
    rejects = checked.filter("not valid").drop("valid")
    if faults is not None:
        rejects = rejects.unionByName(faults, allowMissingColumns=True)
    one = checked.agg(F.count("*").alias("read"), F.count_if("valid").alias("valid")).first()
    bad = faults.count() if faults is not None else 0
    counts = {"read": one["read"] + bad, "valid": one["valid"], "invalid": one["read"] - one["valid"] + bad, "duplicates": one["valid"] - valid.count()}
    return Imported(valid, rejects, "PASS" if not counts["invalid"] else "WARNING", None, counts, now)


def network_canonical(frame: DataFrame, source_name: str) -> DataFrame:
    """The 12 columns of a network observation in canonical form; unreadable values are null, a blank source is ``source_name``.

    A frame without one of the required columns is refused.  Where any row lacks an
    event id, all get the first 24 digits of SHA-256 over time, ends and transaction.
    """
    frame = named(frame, investigator=False)
    lacking = [c for c in NETWORK_REQUIRED if c not in frame.columns]
    if lacking:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    text = lambda c: F.col(c).cast("string") if c in frame.columns else F.lit(None).cast("string")
    source = text("observation_source")
    asn = n.asn(text("asn"))
    out = frame.select(
        text("network_event_id").alias("network_event_id"), n.timestamp(text("timestamp")).alias("timestamp"), n.ip(text("src_ip")).alias("src_ip"), n.port(text("src_port")).alias("src_port"),
        n.ip(text("dst_ip")).alias("dst_ip"), n.port(text("dst_port")).alias("dst_port"), F.nullif(n.txid_plain(text("txid")), F.lit("")).alias("txid"), n.country_code(text("geo_country")).alias("geo_country"), asn.alias("asn"),
        text("protocol").alias("protocol"), text("direction").alias("direction"), F.when(F.coalesce(F.trim(source) == "", F.lit(True)), source_name).otherwise(source).alias("observation_source"),
    )
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid")))
    lacks = out.agg(F.coalesce(F.max(F.col("network_event_id").isNull().cast("int")), F.lit(0)).alias("lacks"))
    out = out.crossJoin(F.broadcast(lacks))  # one row
    return out.withColumn("network_event_id", F.when(F.col("lacks") == 1, F.substring(F.sha2(key, 256), 1, 24)).otherwise(F.col("network_event_id"))).drop("lacks")


def network_distinct(canonical: DataFrame) -> DataFrame:
    """Of rows that are equal but for the event id, the one with the smallest id, and how many there were."""
    rest = [c for c in NETWORK_COLUMNS if c != "network_event_id"]
    return canonical.groupBy(*rest).agg(F.min("network_event_id").alias("network_event_id"), F.count("*").alias("copies")).select(*NETWORK_COLUMNS, "copies")


def null_report(canonical: DataFrame) -> DataFrame:
    """column, nulls and distinct values of each network column, in one pass."""
    one = canonical.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in NETWORK_COLUMNS), *(F.countDistinct(c).alias(f"d_{c}") for c in NETWORK_COLUMNS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("values")) for c in NETWORK_COLUMNS))).alias("e")).select("e.*")


def import_network(spark: SparkSession, path: str, source_name: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct canonical observations of a CSV file, and its report; in ``strict`` mode a null in a required column is refused."""
    if not path.lower().endswith(".csv"):
        raise ValueError("network observations come as CSV")
    canonical = network_canonical(readers.read_records(spark, path), source_name).checkpoint()
    report = null_report(canonical)
    if strict:
        broken = report.filter(F.col("column").isin(NETWORK_REQUIRED) & (F.col("nulls") > 0)).orderBy("column").collect()
        if broken:
            raise ValueError("; ".join(f"{r['column']}: {r['nulls']} unreadable" for r in broken))
    return network_distinct(canonical), report


def chunk_digests(spark: SparkSession, paths: list[str], chunk: int = 1 << 20) -> DataFrame:
    """path, sha256 and length of files of any size, each read in chunks by one task through the cluster's file system.

    A file is never one row: tasks stream it through Arrow's file systems, which read
    local and shared paths.  A file that cannot be read has a null digest and its error.
    """

    def run(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                    digest, length = hashlib.sha256(), 0
                    with system.open_input_stream(at, compression=None) as f:
                        while data := f.read(chunk):
                            digest.update(data)
                            length += len(data)
                    rows.append((path, digest.hexdigest(), length, None))
                except Exception as e:
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sha256", "length", "error"]).astype({"length": "Int64"})

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInPandas(run, "path string, sha256 string, length long, error string")


def manifest_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, status for each path of either: OK, CHANGED, MISSING (in the manifest alone, or unreadable) or UNLISTED."""
    a, b = manifest.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("got"), F.lit(True).alias("seen"))
    both = a.withColumn("listed", F.lit(True)).join(b, "path", "full")
    status = F.when(F.col("listed").isNull(), "UNLISTED").when(F.col("seen").isNull() | F.col("got").isNull(), "MISSING").when(F.col("want") == F.col("got"), "OK").otherwise("CHANGED")
    return both.select("path", status.alias("status"))
