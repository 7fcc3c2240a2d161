"""Readers of CSV, JSON and XML records, the import with its rejects, and sinks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions import normalize
from ledgerweave.operators import validate

# Elements that hold a record, and arrays that wrap records.
ROW_TAGS = ("record", "transaction", "observation", "ip", "item")
WRAPPERS = ("records", "data")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark before the first name goes."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An object, an array of objects, JSON lines, or records within ``records`` or ``data``; scalars become text, arrays stay JSON text."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    for wrapper in WRAPPERS:
        if wrapper in df.columns and df.schema[wrapper].dataType.typeName() == "array":
            df = df.select(F.explode(wrapper).alias("r")).select("r.*")
            break
    return df.select(*(F.to_json(c).alias(c) if t.startswith("array") or t.startswith("struct") else F.col(c).cast("string") for c, t in df.dtypes))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Records under any of the known element names, namespaces ignored.  Nested lists become JSON text; all else is the text as it stands."""
    found = None
    for tag in ROW_TAGS:
        reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True)
        df = reader.option("inferSchema", True).load(path)
        if not df.columns or set(df.columns) <= {"_VALUE"}:
            continue
        # The names and lists are inferred, but no type: a date would lose its notation
        plain = [T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.StructType)) else T.StringType()) for f in df.schema]
        df = reader.schema(T.StructType(plain)).load(path)
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c).cast("string") for c, t in df.dtypes))
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no record element in {path}")
    return found


READERS = {".csv": read_csv, ".json": read_json, ".xml": read_xml}


def checked_path(spark: SparkSession, path: str) -> str:
    """The path's suffix; a path of another format, or one that is missing or no file, is refused."""
    suffix = path[path.rfind(".") :].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported format {suffix!r}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target) or not files.getFileStatus(target).isFile():
        raise FileNotFoundError(path)
    return suffix


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The reader is chosen by the path's suffix."""
    return READERS[checked_path(spark, path)](spark, path)


def optional_parquet(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """The table and True, or an empty one of ``schema`` and False where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.read.parquet(path), True
    return spark.createDataFrame([], schema), False


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """path, digest of every file, hashed where it lies."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def normalised(records: DataFrame, investigator: bool = True) -> DataFrame:
    """Canonical names, and canonical text for ids and addresses; other fields stay as they came, for validation."""
    df = normalize.rename_fields(records, investigator)
    c = F.col
    if "txid" in df.columns:
        df = df.withColumn("txid", F.nullif(normalize.txid_plain(c("txid")), F.lit("")))
    for side in ("input_wallets", "output_wallets"):
        if side in df.columns:
            df = df.withColumn(side, F.to_json(normalize.wallet_list(c(side), commas=investigator)))
    return df


class Import:
    """``valid`` (deduplicated, with fingerprint), ``rejects`` (with reasons) and ``provenance`` (one row) of one import."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "COMBINED") -> None:
        records = normalised(read_records(spark, path), investigator=kind != "COMBINED")
        checked = validate.validated(records, kind)
        fields = records.columns
        good = checked.filter("valid").select(*fields)
        self.valid = validate.deduplicated(good, fields, F.struct(*sorted(fields)))
        self.rejects = checked.filter("not valid")
        counts = checked.agg(F.count("*").alias("records_read"), F.count_if("valid").alias("valid_records"), F.count_if(~F.col("valid")).alias("invalid_records"))
        kept = self.valid.agg(F.count("*").alias("unique_records"))
        digest = sha256_of(spark, path).agg(F.min("sha256").alias("sha256"))
        now = datetime.now(timezone.utc).isoformat()
        self.provenance = (
            counts.crossJoin(kept).crossJoin(digest)  # three tables of one row each
            .withColumn("duplicates_removed", F.col("valid_records") - F.col("unique_records"))
            .withColumn("import_id", F.substring(F.sha2(F.concat_ws("|", "sha256", F.lit(kind)), 256), 1, 16))
            .withColumn("status", F.when(F.col("invalid_records") == 0, "PASS").otherwise("WARNING"))
            .withColumn("path", F.lit(path))
            .withColumn("imported_at", F.lit(now))
        )


def write_import(done: Import, folder: str) -> None:
    """Three JSON sinks: records, errors, manifest."""
    done.valid.write.mode("overwrite").json(f"{folder}/records")
    done.rejects.write.mode("overwrite").json(f"{folder}/errors")
    done.provenance.write.mode("overwrite").json(f"{folder}/manifest")


def synthetic_records(spark: SparkSession, n: int = 100, seed: int = 20260925) -> DataFrame:
    """Deterministic records for tests: times 37 minutes apart, documentation addresses, amounts from a hash."""
    i = F.col("id")
    u = lambda k: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000
    amount = F.round(0.01 + 4.99 * u(1), 8)
    fee = F.round(0.0001 + 0.0009 * u(2), 8)
    at = F.timestamp_seconds(F.lit(1767225600) + i * 37 * 60 + F.floor(u(3) * 60))
    return spark.range(n).select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.format_string("192.0.2.%d", i % 254 + 1).alias("src_ip"), F.format_string("198.51.100.%d", i * 7 % 254 + 1).alias("dst_ip"),
        F.lit("8333").alias("src_port"), F.lit("8333").alias("dst_port"), F.lpad(F.lower(F.hex(i + 1)), 64, "0").alias("txid"), F.format_string('["in_%d"]', i).alias("input_wallets"), F.format_string('["out_%d"]', i).alias("output_wallets"),
        amount.cast("string").alias("input_amount"), F.round(amount - fee, 8).cast("string").alias("output_amount"), fee.cast("string").alias("fee"), F.lit("P2WPKH").alias("script_type"), F.lit("IN").alias("geo_country"), F.lit("AS64500").alias("asn"),
    )


def graphml(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, most_edges: int = 5000, most_nodes: int = 5000) -> str:
    """A bounded view as GraphML text: edges at the seeds (``node_id``; all edges without seeds) in id order, and their nodes.

    At most ``most_edges`` and ``most_nodes`` rows come to the driver; an edge whose
    end is beyond the nodes' limit goes.  All attributes are written as text, nulls
    not at all.
    """
    from xml.sax.saxutils import escape, quoteattr

    if seeds is not None:
        ends = seeds.select("node_id").distinct()
        at = edges.select("edge_id", F.explode(F.array("source", "target")).alias("node_id")).join(ends, "node_id", "left_semi").select("edge_id").distinct()
        edges = edges.join(at, "edge_id", "left_semi")
    some = edges.orderBy("edge_id").limit(most_edges)
    ends = some.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    rows = nodes.join(ends, "node_id", "left_semi").orderBy("node_id").limit(most_nodes).collect()
    kept = {r["node_id"] for r in rows}
    links = [r for r in some.collect() if r["source"] in kept and r["target"] in kept]
    of_nodes, of_edges = [c for c in nodes.columns if c != "node_id"], [c for c in edges.columns if c not in ("edge_id", "source", "target")]

    def data(row, kind: str, columns: list[str]) -> str:
        return "".join(f"<data key={quoteattr(f'{kind}_{c}')}>{escape(str(row[c]))}</data>" for c in columns if row[c] is not None)

    out = ['<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id={quoteattr(f"{kind}_{c}")} for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>' for kind, columns in (("node", of_nodes), ("edge", of_edges)) for c in columns]
    out.append('<graph edgedefault="directed">')
    out += [f"<node id={quoteattr(r['node_id'])}>{data(r, "node", of_nodes)}</node>" for r in rows]
    out += [f"<edge id={quoteattr(r['edge_id'])} source={quoteattr(r['source'])} target={quoteattr(r['target'])}>{data(r, "edge", of_edges)}</edge>" for r in links]
    return "\n".join([*out, "</graph></graphml>"])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file with the text, in whatever file system the path names; an existing file is replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
