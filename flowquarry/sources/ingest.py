"""Raw flow CSV files to a clean, partitioned Parquet table.

Files are read as text columns and typed by one projection, so a column cannot
change its type from file to file. A source is the file a row comes from (or what a
pattern finds in its path). Each time a source is new or changed it is read again as a
new delivery; the manifest, written last, says which delivery of a source is valid.
Readers join with it, so an older delivery, or one that broke off, is never seen, even
if the new one has no rows of a class or no rows at all.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from flowquarry.config import BENIGN, FEATURE_COLUMNS, IP_COLUMNS, LABEL_COLUMN, TIMESTAMP_COLUMN
from flowquarry.functions.cleaning import to_number
from flowquarry.operators.columns import quoted
from flowquarry.operators.positions import row_digest

TEXT_COLUMNS = ("id", "Flow ID", *IP_COLUMNS, LABEL_COLUMN, TIMESTAMP_COLUMN)
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm")
FILE_STEM = r"([^/]+)\.[^./]+$"
HEADERS_AT_ONCE = 16
SCHEMAS = "table string, schema string"
MANIFEST = "source string, files long, bytes long, modified timestamp, delivery long, reason string"


def _source(pattern: str) -> Column:
    """Source of a row or file, from its path, in which odd characters are written as %XX."""
    return F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv", source: str = FILE_STEM) -> DataFrame:
    """(path, source, bytes, modified) of the files below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", _source(source).alias("source"), F.col("length").alias("bytes"),
                        F.col("modificationTime").alias("modified"))


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line (names kept as they stand); one row of each file is read, many files side by side."""
    def header(path: str) -> tuple[str, ...]:
        line = spark.read.text(path).head(1)
        return tuple(next(csv.reader([line[0]["value"]]), [])) if line else ()

    with ThreadPoolExecutor(max_workers=HEADERS_AT_ONCE) as pool:
        found = list(zip(paths, pool.map(header, paths)))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in sorted(found, key=lambda f: (f[1], f[0])):
        groups.setdefault(names, []).append(path)
    return groups


def read_flow_files(
    spark: SparkSession, headers: dict[tuple[str, ...], list[str]], wanted: Sequence[str] = (), source: str = FILE_STEM,
) -> DataFrame | None:
    """All files as text columns with blanks stripped off the names, plus ``source``; None without any file.

    Columns are matched by name: files with the same header are one scan, the scans are united. Names that
    differ from a wanted one only in case take the wanted spelling.
    """
    spelling = {w.lower(): w for w in (*wanted, *TEXT_COLUMNS)}
    whole: DataFrame | None = None
    for header, files in headers.items():
        names = [spelling.get(h.strip().lower(), h.strip()) for h in header]
        schema = StructType([StructField(n, StringType()) for n in names])
        part = spark.read.schema(schema).option("header", True).csv(files).withColumn(
            "source", _source(source))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def has_label(header: Sequence[str]) -> bool:
    return LABEL_COLUMN.lower() in {h.strip().lower() for h in header}


def parse_time(column: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Time by the first format that fits, NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats])


def type_flows(raw: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Features as numbers (bad, NaN and infinite ones 0), other columns as text, time parsed.

    Adds ``row_key``, ``is_attack`` and ``reject_reason``: ``label`` without a label, ``time`` if there is a time that
    no format fits, else NULL.
    """
    numeric = set(features) - set(TEXT_COLUMNS)
    cols = [to_number(c).alias(c) if c in numeric else quoted(c) for c in raw.columns]
    label = F.trim(quoted(LABEL_COLUMN))
    no_label = F.coalesce(label == "", F.lit(True))
    reason = F.when(no_label, "label")
    if TIMESTAMP_COLUMN in raw.columns:
        unreadable = (F.trim(quoted(TIMESTAMP_COLUMN)) != "") & parse_time(quoted(TIMESTAMP_COLUMN), formats).isNull()
        reason = reason.when(unreadable, "time")
    typed = raw.select(*cols, row_digest(raw.drop("source")).alias("row_key"), reason.alias("reject_reason"))
    if TIMESTAMP_COLUMN in raw.columns:
        text = quoted(TIMESTAMP_COLUMN)
        typed = typed.withColumns({TIMESTAMP_COLUMN: parse_time(text, formats), f"{TIMESTAMP_COLUMN} text": F.when(F.col("reject_reason") == "time", text)})
    return typed.withColumn(LABEL_COLUMN, F.when(~no_label, label)).withColumn("is_attack", quoted(LABEL_COLUMN) != BENIGN)


def split_rejects(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rejected rows with their reason)."""
    text = f"{TIMESTAMP_COLUMN} text"
    return flows.filter("reject_reason IS NULL").drop("reject_reason", text), flows.filter("reject_reason IS NOT NULL").drop("is_attack")


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    except Exception as e:  # the first run finds no manifest
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], MANIFEST)
        raise


def valid_deliveries(spark: SparkSession, store: str) -> DataFrame:
    """The manifest's last entry of each source."""
    entries = _manifest(spark, store)
    rest = [F.col(c) for c in entries.columns if c not in ("source", "delivery")]
    return entries.groupBy("source").agg(F.max(F.struct("delivery", *rest)).alias("last")).select("source", "last.*")


def ingest(spark: SparkSession, data_path: str, store: str, wanted: Sequence[str] = (), formats: Sequence[str] = TIME_FORMATS,
           source: str = FILE_STEM) -> DataFrame:
    """Brings the flow table up to date with a folder of CSV files and returns it.

    A source is done when its last manifest entry holds its files' number, size and time; all others go through one
    job. ``wanted`` names the columns to read as numbers (default: the configured features). Files without a label
    column are listed in the manifest with their reason and have no rows.
    """
    files = list_files(spark, data_path, source=source)
    states = files.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
    known = valid_deliveries(spark, store)
    same = ["source", "files", "bytes", "modified"]
    todo = states.join(known.select(*same), same, "left_anti")
    # the names of new files, which Spark's scans hold on the driver in any case
    pending = [r["path"] for r in files.join(todo, "source", "left_semi").select("path").collect()]
    if pending:
        headers = read_headers(spark, pending)
        labelled = {h: p for h, p in headers.items() if has_label(h)}
        unlabelled = [p for h, paths in headers.items() if not has_label(h) for p in paths]
        last = known.agg(F.max("delivery")).first()[0]
        if not labelled and last is None:
            raise ValueError(f"no file with a label column in {data_path}")
        delivery = F.lit((last or 0) + 1).cast("long")
        raw = read_flow_files(spark, labelled, wanted, source)
        if raw is not None:
            flows, rejects = split_rejects(type_flows(raw, wanted or FEATURE_COLUMNS, formats))
            for rows, name in ((flows, "flows"), (rejects, "rejects")):
                rows.withColumn("delivery", delivery).write.mode("append").partitionBy("source", "delivery").parquet(f"{store}/{name}")
                spark.createDataFrame([(name, rows.schema.json())], SCHEMAS).coalesce(1).write.mode("append").parquet(f"{store}/schemas")
        bad = files.join(spark.createDataFrame([(p,) for p in unlabelled], "path string"), "path").select("source").distinct().withColumn(
            "reason", F.lit("no label column"))
        todo.join(bad, "source", "left").select(*same, delivery.alias("delivery"), "reason").write.mode("append").parquet(f"{store}/manifest")
    elif known.isEmpty():
        raise ValueError(f"no CSV files in {data_path}")
    return read_flow_table(spark, store)


def _stored_schema(spark: SparkSession, store: str, name: str) -> StructType | None:
    """Columns of all deliveries, as noted when they were written: no footer is read for them."""
    try:
        noted = spark.read.schema(SCHEMAS).parquet(f"{store}/schemas").filter(F.col("table") == name)
        texts = [r[0] for r in noted.groupBy("schema").agg(F.count("*")).orderBy("schema").collect()]
    except AnalysisException:  # nothing has been delivered yet
        return None
    fields: dict[str, StructField] = {}
    for text in texts:
        for f in StructType.fromJson(json.loads(text)).fields:
            fields.setdefault(f.name, f)
    return StructType(list(fields.values())) if fields else None


def _valid_rows(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Rows of the valid deliveries; sources that look like numbers or dates stay text."""
    schema = _stored_schema(spark, store, name)
    if schema is None:
        return spark.createDataFrame([], "source string, reject_reason string")
    # the partition columns are the last ones, as in any read of the folder
    rest = [f for f in schema.fields if f.name != "source"]
    whole = StructType([*rest, StructField("source", StringType()), StructField("delivery", LongType())])
    try:
        table = spark.read.schema(whole).parquet(f"{store}/{name}")
    except AnalysisException as e:  # a store without any reject has no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], whole)
    valid = valid_deliveries(spark, store).select("source", "delivery")
    return table.join(valid, ["source", "delivery"], "left_semi").drop("delivery")


def read_flow_table(spark: SparkSession, store: str) -> DataFrame:
    return _valid_rows(spark, store, "flows")


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    """Rejected rows of the valid deliveries with ``reject_reason`` and the text of unreadable times."""
    return _valid_rows(spark, store, "rejects")


def unlabelled_sources(spark: SparkSession, store: str) -> DataFrame:
    """(source, reason) of sources of which a file has no label column."""
    return valid_deliveries(spark, store).filter("reason IS NOT NULL").select("source", "reason")


def list_sources(table: DataFrame) -> DataFrame:
    """Sources of the table with their rows, from partition values and file footers."""
    return table.groupBy("source").agg(F.count("*").alias("rows"))
