"""Table directories: loading, sentinel clean-up, descriptions, fingerprints and contract checks."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.numbers import NUMBERS, nan_to_null, quoted
from driftwell.operators.timeline import event_days

# The day that stands for "missing", the columns it is looked for in, required tables.
DAY_SENTINEL = 365243
DAY_MARK = "DAYS"
DESCRIPTION_NAMES = ["row", "feature", "column", "columns", "name"]
DESCRIPTION_TEXTS = ["description", "desc"]
DESCRIPTION_TABLES = ["table", "source"]
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {"application_train": ("SK_ID_CURR", "TARGET")}


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime, entry) of the matching files; contents are not read.

    A matching folder, such as Spark writes for a table, counts with every file under it. ``entry`` is the path of the
    file or folder that matched.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = files.load(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing matches, or there is no such folder.
        try:
            found = files.load(folder).where(F.lit(False))
        except AnalysisException as absent:
            if absent.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(folder) from absent
            raise
    # Behind the folder, which Spark may write with a scheme and its working folder in front, stands the entry.
    place = posixpath.normpath(re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", folder))
    place = os.getcwd() if place == "." else place
    lead = r"^(?:[a-zA-Z][\w+.-]*:(?://[^/]*)?)?/" if place.startswith("/") else "^.*?/"
    inside = f"\\Q{place.strip('/')}\\E/" if place.strip("/") else ""
    behind = f"({lead}{inside}[^/]+)"
    entry = F.regexp_extract("path", behind, 1)
    listed = found.select("path", "length", "modificationTime", F.when(entry != "", entry).otherwise(F.col("path")).alias("entry"))
    return listed.where(~F.element_at(F.split("entry", "/"), -1).rlike("^[_.]"))


def sentinel_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if DAY_MARK in f.name.upper() and isinstance(f.dataType, NUMBERS)]


def null_day_sentinel(df: DataFrame, columns: Sequence[str] | None = None, sentinel: float = DAY_SENTINEL) -> DataFrame:
    """The sentinel becomes NULL in number columns whose name mentions days."""
    names = sentinel_columns(df) if columns is None else columns
    return df.withColumns({c: F.when(quoted(c) != sentinel, quoted(c)) for c in names}) if names else df


def sentinel_counts(df: DataFrame, columns: Sequence[str] | None = None, sentinel: float = DAY_SENTINEL) -> DataFrame:
    """(column, replaced): how many values the clean-up removes, in one pass."""
    names = sentinel_columns(df) if columns is None else list(columns)
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(quoted(c) == sentinel).alias("replaced")) for c in names
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


@dataclass
class TableSet(Mapping[str, DataFrame]):
    """Named tables of a directory; a table that is not there reads as None."""

    tables: dict[str, DataFrame]
    load_errors: list[tuple[str, str]] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, check_encoding: bool = True) -> DataFrame:
    """UTF-8, or Latin-1 when the file is not valid UTF-8 (Spark replaces bad bytes, it does not fail)."""
    encoding = "UTF-8"
    if check_encoding:
        broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
        encoding = "UTF-8" if broken.isEmpty() else "ISO-8859-1"
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def load_tables(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType | str] | None = None,
    file_format: str = "csv",
    check_encoding: bool = True,
    sentinel: bool = True,
) -> TableSet:
    """Every file of the folder, or folder of files, as a table named by its stem, lazily bound.

    Unreadable files are listed, not fatal. With ``schemas`` no pass is spent on inference; Parquet needs
    none and is pruned and filtered at the scan.
    """
    files = sorted(r["path"] for r in list_files(spark, folder, f"*.{file_format}").select(F.col("entry").alias("path")).distinct().collect())
    if not files:
        raise ValueError(f"no {file_format} files in {folder}")
    made = TableSet({})
    for path in files:
        name = path.rsplit("/", 1)[-1].removesuffix(f".{file_format}")
        try:
            if file_format == "csv":
                df = read_csv(spark, path, (schemas or {}).get(name), check_encoding)
            else:
                df = spark.read.format(file_format).load(path)
        except Exception as error:  # any unreadable file is reported to the caller
            made.load_errors.append((path, str(error)))
            continue
        df = nan_to_null(df)
        made.tables[name] = null_day_sentinel(df) if sentinel else df
    return made


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    lowered = {c.lower(): c for c in columns}
    return next((lowered[c.lower()] for c in candidates if c.lower() in lowered), None)


def load_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(feature, description, table) with tolerant column names; the last entry of a name wins."""
    raw = read_csv(spark, path)
    name, text = find_column(raw.columns, DESCRIPTION_NAMES), find_column(raw.columns, DESCRIPTION_TEXTS)
    table = find_column(raw.columns, DESCRIPTION_TABLES)
    if name is None or text is None:
        return spark.createDataFrame([], "feature string, description string, table string")
    blank = F.lit("")
    entries = raw.select(
        F.trim(quoted(name).cast("string")).alias("feature"),
        F.coalesce(F.trim(quoted(text).cast("string")), blank).alias("description"),
        (F.coalesce(F.trim(quoted(table).cast("string")), blank) if table else blank).alias("table"),
        F.monotonically_increasing_id().alias("line"),
    )
    known = entries.where(F.col("feature").isNotNull() & (F.col("feature") != "") & (F.lower("feature") != "nan"))
    newest = F.max_by(F.struct("description", "table"), "line").alias("newest")
    return known.groupBy("feature").agg(newest).select("feature", "newest.*")


def data_version(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(name, size_bytes, modified_utc) per file, sorted by name: a fingerprint that reads no contents.

    Files of a table that is a folder are named with it.
    """
    parent = F.length("entry") - F.length(F.element_at(F.split("entry", "/"), -1))
    return list_files(spark, folder, pattern).select(
        F.substring("path", parent + 1, F.length("path")).alias("name"),
        F.col("length").alias("size_bytes"),
        F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("modified_utc"),
    ).orderBy("name")


def data_fingerprint(versions: DataFrame) -> str:
    """One hash over the files of ``data_version``, in the order of their names."""
    line = F.concat_ws("|", "name", F.col("size_bytes").cast("string"), "modified_utc")
    # One short line for each file of the folder.
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return versions.agg(F.sha2(F.coalesce(body, F.lit("")), 256)).first()[0]


# ---- Contract ----

def check_contract(
    tables: Mapping[str, DataFrame],
    required: Mapping[str, Sequence[str]] = REQUIRED_COLUMNS,
    keys: Mapping[str, str] | None = None,
    times: Mapping[str, str] | None = None,
) -> DataFrame:
    """(table, check, ok, detail) for presence, columns, rows, key nulls, key duplicates and missing time.

    Tables without the wanted columns are reported rather than read.
    """
    if not tables:
        raise ValueError("no tables to check")
    spark = next(iter(tables.values())).sparkSession
    schema = "table string, check string, ok boolean, detail string"
    flat: list[tuple[str, str, bool, str]] = []
    counted = None
    for name, columns in required.items():
        table = tables.get(name)
        flat.append((name, "present", table is not None, "" if table is not None else "absent"))
        if table is None:
            continue
        absent = [c for c in columns if c not in table.columns]
        flat.append((name, "columns", not absent, ",".join(absent)))
    timed = bool(event_days(tables)) if "SK_ID_CURR" in {c for t in tables.values() for c in t.columns} else False
    if times is None:
        flat.append(("", "temporal_source", timed, "" if timed else "no history with a usable time column"))
    for name, key in (keys or {}).items():
        table = tables.get(name)
        if table is None or key not in table.columns:
            continue
        part = key_checks(table, name, key)
        counted = part if counted is None else counted.unionByName(part)
    for name, time in (times or {}).items():
        table = tables.get(name)
        if table is None or time not in table.columns:
            flat.append((name, "time_column", False, f"{time} absent"))
            continue
        share = table.agg(F.avg(quoted(time).isNull().cast("int")).alias("x")).select(
            F.lit(name).alias("table"), F.lit("time_column").alias("check"), (F.col("x") < 1).alias("ok"),
            F.format_string("missing share %.4f", "x").alias("detail"),
        )
        counted = share if counted is None else counted.unionByName(share)
    result = spark.createDataFrame(flat, schema)
    return result if counted is None else result.unionByName(counted)


def key_checks(table: DataFrame, name: str, key: str) -> DataFrame:
    """Rows, rows without key, and surplus rows per key of one table."""
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    totals = per_key.agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("rows") - 1)), F.lit(0)).alias("surplus"),
    )
    cell = lambda check, ok, value: F.struct(
        F.lit(check).alias("check"), ok.alias("ok"), value.cast("string").alias("detail")
    )
    checks = F.array(
        cell("rows", F.col("rows") > 0, F.col("rows")),
        cell("key_nulls", F.col("nulls") == 0, F.col("nulls")),
        cell("key_duplicates", F.col("surplus") == 0, F.col("surplus")),
    )
    return totals.select(F.lit(name).alias("table"), F.explode(checks).alias("c")).select("table", "c.*")
