"""Contract files: minute bars in CSV, text or Parquet files whose names hold the contract's code; metadata and calendars."""

from __future__ import annotations

import csv
import logging
import re
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contracts import contract_pattern, normalize_contract
from ..operators.bars import clean
from ..operators.calendars import classify, lint, merge
from .storage import existing

_LOG = logging.getLogger(__name__)

#: Names of the time column, in order of preference; other names of the value columns (fixed values).
TIME_NAMES = ["timestamp", "datetime", "date_time", "time", "dt", "DateTime", "Timestamp"]
ALIASES = {
    "open": ["o", "open_price"], "high": ["h", "high_price"], "low": ["l", "low_price"], "close": ["c", "close_price", "last"],
    "volume": ["vol"], "open_interest": ["oi", "openinterest"],
}
VALUES = ["open", "high", "low", "close", "volume"]
#: Columns of files without header, by place (fixed values).
BY_PLACE = ["timestamp", "open", "high", "low", "close", "volume", "open_interest"]


def time_column(columns: list[str]) -> str | None:
    """The column of times: one with a known name, else one that has it in other letters; None without."""
    exact = [c for c in columns if c in TIME_NAMES]
    by_lower = {c.lower(): c for c in reversed(columns)}
    return exact[0] if exact else next((by_lower[n.lower()] for n in TIME_NAMES if n.lower() in by_lower), None)


def _names(columns: list[str]) -> dict[str, str]:
    """Columns by the value that they hold (the first of several), in any letters; an error names the values without one."""
    known = {alias: name for name, more in ALIASES.items() for alias in [name, *more]}
    found = {}
    for c in columns:
        if name := known.get(c.lower()):
            found.setdefault(name, c)
    if lost := [c for c in VALUES if c not in found]:
        raise ValueError(f"Missing required columns: {', '.join(lost)}")
    return found


def wall_clock(ts: str, kind: str, zone: str) -> Column:
    """A time as zone's wall clock shows it: times with a zone are converted, others are taken as they are; null for what isn't a time."""
    return F.expr(f"cast(convert_timezone(current_timezone(), '{zone}', cast({ts} as timestamp_ntz)) as timestamp_ntz)") if kind == "timestamp" else F.col(ts).try_cast("timestamp_ntz")


def _minutes(df: DataFrame, root: str, zone: str) -> DataFrame:
    """Rows of files of one layout as minutes. df: their columns, and _file, _block and _line: the place of a row, numbered in the scan, before anything moves."""
    kinds = {c: t for c, t in df.dtypes if c not in _PLACE}
    at = time_column(list(kinds))
    if at is None:
        raise ValueError("no time column")
    named = _names(list(kinds))
    value = lambda c: (F.col(f"`{named[c]}`").try_cast("double") if c in named else F.lit(None).cast("double")).alias(c)
    out = df.select(F.lit(root).alias("root"), normalize_contract(F.col("_file"), root).alias("contract"), wall_clock(f"`{at}`", kinds[at], zone).alias("ts"), *[value(c) for c in [*VALUES, "open_interest"]], F.col("_file").alias("src_file"), F.struct(F.col("_block").alias("block"), F.col("_line").alias("line")).alias("pos"))
    return clean(out.where("ts is not null"))


_PLACE = ["_file", "_block", "_line"]
#: Bytes of a text file's start that its first line is looked for in.
HEAD_BYTES = 1 << 16


def contract_paths(spark: SparkSession, folder: str, root: str = "HG", extensions: tuple[str, ...] = ("csv", "txt", "parquet", "pq"), max_files: int | None = None) -> DataFrame:
    """path of each contract file of a root in a folder and those below, by the names alone (Spark passes over empty files); max_files: only the first so many by path."""
    if not extensions or not existing(spark, [folder]):
        raise FileNotFoundError(f"no files of {root} in {folder}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{root.upper()}*.{{{','.join(extensions)}}}").load(folder).select("path")
    named = listed.where(F.element_at(F.split("path", "/"), -1).rlike(contract_pattern(root)))
    return named.orderBy("path").limit(max_files) if max_files else named


def first_fields(head: bytes) -> list[str]:
    """The fields of a text's first line, without blanks and byte order mark; none for an empty one."""
    line = head.decode("utf-8-sig", "replace").split("\n", 1)[0].rstrip("\r")
    return [f.strip() for f in next(csv.reader([line], skipinitialspace=True), [])] if line.strip() else []


def _layout_of(path: str) -> tuple[list[str] | None, bool]:
    """Columns of a file and whether its first line is a header, from its footer or first line; runs in a task."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    local = path.startswith("file:")
    system, at = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    if path.endswith((".parquet", ".pq")):
        with system.open_input_file(at) as file:
            return [f"{f.name}\t{f.type}" for f in pq.read_schema(file)], True
    with system.open_input_stream(at) as file:
        fields = first_fields(file.read(HEAD_BYTES))
    known = {n.lower() for n in TIME_NAMES}
    header = any(f.lower() in known for f in fields)
    return (fields if header else BY_PLACE[: len(fields)]), header  # a line of a file without header goes nowhere


def layouts(paths: DataFrame) -> DataFrame:
    """path, columns, header, error of each file: footers and first lines are read in tasks, a file at a time; bodies are not."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    columns, header = _layout_of(path)
                    rows.append((path, columns or None, header, None if columns else "no columns"))
                except Exception as error:  # noqa: BLE001  the file is named with it
                    rows.append((path, None, False, f"{type(error).__name__}: {error}"[:300]))
            kinds = [pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "columns", "header", "error"])

    tasks = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.repartition(tasks).mapInArrow(run, "path string, columns array<string>, header boolean, error string")


def _escaped(path: str) -> str:
    """A path that a reader takes as it is, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _scan(spark: SparkSession, paths: list[str], columns: list[str], header: bool, skip_bad: bool) -> DataFrame:
    """One scan of files of one layout, with the place of each row; of text files, columns that nobody asks for are not parsed."""
    meta = [F.col("_metadata.file_name").alias("_file")]
    if paths[0].endswith((".parquet", ".pq")):
        df = spark.read.option("ignoreCorruptFiles", skip_bad).parquet(*map(_escaped, paths))
        return df.select("*", *meta, F.lit(0).cast("long").alias("_block"), F.col("_metadata.row_index").alias("_line"))
    names = [c if c.lower() not in {x.lower() for x in columns[:i]} else f"{c}#{i}" for i, c in enumerate(columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv([_escaped(p) for p in paths])
    return df.select("*", *meta, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def contract_minutes(spark: SparkSession, folder: str, root: str = "HG", zone: str = "US/Central", extensions: tuple[str, ...] = ("csv", "txt", "parquet", "pq"), max_files: int | None = None, skip_bad: bool = False) -> DataFrame:
    """Minute rows of all files of a root in a folder and those below: root, contract, ts, values, open_interest, src_file, pos (place in the file).

    Each file has a layout: the columns of its own footer or header, or, where no field of the first line has a time column's name, those of
    BY_PLACE. Files of one layout are one scan, which renames and casts as that layout asks, so each body is read once and no
    layout hides another. Only names, layouts and errors come to the driver. Rows without a time are left out; repeated times are kept.
    max_files: only the first so many files by path are opened. skip_bad: files that can't be read (no columns, not the needed ones, a broken
    footer) are left out, each named in a warning, instead of an error.
    """
    by: dict[tuple, list[str]] = {}
    bad: list[tuple[str, str]] = []
    for row in layouts(contract_paths(spark, folder, root, extensions, max_files)).collect():
        if row["error"]:
            bad.append((row["path"], row["error"]))
        else:
            by.setdefault((row["path"].rpartition(".")[2] in ("parquet", "pq"), row["header"], tuple(row["columns"])), []).append(row["path"])
    parts = []
    for (footer, header, columns), paths in sorted(by.items()):
        plain = [c.split("\t")[0] if footer else c for c in columns]
        try:
            if time_column(plain) is None:
                raise ValueError("no time column")
            _names(plain)
            parts.append(_minutes(_scan(spark, sorted(paths), plain, header, skip_bad), root, zone))
        except ValueError as error:
            bad += [(p, str(error)) for p in paths]
    for path, why in sorted(bad):
        if not skip_bad:
            raise ValueError(f"{path}: {why}")
        _LOG.warning("left out %s: %s", path, why)
    if not parts:
        raise FileNotFoundError(f"no files of {root} in {folder}")
    return reduce(DataFrame.unionByName, parts)


def contract_metadata(spark: SparkSession, path: str) -> DataFrame:
    """contract, expiry, source, source_url and line (rising with the lines) of a metadata file with a header."""
    df = spark.read.option("header", True).csv(path)
    more = [F.col(c) for c in ("source", "source_url") if c in df.columns]
    return df.select(F.col("contract"), F.col("expiry_date").try_cast("date").alias("expiry"), *more, F.monotonically_increasing_id().alias("line"))


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A classified calendar file; lines that start with # are comments, rows without a date are left out."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    return classify(df.withColumn("date", F.col("date").try_cast("date")))


def load_calendars(spark: SparkSession, paths: list[str], hierarchy: str = "override") -> DataFrame:
    """Calendar files merged; those that don't exist are passed over with a warning, none at all is an error."""
    there = existing(spark, paths)
    for p in paths:
        if p not in there:
            _LOG.warning("calendar file not found: %s", p)
    return merge([load_calendar(spark, p) for p in there], hierarchy)


def lint_files(spark: SparkSession, paths: list[str]) -> tuple[int, list[dict]]:
    """What is wrong with calendar files, and the exit code that says so: 2 for a file that is missing or can't be read, 1 for errors in one, 0 for warnings alone; a later such file's code counts."""
    code, issues = 0, []
    for path in paths:
        if not existing(spark, [path]):
            issues.append({"level": "error", "message": f"File not found: {path}", "date": None})
            code = 2
            continue
        try:
            rows = spark.read.option("header", True).option("comment", "#").csv(path)
            found = lint(rows.withColumn("date", F.col("date").try_cast("date"))).orderBy("level", "date").collect()  # a row for a holiday
        except Exception as error:  # noqa: BLE001  whatever makes a file unreadable is its issue
            issues.append({"level": "error", "message": f"Failed to read {path}: {str(error).splitlines()[0]}", "date": None})
            code = 2
            continue
        issues += [{"level": r["level"], "message": r["message"], "date": str(r["date"])} for r in found]
        if any(r["level"] == "error" for r in found):
            code = 1
    return code, issues


def load_hierarchy(spark: SparkSession, folder: str, commodity: str, exchange: str = "CME") -> DataFrame:
    """The calendars of a commodity and exchange in a folder, the more special overriding the others; an error names all files that were searched if there is none."""
    candidates = calendar_candidates(folder, exchange, commodity)
    if not (there := existing(spark, candidates)):
        raise FileNotFoundError(f"No calendar files found for {commodity} on {exchange}. Searched: {candidates}")
    return merge([load_calendar(spark, p) for p in there], "override")


def calendar_candidates(folder: str, exchange: str, commodity: str) -> list[str]:
    """Calendar files of an exchange and commodity, in small letters, the most special first."""
    exchange, commodity = exchange.lower(), commodity.lower()
    return [f"{folder}/{n}.csv" for n in (f"{exchange}_{commodity}_holidays", f"{exchange}_{commodity}", f"{exchange}_globex_holidays", f"{exchange}_globex", "global_futures")]
