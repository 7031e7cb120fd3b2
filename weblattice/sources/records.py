"""Delimited records with an error-recovering recursive-descent grammar.

    file   := record (newline record)*
    record := field ("," field)*
    field  := quoted | bare
    quoted := '"' ( any but '"' | '""' )* '"'
    bare   := any but ',' (and, in a file, newline)

A field that begins with a quote must close it before a comma or the end. The
grammar never raises: an error becomes a located :class:`Problem`, and in a
file parsing resumes at the next *validated anchor*, a line start from which a
record with the expected number of fields parses without error. Lines between
the error and the anchor belong to the broken record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblattice.operators.skew import salted_join

BOM = "﻿"
_QUOTED = re.compile(r'"((?:[^"]|"")*)"', re.S)
_BARE = re.compile(r"[^,]*", re.S)
_BARE_LINE = re.compile(r"[^,\r\n]*")
_NEWLINE = re.compile(r"\r\n|\n|\r")


@dataclass(frozen=True)
class Problem:
    """What went wrong and where (offset in characters, line from 1)."""

    reason: str
    offset: int
    line: int
    detail: str = ""


def _field(text: str, at: int, in_file: bool) -> tuple[str, int, str]:
    """A field, the place after it, and what is wrong with it."""
    if text.startswith('"', at):
        m = _QUOTED.match(text, at)
        if m is None:
            return "", at, "unclosed quote"
        end = m.end()
        if end < len(text) and text[end] != "," and not (in_file and text[end] in "\r\n"):
            return "", end, "text after the closing quote"
        return m.group(1).replace('""', '"'), end, ""
    m = (_BARE_LINE if in_file else _BARE).match(text, at)
    return m.group(), m.end(), ""


def _record(text: str, at: int, in_file: bool) -> tuple[list[str], int, str]:
    """The fields of a record, the place after it, and what is wrong with it."""
    fields = []
    while True:
        value, at, wrong = _field(text, at, in_file)
        if wrong:
            return fields, at, wrong
        fields.append(value)
        if not text.startswith(",", at):
            return fields, at, ""
        at += 1


def parse_record(text: str) -> tuple[list[str], Problem | None]:
    """The fields of a text that is one record; newlines may stand in it."""
    if text.startswith(BOM):
        text = text[1:]
    if '"' not in text:
        return text.split(","), None
    fields, at, wrong = _record(text, 0, False)
    return fields, Problem("quoting", at, text.count("\n", 0, at) + 1, wrong) if wrong else None


def parse_file(text: str, columns: int | None = None) -> Iterator[tuple[int, list[str], Problem | None]]:
    """(line number, fields, problem) of each record of a whole file.

    ``columns`` defaults to the first record's number of fields.
    """
    at = 1 if text.startswith(BOM) else 0
    line = 1
    while at < len(text):
        start, first = at, line
        fields, at, wrong = _record(text, at, True)
        if wrong:
            problem = Problem("quoting", at, line + text.count("\n", start, at), wrong)
            at = _anchor(text, start, columns)
        else:
            if columns is None:
                columns = len(fields)
            problem = None if len(fields) == columns or fields == [""] else Problem("columns", start, line, str(len(fields)))
            m = _NEWLINE.match(text, at)
            at = m.end() if m else at
        line += text.count("\n", start, at)
        yield first, fields, problem


def _anchor(text: str, broken: int, columns: int | None) -> int:
    """The first line start after ``broken`` from which a whole record parses."""
    for m in _NEWLINE.finditer(text, broken):
        fields, _, wrong = _record(text, m.end(), True)
        if not wrong and len(fields) > 1 and (columns is None or len(fields) == columns):
            return m.end()
    return len(text)


# --- typed layouts -----------------------------------------------------------------------------

_DIGITS = re.compile(r"[0-9]+\Z")
_STATUS = re.compile(r"[+-]?[0-9]+\Z")
MAX_CLICKS = 9007199254740991
#: Depths are bigints; a larger run of digits, valid all the same, loads as this.
DEEPEST = 2**63 - 1


def _clicks(v: str):
    return int(v) if _DIGITS.match(v) and len(v.lstrip("0")) <= 16 and int(v) <= MAX_CLICKS else False


def _status(v: str):
    if not v:
        return None
    if not _STATUS.match(v) or len(v.lstrip("+-0")) > 3:
        return False
    n = int(v)
    return n if n == 0 or 100 <= n <= 599 else False


def _depth(v: str):
    """Any run of digits is valid; one beyond a bigint loads as :data:`DEEPEST`."""
    return min(int(v) if len(v.lstrip("0")) <= 38 else DEEPEST, DEEPEST) if _DIGITS.match(v) else None if not v else False


def _text(v: str):
    return v if v else False


@dataclass(frozen=True)
class Layout:
    """The needed columns of a kind of file: header key, output name, check.

    A check returns the typed value, None for an allowed empty one, or False.
    """

    columns: tuple[tuple[str, str, Callable], ...]


LAYOUTS = {
    "analytics": Layout((("source_url", "source_url", _text), ("target_url", "target_url", _text), ("clicks", "clicks", _clicks))),
    "internal": Layout((("address", "address", _text), ("status code", "status_code", _status), ("crawl depth", "crawl_depth", _depth))),
}

PARSED = T.StructType(
    [
        T.StructField("record_id", T.LongType()), T.StructField("run_id", T.LongType()), T.StructField("export", T.StringType()),
        T.StructField("source_document", T.StringType()), T.StructField("line_number", T.IntegerType()),
        T.StructField("source_url", T.StringType()), T.StructField("target_url", T.StringType()), T.StructField("clicks", T.LongType()),
        T.StructField("address", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("crawl_depth", T.LongType()),
        T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType()),
        T.StructField("error_offset", T.IntegerType()), T.StructField("error_line", T.IntegerType()), T.StructField("raw", T.StringType()),
    ]
)
_OUT = ("source_url", "target_url", "clicks", "address", "status_code", "crawl_depth")


def _check(raw: str, export: str, header: tuple[int, dict[str, int]] | None) -> tuple[dict, Problem | None]:
    layout = LAYOUTS.get(export)
    fields, problem = parse_record(raw)
    if problem:
        return {}, problem
    if layout is None or header is None:
        return {}, Problem("header", 0, 1, "no usable header for this record")
    width, places = header
    if len(fields) != width:
        return {}, Problem("columns", 0, 1, f"{len(fields)} fields, the header has {width}")
    out = {}
    for key, name, check in layout.columns:
        value = check(fields[places[key]].strip()) if key in places else None
        if value is False:
            return {}, Problem("value", 0, 1, name)
        out[name] = value
    return out, None


def _header(raw: str | None, export: str) -> tuple[int, dict[str, int]] | None:
    if raw is None:
        return None
    fields, problem = parse_record(raw)
    if problem:
        return None
    places: dict[str, int] = {}
    for i, f in enumerate(fields):
        places.setdefault(f.strip().lstrip(BOM).strip().lower(), i)
    needed = [key for key, _, _ in LAYOUTS[export].columns] if export in LAYOUTS else []
    return (len(fields), places) if all(k in places for k in needed) else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PARSED)
    headers: dict[tuple[str | None, str | None], tuple | None] = {}
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        out: dict[str, list] = {f.name: [] for f in PARSED}
        for i, raw in enumerate(cols["raw"]):
            export, head = cols["export"][i], cols["header"][i]
            if (head, export) not in headers:
                if len(headers) > 10_000:
                    headers.clear()
                headers[head, export] = _header(head, export)
            values, problem = _check(raw, export, headers[head, export])
            for n in ("record_id", "run_id", "export", "source_document", "line_number"):
                out[n].append(cols[n][i])
            for n in _OUT:
                out[n].append(values.get(n))
            out["reason"].append(problem and problem.reason)
            out["detail"].append(problem and problem.detail)
            out["error_offset"].append(problem and problem.offset)
            out["error_line"].append(problem and problem.line)
            out["raw"].append(raw if problem else None)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def parse_records(rows: DataFrame) -> DataFrame:
    """Type the records of ``rows`` and part those that cannot be loaded.

    ``rows`` has record_id, run_id, export, source_document, line_number and
    raw; further columns are ignored. The record with line_number 1 is its
    file's header; imported again, the one with the lowest record_id serves.
    Headers and empty records (null, or nothing but blanks) are no records and
    left out. One row per other record: typed columns with a null ``reason``,
    or ``reason`` (quoting, columns, value; header where the file has no
    usable one), its place and the raw text.

    A file may hold a third of all rows: a hot file's records spread over
    sub-keys, to which its header is copied (:mod:`weblattice.operators.skew`).
    """
    key = ["run_id", "source_document", "export"]
    slim = rows.select("record_id", *key, "line_number", "raw")
    header = (
        slim.where("line_number = 1 and raw is not null")
        .groupBy(*key).agg(F.min_by("raw", "record_id").alias("header"))
    )
    body = slim.where(
        F.coalesce(F.col("line_number") != 1, F.lit(True)) & F.coalesce(F.regexp_like("raw", F.lit(r"[^\s\x{FEFF}]")), F.lit(False))
    )
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(body, header, key, F.struct("record_id", "line_number"), counts)
    return joined.select("record_id", *key, "line_number", "raw", "header").mapInArrow(_parse_batches, PARSED)


def reassembled(rows: DataFrame, records: int = 5000) -> DataFrame:
    """(run_id, source_document, export, chunk, first_line, content, header): files put together again from raw records.

    Records stand in the order of their lines; of one imported again the one
    with the lowest record_id counts. Null records are left out. A file may be
    large: it is cut after every ``records`` line numbers, at record starts, so
    no task holds a whole file. ``header`` is the record with line number 1,
    or null.
    """
    key = ["run_id", "source_document", "export"]
    once = rows.where("raw is not null and line_number is not null").groupBy(*key, "line_number").agg(F.min_by("raw", "record_id").alias("raw"))
    chunks = once.groupBy(*key, F.floor((F.col("line_number") - 1) / records).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("line_number", "raw"))).alias("lines")
    )
    text = chunks.select(*key, "chunk", F.col("lines")[0]["line_number"].alias("first_line"), F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("content"))
    header = once.where("line_number = 1").select(*key, "raw")
    return salted_join(text, header, key, F.col("chunk"), chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("raw", "header")


def recovered_records(rows: DataFrame, records: int = 5000) -> DataFrame:
    """(run_id, export, source_document, chunk, line, fields, reason, error_offset) of whole files, with recovery.

    The grammar reads a file's text as it was, without knowing where records
    begin: a broken quote swallows what follows until the next validated
    record start, where reading goes on. ``line`` counts lines of text within
    the chunk, from 1. Empty lines have no row.
    """
    schema = "run_id long, export string, source_document string, chunk long, line int, fields array<string>, reason string, error_offset int"

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for run_id, export, doc, chunk, content, header in zip(f["run_id"], f["export"], f["source_document"], f["chunk"], f["content"], f["header"]):
                head, wrong = parse_record(header) if header is not None else ([], None)
                columns = len(head) if header is not None and wrong is None else None
                for line, fields, bad in parse_file(content, columns):
                    if bad or fields != [""]:
                        out.append((run_id, export, doc, chunk, line, None if bad else fields, bad and bad.reason, bad and bad.offset))
            yield pd.DataFrame(out, columns=["run_id", "export", "source_document", "chunk", "line", "fields", "reason", "error_offset"]).astype({"error_offset": "Int32", "run_id": "Int64"})

    return reassembled(rows, records).select("run_id", "export", "source_document", "chunk", "content", "header").mapInPandas(run, schema)


def parse_whole_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Records of whole files: (path, line, fields, reason, offset), with recovery at anchors."""
    schema = f"{path} string, line int, fields array<string>, reason string, error_offset int"

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [
                (p, line, None if bad else fields, bad and bad.reason, bad and bad.offset)
                for p, t in zip(f[path], f[text]) if t
                for line, fields, bad in parse_file(t)
            ]
            yield pd.DataFrame(out, columns=[path, "line", "fields", "reason", "error_offset"]).astype({"error_offset": "Int32"})

    return files.select(path, text).mapInPandas(run, schema)
