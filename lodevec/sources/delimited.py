"""Delimited vector files: rows that fail to parse come out apart, each with its reason, and the others typed.

The grammar is a small recursive descent over one file's text: ``file := record*``, ``record := field (sep field)* end``,
``field := quoted | plain``. A record that breaks the grammar does not swallow what follows: the parser resumes at the
next *validated record start*, a line start from which a whole record of the header's width with a readable id parses.
``parse_text`` and ``load_files`` apply it to whole files (quoted fields may hold line breaks), ``load_lines`` to tables of
single lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..util import numbered_lines, settle

# Reasons in the order in which the first that applies is given.
REASONS = ("broken_quoting", "column_count", "bad_id", "bad_embedding", "wrong_dimension")
SEPARATORS = {"csv": ",", "tsv": "\t"}

_ID = re.compile(r"[+-]?[0-9]+")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_FLOAT_LIMIT = (2 - 2**-24) * 2.0**127  # from here on a value rounds to infinity as FLOAT


class GrammarError(Exception):
    """The text leaves the grammar at ``position`` (0-based within what was parsed)."""

    def __init__(self, position: int):
        super().__init__(position)
        self.position = position


@dataclass
class Record:
    start: int
    end: int
    fields: list[str] | None
    reason: str | None = None
    position: int | None = None
    id: int | None = None
    embedding: list[float] | None = None


def _quoted(text: str, at: int, sep: str, ends: str) -> tuple[str, int]:
    """A field whose first character is a quote; inner quotes are doubled."""
    parts, i = [], at + 1
    while True:
        j = text.find('"', i)
        if j < 0:
            raise GrammarError(at)
        parts.append(text[i:j])
        if text.startswith('"', j + 1):
            parts.append('"')
            i = j + 2
            continue
        i = j + 1
        if i == len(text) or text[i] == sep or (ends and text[i] in ends):
            return "".join(parts), i
        raise GrammarError(j)


def _plain(text: str, at: int, stop: re.Pattern) -> tuple[str, int]:
    m = stop.search(text, at)
    end = m.start() if m else len(text)
    q = text.find('"', at, end)
    if q >= 0:
        raise GrammarError(q)
    return text[at:end], end


def _record(text: str, at: int, sep: str, ends: str) -> tuple[list[str], int]:
    """The fields of one record and the place of its end; ``ends``: characters that end it besides the text's end."""
    stop, fields = re.compile("[" + re.escape(sep + ends) + "]"), []
    while True:
        field, at = _quoted(text, at, sep, ends) if text.startswith('"', at) else _plain(text, at, stop)
        fields.append(field)
        if at == len(text) or text[at] != sep:
            return fields, at
        at += 1


def parse_id(field: str) -> int | None:
    field = field.strip()
    if not _ID.fullmatch(field):
        return None
    digits = field.lstrip("+-").lstrip("0")
    if len(digits) > 19:  # beyond 64 bits, and int() refuses very long texts
        return None
    value = int(digits or "0") * (-1 if field[0] == "-" else 1)
    return value if -(2**63) <= value < 2**63 else None


def parse_embedding(field: str) -> list[float] | None:
    """A one-level JSON array, or numbers separated by commas, or (without commas) by blanks; None if neither."""
    field, grammar = field.strip(), _NUMBER
    if field.startswith("["):
        if not field.endswith("]"):
            return None
        grammar, parts = _JSON_NUMBER, [p.strip(" \t\r\n") for p in field[1:-1].split(",")]
    elif "," in field:
        parts = [p.strip() for p in field.split(",")]
    else:
        parts = field.split()
    if not parts or not all(grammar.fullmatch(p) for p in parts):
        return None
    values = [float(p) for p in parts]
    return values if all(abs(v) < _FLOAT_LIMIT for v in values) else None


def typed(record: Record, columns: list[str], dimension: int) -> Record:
    """Fill in id and embedding, or the first reason why that fails."""
    if record.reason is None and len(record.fields) != len(columns):
        record.reason = "column_count"
    if record.reason is None:
        by_name = dict(zip(columns, record.fields))
        record.id = parse_id(by_name.get("id", ""))
        record.embedding = parse_embedding(by_name.get("embedding", ""))
        if record.id is None:
            record.reason = "bad_id"
        elif record.embedding is None:
            record.reason = "bad_embedding"
        elif len(record.embedding) != dimension:
            record.reason = "wrong_dimension"
    return record


def parse_line(line: str, sep: str, columns: list[str], dimension: int) -> Record | None:
    """One line of a file; None for a blank line."""
    line = line[:-1] if line.endswith("\r") else line
    if not line or line.isspace():
        return None
    try:
        fields, end = _record(line, 0, sep, "")
        record = Record(0, end, fields)
    except GrammarError as e:
        record = Record(0, len(line), None, "broken_quoting", e.position)
    return typed(record, columns, dimension)


def _line_end(text: str, at: int) -> int:
    j = text.find("\n", at)
    return len(text) if j < 0 else j


def parse_text(text: str, sep: str, columns: list[str], dimension: int) -> Iterator[Record]:
    """The records of a whole file without its header. Quoted fields may span lines.

    A record that opens a quote and closes it only after a line start at which a sound record begins is taken as broken
    at its own first line: otherwise one lost quote would turn the rest of a file into one field. So each such line start,
    an anchor, begins a record whatever stands before it, and a text may be cut at any of them.
    """
    at, anchors = 0, Anchors(text, sep, columns)
    while at < len(text):
        end = _line_end(text, at)
        line = text[at:end]
        if not line.strip():
            at = end + 1
            continue
        try:
            fields, stop = _record(text, at, sep, "\r\n")
            record = Record(at, stop, fields)
            if stop > end and anchors.first(end + 1, stop) is not None:
                raise GrammarError(at)
            if len(fields) != len(columns) and stop > end:
                raise GrammarError(at)
        except GrammarError as e:
            record = Record(at, end, None, "broken_quoting", e.position)
            anchor = anchors.first(end + 1, len(text))
            record.end = stop = len(text) if anchor is None else anchor
            # lines between the break and the anchor belong to no sound record: each is reported by itself
            if anchor is None or anchor > end + 1:
                record.end = stop = end
        yield typed(record, columns, dimension)
        at = stop
        while at < len(text) and text[at] in "\r\n":
            at += 1


class Anchors:
    """The line starts of a text from which a sound record of its file parses; each stretch is searched once."""

    def __init__(self, text: str, sep: str, columns: list[str]):
        self.text, self.sep, self.columns = text, sep, columns
        self.seen, self.found = 0, -1  # no anchor lies in [seen, found)

    def first(self, at: int, limit: int) -> int | None:
        """The first anchor in [at, limit)."""
        if not self.seen <= at <= self.found:
            self.seen, self.found = at, at
            while self.found < len(self.text) and not sound_start(self.text, self.found, self.sep, self.columns):
                self.found = _line_end(self.text, self.found) + 1
        return self.found if self.found < min(limit, len(self.text)) else None


def sound_start(text: str, at: int, sep: str, columns: list[str]) -> bool:
    """Whether a record of the header's width with a readable id starts at ``at``."""
    place = columns.index("id") if "id" in columns else None
    try:
        fields, _ = _record(text, at, sep, "\r\n")
    except GrammarError:
        return False
    return len(fields) == len(columns) and (place is None or parse_id(fields[place]) is not None)


_FIELDS = ["id", "embedding", "fields", "reason", "error_at"]
_PARSED = "id bigint, embedding array<float>, fields array<string>, reason string, error_at int"


def load_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Parse a table of lines by the header and dimension of their file.

    ``lines``: row_id, file_id, line_no, raw_line. ``files``: file_id, file_format, header_columns, dimension.
    Result: row_id, file_id, line_no, id, embedding, fields, reason, error_at, one row for each line that is not blank;
    ``reason`` is NULL for loaded rows.

    Defined cases: a NULL or blank line gives no row; a line of a file that ``files`` lacks, or whose format is unknown or
    whose header is NULL, gets the reason ``unknown_file``; a header without an id (embedding) column fails every line as
    bad_id (bad_embedding); repeated lines are each loaded; empty tables give an empty result; other columns are ignored.
    Work is one pass over the lines; a file with most of the lines is no group here, its header only travels with them.
    """
    f = files.select(
        F.col("file_id").alias("_file"), F.lower(F.trim("file_format")).alias("_format"), "header_columns", "dimension"
    ).dropDuplicates(["_file"])
    joined = lines.select("row_id", "file_id", "line_no", "raw_line").join(f, F.col("file_id") == F.col("_file"), "left")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, list[str]] = {}
        for b in batches:
            at, got = [], []
            for i, (line, form, header, dim) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3, 7)))):
                if line is None or not line.strip():
                    continue
                sep = SEPARATORS.get(form)
                if sep is None or header is None or dim is None:
                    r = Record(0, len(line), None, "unknown_file")
                else:
                    columns = headers.get(header)
                    if columns is None:
                        columns = headers[header] = [c.strip() for c in header.split(",")]
                    r = parse_line(line, sep, columns, dim)
                    if r is None:
                        continue
                at.append(i)
                got.append(r)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in range(3)), *_arrays(got)], names=["row_id", "file_id", "line_no", *_FIELDS])

    return joined.select("row_id", "file_id", "line_no", "raw_line", "_format", "header_columns", "dimension").mapInArrow(parse, f"row_id bigint, file_id bigint, line_no int, {_PARSED}")


def _arrays(records: list[Record]) -> list[pa.Array]:
    sound = [r.reason is None for r in records]
    return [
        pa.array([r.id if ok else None for r, ok in zip(records, sound)], pa.int64()),
        pa.array([r.embedding if ok else None for r, ok in zip(records, sound)], pa.list_(pa.float32())),
        pa.array([r.fields for r in records], pa.list_(pa.string())),
        pa.array([r.reason for r in records], pa.string()),
        pa.array([r.position for r in records], pa.int32()),
    ]


def load_files(lines: DataFrame, files: DataFrame, stretch: int = 20_000) -> DataFrame:
    """Parse whole files whose quoted fields may hold line breaks, from their lines.

    ``lines``: file_id, line_no, raw_line; ``files`` as for ``load_lines``. Result: file_id, line_no (of the record's first
    line), lines (how many it takes), id, embedding, fields, reason, error_at (within the record).

    A file is cut at anchors, lines that are a sound record by themselves, the first in every ``stretch`` lines; as an anchor
    begins a record in any case, the pieces give what the whole file does, and a file of any length takes many tasks. A
    stretch without such a line goes with the one before. The place of the cuts is found in a table of one row a stretch.

    Defined cases: NULL lines count as empty ones; blank lines outside quotes give no row; lines of a file that ``files``
    lacks, or that has no format or header, give one row each with the reason ``unknown_file``; of lines with one number
    the smallest text comes first; empty tables give an empty result; other columns are ignored.
    """
    f = files.select(F.col("file_id").alias("_file"), F.lower(F.trim("file_format")).alias("_format"), "header_columns", "dimension").dropDuplicates(["_file"])
    rows = lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    rows = rows.join(f, F.col("file_id") == F.col("_file"), "left").drop("_file")
    names = rows.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line, form, header = (b.column(names.index(c)).to_pylist() for c in ("raw_line", "_format", "header_columns"))
            sound = [bool(x) and fm in SEPARATORS and h is not None and sound_start(x, 0, SEPARATORS[fm], [c.strip() for c in h.split(",")]) for x, fm, h in zip(line, form, header)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sound, pa.bool_())], names=[*names, "anchor"])

    marked = settle(rows.mapInArrow(mark, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("anchor", "boolean")])).withColumn("stretch", F.floor(F.col("line_no") / stretch)), "marked")
    cuts = marked.groupBy("file_id", "stretch").agg(F.min(F.when(F.col("anchor"), F.col("line_no"))).alias("cut"))
    before = F.last("cut", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.withColumn("former", F.coalesce(before, F.lit(-1).cast("bigint"))).withColumnsRenamed({"file_id": "cf", "stretch": "cs"})
    pieces = marked.join(cuts, F.col("file_id").eqNullSafe(F.col("cf")) & (F.col("stretch") == F.col("cs")))
    pieces = pieces.withColumn("piece", F.when(F.col("line_no") >= F.col("cut"), F.col("cut")).otherwise(F.col("former")))

    def parse(key, t):
        t = t.sort_by([("line_no", "ascending"), ("raw_line", "ascending")])
        numbers, raw = t.column("line_no").to_pylist(), t.column("raw_line").to_pylist()
        form, header, dim = (t.column(c)[0].as_py() for c in ("_format", "header_columns", "dimension"))
        if form not in SEPARATORS or header is None or dim is None:
            at = [i for i, x in enumerate(raw) if x.strip()]
            got = [Record(0, len(raw[i]), None, "unknown_file") for i in at]
            first, taken = [numbers[i] for i in at], [1] * len(at)
        else:
            starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
            got = list(parse_text("\n".join(raw), SEPARATORS[form], [c.strip() for c in header.split(",")], dim))
            place = np.searchsorted(starts, [r.start for r in got], "right") - 1
            last = np.searchsorted(starts, [max(r.start, r.end - 1) for r in got], "right") - 1
            first, taken = [numbers[i] for i in place], (last - place + 1).tolist()
            got = [replace(r, position=None if r.position is None else r.position - r.start) for r in got]
        file = pa.array([key[0].as_py()] * len(got), pa.int64())
        return pa.Table.from_arrays([file, pa.array(first, pa.int64()), pa.array(taken, pa.int32()), *_arrays(got)], names=["file_id", "line_no", "lines", *_FIELDS])

    return pieces.select(*names, "piece").groupBy("file_id", "piece").applyInArrow(parse, f"file_id bigint, line_no bigint, lines int, {_PARSED}")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select("row_id", "file_id", "id", "embedding")


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("row_id", "reason")


def read_delimited(spark: SparkSession, path: str, sep: str, dimension: int, stretch: int = 20_000) -> DataFrame:
    """Whole files with a header line: one row per record with its file, line_no (the header is line 1), lines, id,
    embedding, fields, reason and error_at. The header may not hold line breaks. Files are read in splits."""
    names = {v: k for k, v in SEPARATORS.items()}
    rows = numbered_lines(spark, path)
    heads = rows.where("line_no = 1").select("file", F.xxhash64("file").alias("file_id"), "value").collect()
    files = []
    for r in heads:
        columns = [c.strip() for c in _record(r.value.rstrip("\r"), 0, sep, "")[0]]
        files.append((r.file_id, names[sep], ",".join(columns), dimension))
    schema = "file_id bigint, file_format string, header_columns string, dimension int"
    body = rows.where("line_no > 1").select(F.xxhash64("file").alias("file_id"), "line_no", F.col("value").alias("raw_line"))
    got = load_files(body, spark.createDataFrame(files, schema), stretch)
    at = spark.createDataFrame([(r.file_id, r.file) for r in heads], "of bigint, file string")
    return got.join(F.broadcast(at), F.col("file_id") == F.col("of")).select("file", "line_no", "lines", *_FIELDS)
