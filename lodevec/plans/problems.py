"""Queries for the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import delimited
from ..util import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return delimited.failed(delimited.load_lines(table(spark, d, "raw_rows"), table(spark, d, "import_files")))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    got = delimited.loaded(delimited.load_lines(table(spark, d, "raw_rows"), table(spark, d, "import_files")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("row_id", "id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines read as whole files, in which a quoted field may go on over lines and a lost quote ends at the next anchor."""
    got = delimited.load_files(table(spark, d, "raw_rows"), table(spark, d, "import_files"))
    return got.select("file_id", "line_no", F.col("lines").cast("bigint").alias("lines"), "id", F.size("embedding").cast("bigint").alias("n"), "reason")


# SQL: the grammar of a line as regular expressions, by the file's separator
_PLAIN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_JSON = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _fields(sep: str) -> str:
    """Quoted fields, or plain ones without quotes."""
    return f"(?:\"(?:[^\"]|\"\")*\"|[^\"{sep}]*)"


def _by_separator(expression: str) -> str:
    tab = expression.replace("SEP", "\t").replace("FIELD", _fields("\t"))
    return f"case when sep = ',' then {expression.replace('SEP', ',').replace('FIELD', _fields(','))} else {tab} end"


_LINES = f"""
with f as (select file_id, case lower(trim(file_format)) when 'csv' then ',' when 'tsv' then chr(9) end as sep,
  list_transform(string_split(header_columns, ','), lambda c: trim(c)) as header, dimension from import_files),
l as (select row_id, regexp_replace(raw_line, '\\r$', '') as line, sep, header, dimension from raw_rows join f using (file_id)
  where regexp_matches(raw_line, '\\S')),
q as (select *, {_by_separator("regexp_full_match(line, 'FIELD(?:SEPFIELD)*')")} as sound,
  {_by_separator("regexp_extract_all('SEP' || line, 'SEP(FIELD)', 1)")} as parts from l),
v as (select *, list_transform(parts, lambda p: case when p[1] = chr(34) then replace(p[2:-2], chr(34) || chr(34), chr(34)) else p end) as fields from q),
n as (select *, trim(coalesce(fields[list_position(header, 'id')], ''), E' \\t\\n\\r\\f') as id_text,
  trim(coalesce(fields[list_position(header, 'embedding')], ''), E' \\t\\n\\r\\f') as e from v),
d as (select *, ltrim(regexp_replace(id_text, '^[+-]', ''), '0') as digits,
  case when starts_with(e, '[') then regexp_full_match(e, '\\[\\s*{_JSON}(?:\\s*,\\s*{_JSON})*\\s*\\]')
    when contains(e, ',') then regexp_full_match(e, '{_PLAIN}(?:\\s*,\\s*{_PLAIN})*') else regexp_full_match(e, '{_PLAIN}(?:\\s+{_PLAIN})*') end as is_list from n),
w as (select *, case when length(digits) <= 19 then try_cast(case when digits = '' then '0' else digits end as hugeint) * (case when starts_with(id_text, '-') then -1 else 1 end) end as number,
  case when is_list then list_transform(regexp_extract_all(e, '[^\\s,\\[\\]]+'), lambda x: try_cast(x as double)) end as numbers from d),
r as (select row_id, number, numbers, case when not sound then 'broken_quoting' when len(fields) <> len(header) then 'column_count'
  when not regexp_full_match(id_text, '[+-]?[0-9]+') or number is null or number < -9223372036854775808 or number > 9223372036854775807 then 'bad_id'
  when not is_list or len(list_filter(numbers, lambda x: x is null or abs(x) >= 3.4028235677973366e38)) > 0 then 'bad_embedding'
  when len(numbers) <> dimension then 'wrong_dimension' end as reason from w)
""".replace("\\\\", "\\")

QUERIES = {"p5_found": p5_found, "p5_loaded": p5_loaded, "p5_files": p5_files}
SQL = {
    "p5_found": _LINES + "select row_id, reason from r where reason is not null",
    "p5_loaded": _LINES + "select row_id, number::bigint as id, len(numbers)::bigint as n, round(list_sum(list_transform(numbers, lambda x: x::float::double)), 4) as total from r where reason is null",
}
