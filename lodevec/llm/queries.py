"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..util import settle, table
from . import clusters, duplicates, frequency, leakage, lookalike, mixture, neighbours


def _p2(spark: SparkSession, d: str) -> DataFrame:
    docs = frequency.one_per_key(table(spark, d, "import_records"), "id", "document")
    return frequency.with_verdict(frequency.term_frequencies(docs, "document"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).where(F.col("verdict").isNotNull()).select("term", "verdict")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("term", "occurrences", "records", F.coalesce("verdict", F.lit("useful")).alias("verdict"))


_P2_SQL = f"""
with r as (select id, any_value(document) as document from import_records group by id),
w as (select id, unnest({T.sql_words('document')}) as term from r),
n as (select count(distinct id) as total from w),
f as (select term, count(*) as occurrences, count(distinct id) as records from w group by term)
select term, occurrences, records,
  case when records <= 2 then 'rare' when records * 10 > total * 4 then 'common' else 'useful' end as verdict
from f, n
"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_same_pairs(settle(_forms(spark, d), "forms"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select(F.col("key").alias("doc_id"), "repaired", "form")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return settle(mixture.with_tokens(table(spark, d, "documents"), "doc_id", "text", "source"), "tokens")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.balance(_counted(spark, d), table(spark, d, "mixture_targets")).where("short").select(F.col("planned").alias("source"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    counted = _counted(spark, d)
    mixed = mixture.mix(counted, mixture.balance(counted, table(spark, d, "mixture_targets"), "shares"))
    return mixed.select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    counted = _counted(spark, d)
    solved = mixture.balance(counted, table(spark, d, "mixture_targets"), "shares")
    return mixture.shares(mixture.mix(counted, solved), solved)



def _nearest(spark: SparkSession, d: str, **how) -> DataFrame:
    return neighbours.knn(table(spark, d, "import_records"), "id", "embedding", "collection_name", 5, **how)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(_nearest(spark, d))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact 5 nearest that the index finds, for every id divisible by 20 against all rows."""
    ask = lambda i: F.pmod(i, F.lit(20)) == 0
    exact = _nearest(spark, d, queries=ask, every_block=True).select("id", "neighbour")
    got = _nearest(spark, d, queries=ask).select("id", "neighbour", F.lit(1).alias("hit"))
    both = exact.join(got, ["id", "neighbour"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"), (F.count("hit") / F.count("*")).alias("recall"))



def _duplicates(spark: SparkSession, d: str):
    return duplicates.near_duplicates(table(spark, d, "import_records"), "id", "document", "embedding")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.all_pairs(*_duplicates(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.groups(*_duplicates(spark, d))



def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and the longest run that stands in one."""
    return _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.max("words").alias("longest_run"))



def p6_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that say what an item says, in part in other words."""
    got = leakage.paraphrases(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), *[F.round(c, 6).alias(c) for c in ("cosine", "in_order", "answered")])


def _linked(spark: SparkSession, d: str, **how) -> DataFrame:
    return clusters.linked(table(spark, d, "import_records"), "id", "embedding", **how)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("first_id", "id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(_linked(spark, d, whole=True)).select("first_id", "size", F.concat_ws(",", F.col("typical").cast("array<string>")).alias("typical"))


_P1_SQL = f"""
with r as (select id, any_value(document) as document, any_value(embedding) as embedding from import_records group by id),
w as (select id, list_distinct({T.sql_words('document')}) as words, embedding from r),
t as (select id, len(words) as n, unnest(words) as term from w where len(words) >= 8),
j as (select a.id as id_a, b.id as id_b, any_value(a.n + b.n) as both_n, count(*) as shared
  from t a join t b on a.term = b.term and a.id < b.id group by a.id, b.id),
s as (select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from w a, w b where len(a.words) < 8 and a.id <> b.id
  and list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) <= 0.01e0)
select id_a, id_b from j where shared * 10 >= 7 * (both_n - shared) union select id_a, id_b from s
"""

_GROUPS_SQL = f"""
with recursive pairs as ({_P1_SQL}),
e as (select id_a as a, id_b as b from pairs union select id_b, id_a from pairs),
r as (select a as id, a as root from e union select e.b, r.root from r join e on e.a = r.id)
select id, min(root) as "group" from r group by id
"""

_APART = "array_distance(a.v, b.v)"
_ONCE = "select id, any_value(collection_name) as g, any_value(embedding)::double[32] as v from import_records group by id"

# distances are roots of multiples of 2^-14, which doubles tell apart
_P3_SQL = f"""
with recursive o as ({_ONCE}),
e as (select a.id as a, b.id as b from o a, o b where a.id <> b.id and {_APART} <= sqrt(1.5e0)),
r as (select a as id, a as root from e union select e.b, r.root from r join e on e.a = r.id),
f as (select id, min(root) as first_id from r group by id)
select first_id, id from f where first_id in (select first_id from f group by first_id having count(*) >= 5)
"""

_P4_SQL = f"""
with o as ({_ONCE}),
n as (select a.id as x, b.id as y, row_number() over (partition by a.id order by {_APART}, b.id) as r from o a join o b on a.g = b.g and a.id <> b.id)
select distinct least(x, y) as id_a, greatest(x, y) as id_b from n where r <= 5
"""

# words and signs stand for tokens: which sources are short doesn't depend on the tokenizer
_P7_SQL = """
with t as (select lower(trim(source)) as source, sum(target_weight) as w, max(max_repeats) as cap from mixture_targets group by 1),
d as (select lower(trim(source)) as source, sum(len(regexp_extract_all(coalesce(text, ''), '[\\pL\\pM]{1,6}|\\pN|[^\\s\\pL\\pM\\pN]'))) as tokens from documents group by 1),
x as (select t.source, w / sum(w) over () as share, cap, coalesce(tokens, 0) as tokens from t left join d on d.source = t.source)
select source from x where cap * tokens < share * (select sum(tokens) from x)
"""

def _sql_fold(column: str) -> str:
    """The look of a text as DuckDB SQL: ordinary characters, then Latin letters for look-alikes. The last step of the
    consistent form only spells equal looks in their script, so that texts of equal looks are those of equal forms."""
    base, fold = lookalike.single_steps()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for c, to in base.items():
        if len(to) > 1:
            column = f"replace({column}, {quoted(c)}, {quoted(to)})"
    one = {c: to for c, to in base.items() if len(to) == 1}
    gone = "".join(c for c, to in base.items() if not to)
    column = f"nfc_normalize(translate({column}, {quoted(''.join(one) + gone)}, {quoted(''.join(one.values()))}))"
    return f"nfc_normalize(translate({column}, {quoted(''.join(fold))}, {quoted(''.join(fold.values()))}))"


_P8_SQL = f"""
with f as (select doc_id, text, {_sql_fold('text')} as look from documents where text is not null)
select a.doc_id as doc_a, b.doc_id as doc_b from f a join f b on a.look = b.look and a.doc_id < b.doc_id where a.text <> b.text
"""

_P6_SQL = f"""
with t as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from eval_items),
w as (select kind, id, {T.sql_words(_sql_fold('text'))} as words from t),
g as (select kind, id, unnest(list_transform(range(1, len(words) - 10), lambda i: array_to_string(words[i : i + 11], ' '))) as run from w where len(words) >= 12)
select distinct d.id as doc_id, i.id as item_id from g d join g i on d.run = i.run where d.kind = 0 and i.kind = 1
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_paraphrases": p6_paraphrases,
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p4_found": p4_found,
    "p4_recall": p4_recall,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
}
SQL = {
    "p1_found": _P1_SQL,
    "p1_groups": _GROUPS_SQL,
    "p3_found": _P3_SQL,
    "p4_found": _P4_SQL,
    "p8_found": _P8_SQL,
    "p6_found": _P6_SQL,
    "p7_found": _P7_SQL.replace("\\\\", "\\"),
    "p2_terms": _P2_SQL,
    "p2_found": f"select term, verdict from ({_P2_SQL}) where verdict <> 'useful'",
}
