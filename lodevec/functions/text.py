"""The analyzer: lower-case, boundary characters separate, outer ' and _ are trimmed, empty words dropped."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges that separate words, applied after lower-casing.
BOUNDARY_RANGES = (
    "0000-0026 0028-002F 003A-005E 0060-0060 007B-00BF 00D7-00D7 00F7-00F7 037E-037E 0387-0387 055A-055F "
    "0589-0589 058A-058A 05BE-05BE 05C0-05C0 05C3-05C3 05C6-05C6 0600-0605 0609-0609 060A-060A 060C-060C "
    "060D-060D 061B-061B 061D-061F 066A-066D 06D4-06D4 2000-2BFF 3000-303F FE10-FE1F FE30-FE6F FF01-FF0F "
    "FF1A-FF20 FF3B-FF40 FF5B-FF65 1F000-1FAFF"
)


def _java_class() -> str:
    pairs = [r.split("-") for r in BOUNDARY_RANGES.split()]
    return "".join(f"\\x{{{a}}}" if a == b else f"\\x{{{a}}}-\\x{{{b}}}" for a, b in pairs)


#: The same text is valid in Java's regular expressions and in RE2.
BOUNDARY = f"[{_java_class()}]+"


def python_boundary() -> str:
    """The boundary class for Python's ``re``."""
    pairs = [r.split("-") for r in BOUNDARY_RANGES.split()]
    return "[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in pairs) + "]+"


# The bundled English and Russian stop words.
STOP_WORDS = tuple(
    """
    i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing will would shall should can could may might
    must ought a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so
    than too very cannot don't dont isn't aren't wasn't weren't hasn't haven't hadn't doesn't didn't won't
    wouldn't shouldn't couldn't mustn't
    и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от
    меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж
    вам сказал ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб
    без будто человек чего раз тоже себе под жизнь будет ж тогда кто этот говорил того потому этого какой
    совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас были куда зачем сказать всех никогда
    сегодня можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много
    разве сказала три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда
    конечно всю между
""".split()
)


STOP_SET = frozenset(STOP_WORDS)


def spaced(text: Column) -> Column:
    """The words of ``text`` in order, separated (and possibly surrounded) by single or repeated blanks; '' for NULL."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BOUNDARY, " ")
    # a trimmed edge may touch the blank that the next edge needs, so that the trailing side is a lookahead
    return F.regexp_replace(flat, "(?:^|(?<= ))['_]+|['_]+(?= |$)", "")


def words(text: Column) -> Column:
    """All words of ``text`` in order, before stop words are removed; an empty array for NULL or no words."""
    return F.filter(F.split(spaced(text), " +"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def terms(text: Column) -> Column:
    """The words without stop words: what the text index holds."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def exploded_terms(df: DataFrame, key: str, text: str, name: str = "term") -> DataFrame:
    """(key, term): one row per word that is no stop word. A set look-up on rows costs less than one inside arrays."""
    rows = df.select(key, F.explode(F.split(spaced(F.col(text)), " ")).alias(name))
    return rows.where((F.col(name) != "") & ~F.col(name).isin(*STOP_WORDS))


def sql_words(column: str) -> str:
    """The words of a column as DuckDB SQL."""
    return (
        f"list_filter(list_transform(string_split(regexp_replace(lower(coalesce({column}, '')), '{BOUNDARY}', ' ', 'g'), ' '), "
        f"lambda w: regexp_replace(w, '^[''_]+|[''_]+$', '', 'g')), lambda w: w <> '')"
    )


def sql_stop_list() -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + ")"


_PYTHON_WORD = re.compile(python_boundary().replace("[", "[^", 1))


def python_words(text: str | None) -> list[str]:
    """``words`` for one text in a Python worker, where the set operations on words are cheaper than in expressions."""
    if not text:
        return []
    text = text.lower()
    parts = _PYTHON_WORD.findall(text)
    if "'" in text or "_" in text:
        return [w for w in (p.strip("'_") for p in parts) if w]
    return parts
