"""One consistent form for texts that look the same but consist of different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import md5_long, settle

# Letters that look like a Latin letter, by that letter, of Cyrillic, Greek, Armenian, Latin extensions, Cherokee
# and Lisu, as in published tables of confusable characters. Only letters that are no composition are listed: accents are taken
# off before the comparison and composed again after it. Compatibility letters and small capitals follow by rule.
LOOKALIKES = """
a:аɑα b:Ꮟ c:сϲ d:ԁᏧ e:е g:ɡց h:һհᏂ i:іιᎥ j:јϳ k:кκ l:ӏ n:ո o:оοօ p:рρ q:ԛզ s:ѕ u:υս v:νѵ w:ԝ x:хⅹ y:уүγᎩ
A:АΑᎪꓮ B:ВΒᏴꓐ C:СϹᏟꓚ D:Ꭰꓓ E:ЕΕᎬꓰ F:Ϝꓝ G:ԌᏀꓖ H:НΗᎻꓧ I:ІΙӀꓲ J:ЈͿᎫꓙ K:КΚᏦꓗ L:Ꮮꓡ M:МΜϺᎷꓟ N:Νꓠ O:ОΟՕꓳ P:РΡᏢꓑ Q:Ԛ R:ᎡᏒꓣ S:ЅՏᏚꓢ
T:ТΤᎢꓔ U:Սꓴ V:ѴᏙꓦ W:ԜᎳꓪ X:ХΧꓫ Y:УΥҮꓬ Z:ΖᏃꓜ
"""
# Small capitals that look like the small letter; the others look like the capital.
SMALL_CAPITALS_AS_SMALL = "COSUVWXZ"
# Characters without width.
ZERO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff" + "".join(
    map(chr, range(0xFE00, 0xFE10))
)

def _small_capitals() -> dict[str, str]:
    """By the characters' names."""
    out = {}
    for c in map(chr, [*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)]):
        m = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))
        if m:
            out[c] = m[1].lower() if m[1] in SMALL_CAPITALS_AS_SMALL else m[1]
    return out


def _compatible() -> dict[str, str]:
    """Letters and digits in another font, ligatures and letter-like numerals, by their compatibility decompositions."""
    out = {}
    for c in map(chr, range(0x80, 0x20000)):
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        if kind == "<font>" or (kind == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or "ROMAN NUMERAL" in unicodedata.name(c, ""))):
            out[c] = unicodedata.normalize("NFKC", c)
    return out


PROTOTYPE = {c: g[0] for g in LOOKALIKES.split() for c in g[2:]} | _small_capitals()
_SPACES = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20)
_WIDE = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if chr(c) not in ZERO_WIDTH} | _compatible()
_BASE = str.maketrans({**_WIDE, **dict.fromkeys(_SPACES, " "), **dict.fromkeys(ZERO_WIDTH, "")})
_FOLD = str.maketrans(PROTOTYPE)
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter by the first word of its name: LATIN, CYRILLIC, GREEK and so on."""
    return unicodedata.name(ch, "NONE").split(" ", 1)[0]


def _variants() -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for ch, latin in PROTOTYPE.items():
        if script(ch) != "LATIN":
            out.setdefault(script(ch), {}).setdefault(ord(latin), ch)
    return out


#: By script, the letter of that script for each Latin prototype.
VARIANTS = _variants()


#: Beyond the basic plane one range stands for all of them: a pattern tests listed characters there one by one.
_TRANSLATED = re.compile("[" + "".join(re.escape(chr(c)) for c in _BASE if c < 0x10000) + "]|[\U0001d400-\U0001ffff]")
#: All look-alikes and the blocks of their scripts, Greek and Coptic to Armenian with extensions and supplements: a text
#: without any of these characters is its own fold.
_SUSPECT = re.compile("[\u0370-\u058f\u1c80-\u1c8f\u1d26-\u1d2b\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f" + "".join(PROTOTYPE) + "]")


def base_form(text: str) -> str:
    """Ordinary width and font, composed accents, no ligatures and zero-width characters, blanks for all spaces (line breaks
    and tabs stay)."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_BASE) if _TRANSLATED.search(text) else text)


def single_steps() -> tuple[dict[str, str], dict[str, str]]:
    """What ``base_form`` does to single characters, and what the fold does to letters composed with their accents."""
    fold = {}
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c)[0] == "L":
            to = unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(_FOLD))
            if to != unicodedata.normalize("NFC", c) and len(to) == 1:
                fold[c] = to
    return {chr(c): to for c, to in _BASE.items()}, fold


def _fold_token(m: re.Match) -> str:
    token = m.group()
    return token if token.isascii() else _folded(token)


@lru_cache(maxsize=1 << 16)
def _folded(token: str) -> str:
    own = {script(c) for c in unicodedata.normalize("NFD", token) if c.isalpha() and c not in _LATIN_SHAPES}
    if len(own) == 1 and (to := VARIANTS.get(own.pop())):
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(to))
    return token


_LATIN_SHAPES = set(PROTOTYPE.values())


def folded_form(text: str) -> str:
    """Base form in which look-alikes are one letter, the Latin one."""
    text = base_form(text)
    if text.isascii() or not _SUSPECT.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_FOLD))


def consistent_form(text: str) -> str:
    """The form in which two texts are equal just when they look the same.

    Look-alikes become their Latin letter; a token whose other letters are all of one other script then gets that
    script's letters. Both steps see only what the text looks like, so equal looks give equal forms whatever was typed.
    """
    folded = folded_form(text)
    return folded if folded.isascii() else _LETTERS.sub(_fold_token, folded)


@lru_cache(maxsize=1 << 16)
def repair_candidate(token: str) -> str | None:
    """For a token of mixed scripts, its spelling in its dominant script; None if it isn't mixed or can't be spelt so.

    The dominant script is that of most letters; letters that exist in one script only decide first, a tie goes to Latin.
    """
    if token.isascii():
        return None
    parts = unicodedata.normalize("NFD", token)
    letters = [c for c in parts if c.isalpha()]
    odd = [c for c in letters if c in PROTOTYPE and script(c) == "LATIN"]  # Latin letters of a foreign look, as ɑ
    scripts = [script(c) for c in letters]
    if len(set(scripts)) < 2 and not odd:
        return None
    firm = [script(c) for c in letters if c not in PROTOTYPE and c not in _LATIN_SHAPES]
    pool = firm or scripts
    dominant = max(sorted(set(pool)), key=lambda s: (pool.count(s), s == "LATIN"))
    if dominant == "LATIN":
        spelt = parts.translate(_FOLD)
    else:
        spelt = parts.translate(_FOLD).translate(VARIANTS.get(dominant, {}))
    out = unicodedata.normalize("NFC", spelt)
    return out if out != token and {script(c) for c in spelt if c.isalpha()} == {dominant} else None


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base form of each text, with its mixed-script tokens and what they may be repaired to."""
    for b in batches:
        base, mixed, repaired = [], [], []
        for text in b.column(1).to_pylist():
            form = None if text is None else base_form(text)
            pairs = {}
            if form and not form.isascii():
                for token in set(_LETTERS.findall(form)):
                    if (to := repair_candidate(token)) is not None:
                        pairs[token] = to
            base.append(form)
            mixed.append(list(pairs))
            repaired.append(list(pairs.values()))
        yield pa.RecordBatch.from_pydict(
            {"key": b.column(0), "digest": b.column(2), "base": pa.array(base, pa.string()), "mixed": pa.array(mixed, pa.list_(pa.string())), "spelt": pa.array(repaired, pa.list_(pa.string()))}
        )


def _vocabulary_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one script, once per batch."""
    for b in batches:
        seen: set[str] = set()
        for text in b.column(0).to_pylist():
            if text:
                seen.update(_LETTERS.findall(text))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w in seen if repair_candidate(w) is None], pa.string())})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        repaired, forms = [], []
        for text, olds, news in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            if text is not None and olds:
                to = dict(zip(olds, news))
                text = _LETTERS.sub(lambda m, to=to: to.get(m.group(), m.group()), text)
            repaired.append(text)
            forms.append(None if text is None else consistent_form(text))
        yield pa.RecordBatch.from_pydict(
            {"key": b.column(0), "digest": b.column(1), "repaired": pa.array(repaired, pa.string()), "form": pa.array(forms, pa.string())}
        )


def normalise(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, repaired, form) for every row.

    ``repaired``: base form with look-alikes replaced in tokens of mixed scripts where the token so spelt stands somewhere
    in the corpus. ``form``: the consistent form of that, in which texts are equal just when they look the same; it
    catches what repair leaves: words wholly in look-alikes and words the corpus has nowhere else. ``digest`` tells the
    original texts apart. The vocabulary is a distributed set: candidates meet it in a semi join, and the few repairs go
    back to their rows by key.

    A NULL text has NULL forms; an empty one stays empty; repeated rows and keys are kept; other columns are left out.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), md5_long(F.col(text)).alias("digest"))
    base = settle(
        rows.mapInArrow(_prepared, f"key {kind}, digest binary, base string, mixed array<string>, spelt array<string>"), "base"
    )
    some = base.where(F.size("mixed") > 0).select("digest", F.arrays_zip("mixed", "spelt").alias("z")).dropDuplicates(["digest"])
    wanted = some.select("digest", F.explode("z").alias("z")).select("digest", "z.mixed", "z.spelt")
    words = base.select("base").mapInArrow(_vocabulary_of, "word string").distinct()
    known = wanted.join(words, F.col("spelt") == F.col("word"), "left_semi")
    fixes = known.groupBy(F.col("digest").alias("of")).agg(F.collect_list(F.struct("mixed", "spelt")).alias("fix"))
    return (
        base.select("key", "digest", "base").join(fixes, F.col("digest") == F.col("of"), "left")
        .select("key", "digest", "base", F.col("fix.mixed").alias("mixed"), F.col("fix.spelt").alias("spelt"))
        .mapInArrow(_finished, f"key {kind}, digest binary, repaired string, form string")
    )


def look_same_pairs(forms: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, for rows of ``normalise`` with equal forms and different texts.

    Texts pair first, one row each however often they are repeated, and only pairs of different texts meet the rows that
    have them; a text that a third of all rows repeat costs no more pairs than the result has.
    """
    rows = forms.where(F.col("form").isNotNull()).select("key", "digest", md5_long(F.col("form")).alias("look"))
    texts = rows.groupBy("look", "digest").agg(F.lit(1).alias("one")).drop("one")
    left, right = texts.select(F.col("look").alias("l"), F.col("digest").alias("t1")), texts.select("look", F.col("digest").alias("t2"))
    pairs = left.join(right, (F.col("l") == F.col("look")) & (F.col("t1") < F.col("t2"))).select("t1", "t2")
    a, b = rows.select(F.col("digest").alias("da"), F.col("key").alias("ka")), rows.select(F.col("digest").alias("db"), F.col("key").alias("kb"))
    found = pairs.join(a, F.col("t1") == F.col("da")).join(b, F.col("t2") == F.col("db"))
    return found.where("ka <> kb").select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b")).distinct()
