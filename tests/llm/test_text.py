import math
from collections import Counter

import numpy as np
import pytest

from lodevec.functions.text import python_words
from lodevec.llm import frequency, leakage, lookalike, mixture

LONG = "слово word " * 20_000


# frequency


def test_frequency(spark):
    texts = ["a1 b1 a1", None, "", "...", "b1 c1", "b1 c1", LONG, "d'e '_f_'"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, document string, term string")
    got = {r.term: (r.occurrences, r.records, r.total) for r in frequency.term_frequencies(df, "document").collect()}
    occ, rec = Counter(), Counter()
    for t in texts:
        occ.update(python_words(t))
        rec.update(set(python_words(t)))
    assert got == {w: (occ[w], rec[w], 5) for w in occ}
    assert frequency.term_frequencies(df.limit(0), "document").count() == 0


def test_identifiers_are_dense(spark):
    df = spark.createDataFrame([(f"w{i % 37} w{i % 11}",) for i in range(500)], "document string").repartition(5)
    rows = frequency.term_frequencies(df, "document").orderBy("term_id").collect()
    assert [r.term_id for r in rows] == list(range(37))
    assert [r.term for r in rows] == sorted(r.term for r in rows)


def test_blocks_flush(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(frequency, "BLOCK_TERMS", 3)
    batches = [pa.RecordBatch.from_pydict({"s": [f"a{i} b{i} c{i} common"]}) for i in range(6)]
    out = pa.Table.from_batches(list(frequency._blocks(iter(batches)))).to_pylist()
    total = Counter()
    for r in out:
        total[r["term"]] += r["rec"]
    assert total[None] == 6 and total["common"] == 6 and total["a3"] == 1


def test_verdict(spark):
    f = spark.createDataFrame([("r", 2, 5), ("c", 3, 5), ("n", 4, 10), ("edge", 5, 10)], "term string, records bigint, total bigint")
    got = {r.term: r.verdict for r in frequency.with_verdict(f).collect()}
    assert got == {"r": "rare", "c": "common", "n": None, "edge": "common"}


def test_repeated_keys_count_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "id bigint, document string")
    assert frequency.one_per_key(df, "id", "document").count() == 2


# look-alikes


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｆｕｌｌ １２．", "full 12."), ("été", "été"), ("a​b﻿", "ab"), ("a b　c d", "a b c d"), ("рaу", "pay"), ("сор", "cop"),
        ("пpoвepьтe", "проверьте"), ("Ёлка", "Ëлка"), ("mɑp", "map"), ("νектоr", "vектоr"), ("e​́", "é"),
    ],
)
def test_looks_equal(a, b):
    assert lookalike.consistent_form(a) == lookalike.consistent_form(b)


@pytest.mark.parametrize(("a", "b"), [("a b", "a  b"), ("a\nb", "a b"), ("A", "a"), ("l", "1"), ("é", "e"), ("Б", "6")])
def test_looks_different(a, b):
    assert lookalike.consistent_form(a) != lookalike.consistent_form(b)


def test_form_keeps_ordinary_text():
    for t in ("Ordinary text, naïve café.", "Обычный текст про векторы", "größe straße", "Если словарь"):
        assert lookalike.consistent_form(lookalike.consistent_form(t)) == lookalike.consistent_form(t)
    assert lookalike.consistent_form("проверьте") == "проверьте"
    assert lookalike.repair_candidate("пpoвepьтe") == "проверьте"
    assert lookalike.repair_candidate("vесtоr") == "vector"
    assert lookalike.repair_candidate("plain") is None and lookalike.repair_candidate("слово") is None


def test_normalise_and_pairs(spark):
    rows = [(1, "the vесtоr"), (2, "the vector"), (3, "the vector"), (4, None), (5, None), (6, ""), (7, "​"), (8, "qwеrtу"), (9, LONG), (10, LONG.replace("w", "ԝ")), (11, "other")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, form string")
    forms = lookalike.normalise(df, "doc_id", "text").cache()
    got = {r.key: r for r in forms.collect()}
    assert got[1].repaired == "the vector" and got[1].form == "the vector"
    assert got[8].repaired == "qwеrtу" and got[8].form == "qwerty"  # the corpus has no such word: only the form is folded
    assert got[4].form is None and got[6].form == ""
    pairs = {tuple(r) for r in lookalike.look_same_pairs(forms).collect()}
    assert pairs == {(1, 2), (1, 3), (6, 7), (9, 10)}
    assert lookalike.look_same_pairs(lookalike.normalise(df.limit(0), "doc_id", "text")).count() == 0


# leakage


def brute(docs, items, run):
    runs = {}
    for k, t in items:
        w = leakage.plain_words(t or "")
        for s in range(len(w) - run + 1):
            runs.setdefault(tuple(w[s : s + run]), set()).add(k)
    return {(d, k) for d, t in docs for w in [leakage.plain_words(t or "")] for s in range(len(w) - run + 1) for k in runs.get(tuple(w[s : s + run]), ())}


@pytest.mark.parametrize("rank", [2, 8, 64])
def test_leaks_match_brute_force_at_any_rank(spark, rank):
    import random

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 70)))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w1 " * 20)]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary + ["other", "words"], k=rng.randint(0, 150))
        if d % 3 == 0:
            src = rng.choice(items[:25])[1].split()
            s = rng.randrange(len(src))
            w[5:5] = src[s : s + rng.choice([5, 6, 7, 30])]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "ｗ１ " * 13), (503, docs[0][1]), (504, docs[0][1])]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text", run=6, rank=rank)
    assert {(r.doc, r.item) for r in got.collect()} == brute(docs, items, 6)


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert leakage.leaks(docs.limit(0), "doc_id", "text", some, "item_id", "text", run=3).count() == 0


# mixture


def counted(spark, rows):
    return spark.createDataFrame(rows, "key bigint, source string, tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int")


def test_balance(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "b", 20) for i in range(300)] + [(20_000, "c", 50), (30_000, "unplanned", 10**6), (40_000, None, 5), (50_000, "z", 0)]
    t = targets(spark, [(" A ", 1.0, 2), ("b", 1.0, 9), ("c", 1.0, 1), ("missing", 0.5, 3), ("z", 0.0, 1), (None, 1.0, 1), ("nan", math.nan, 1)])
    c = counted(spark, rows)
    solved = mixture.balance(c, t)
    by = {r.planned: r for r in solved.collect()}
    assert {s for s, r in by.items() if r.short} == {"c", "missing"}
    total = sum(n for _, s, n in rows if s in ("a", "b", "c", "z"))
    assert by["a"].wanted == pytest.approx(total / 3.5)
    mixed = mixture.mix(c, solved).collect()
    for s in ("a", "b"):
        mine = [r for r in mixed if r.source == s]
        assert sum(r.rate * r.tokens for r in mine) <= by[s].wanted * (1 + 1e-6)
        assert sum(r.copies * r.tokens for r in mine) == pytest.approx(by[s].wanted, rel=0.1)
        assert all(0 < r.copies <= by[s].cap for r in mine)
    assert [r.copies for r in mixed if r.source == "c"] == [1]
    shares = {r.source: r for r in mixture.shares(mixture.mix(c, solved), solved).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert shares["missing"].mixed_tokens == 0


def test_balance_of_nothing(spark):
    empty = counted(spark, [])
    assert [r.short for r in mixture.balance(empty, targets(spark, [("a", 1.0, 2)])).collect()] == [False]
    assert mixture.balance(counted(spark, [(1, "a", 5)]), targets(spark, [])).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, " A ", "hello world"), (2, None, None), (3, "b", "")], "key bigint, source string, text string")
    got = {r.key: (r.source, r.tokens) for r in mixture.with_tokens(df, "key", "text", "source").collect()}
    assert got == {1: ("a", 2), 2: (None, 0), 3: ("b", 0)}


def test_shares_of_the_mix_itself(spark):
    """Sources that aren't short have their share of what is mixed, though others fall short or have nothing."""
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for source, docs in (("a", 400), ("b", 300), ("c", 200), ("low", 20), ("lower", 5)):
        for _ in range(docs):
            rows.append((n, source, int(rng.integers(20, 400))))
            n += 1
    plan = [("a", 1.0, 3), ("b", 3.0, 4), ("c", 2.0, 4), ("low", 2.0, 2), ("lower", 1.0, 1), ("none", 0.5, 5)]
    c, t = counted(spark, rows), targets(spark, plan)
    solved = mixture.balance(c, t, "shares")
    mixed = mixture.mix(c, solved)
    got = {r.source: r for r in mixture.shares(mixed, solved).collect()}
    assert {s for s, r in got.items() if r.short} == {"low", "lower", "none"}
    for s in "abc":
        assert abs(got[s].actual_share / got[s].target_share - 1) < 0.01
    caps = {s: k for s, _, k in plan}
    assert all(r.copies <= caps[r.source] for r in mixed.collect())
    every = {r.source: r.mixed_tokens for r in got.values()}
    assert every["low"] == 2 * sum(t for _, s, t in rows if s == "low") and every["lower"] == sum(t for _, s, t in rows if s == "lower")
    # nothing from the short ones: shares among the others
    solved = mixture.balance(c, targets(spark, plan[:3] + plan[5:]), "shares")
    got = {r.source: r.actual_share for r in mixture.shares(mixture.mix(c, solved), solved).collect()}
    assert all(abs(got[s] - w / 6) < 0.002 for s, w in zip("abc", (1, 3, 2)))
    with pytest.raises(ValueError):
        mixture.balance(c, t, "other")


@pytest.mark.parametrize(
    ("a", "b"),
    [("𝐩𝐚𝐲𝐩𝐚𝐥", "paypal"), ("ﬁne", "fine"), ("кeep", "keep"), ("ꓐꓮꓔ", "BAT"), ("ᎪᏴ", "AB"), ("ᴄᴏꜱᴛ", "cosT"), ("Ⅻ", "XII"), ("ａ𝟙", "a1")],
)
def test_letters_of_other_tables(a, b):
    assert lookalike.consistent_form(a) == lookalike.consistent_form(b) != lookalike.consistent_form(b + "x")


def test_script_is_kept_where_it_shows():
    assert lookalike.consistent_form("привет") == "привет" and lookalike.consistent_form("скажи") == "скажи"
    assert lookalike.consistent_form("Case") != lookalike.consistent_form("case")


def test_paraphrases(spark):
    """Items with a foreign word after every few of theirs, or two clauses in another order, share no run of 12 words."""
    rng = np.random.default_rng(9)
    words = [f"name{i}" for i in range(400)] + ["the", "of", "a", "in", "keeps", "after"] * 30
    items = [(k, " ".join(rng.choice(words, 36))) for k in range(25)]
    docs, want = [], set()
    for n in range(300):
        filler = [f"filler{i}" for i in rng.integers(0, 900, 60)]
        if n < 60:
            k = n % 25
            w = items[k][1].split()
            if n % 3 == 0:
                w = w[18:] + w[:18]
            w = [x for j, y in enumerate(w) for x in ([y, f"other{n}"] if j % 6 == 5 else [y])]
            docs.append((n, " ".join(filler[:20] + w + filler[20:])))
            want.add((n, k))
        else:
            docs.append((n, " ".join(filler + list(rng.choice(words, 5)))))
    docs += [(900, None), (901, ""), (902, "word"), (None, items[3][1])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + [(77, None), (78, "")], "item_id bigint, text string")
    assert leakage.leaks(d.where("doc_id is not null"), "doc_id", "text", i, "item_id", "text").count() == 0
    rows = leakage.paraphrases(d, "doc_id", "text", i, "item_id", "text").collect()
    got = {(r.doc, r.item) for r in rows}
    assert got == want | {(None, 3)}
    assert all(r.cosine >= 0.6 and r.in_order >= 0.6 and r.answered >= 0.75 for r in rows)
    assert leakage.paraphrases(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.paraphrases(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(-1, 5, 12), rng.integers(0, 5, 9)
        t = np.zeros((13, 10), int)
        for x in range(12):
            for y in range(9):
                t[x + 1, y + 1] = t[x, y] + 1 if a[x] == b[y] else max(t[x, y + 1], t[x + 1, y])
        assert leakage.common_subsequence(a, b) == t[-1, -1]


def test_items_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b c d e f{k % 3} g h i j") for k in range(9)], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, f"c d e f{k} g h") for k in range(3)], "item_id bigint, text string")
    want = {tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", run=6).collect()}
    monkeypatch.setattr(leakage, "ITEM_CHARS", 15)
    assert want == {tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", run=6).collect()} and len(want) == 9
