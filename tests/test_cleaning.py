import html
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import cleaning

GOOD = "We present a careful study of river stones and it shows how water moves them along the bed over many long seasons of rain. "


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("a &amp; b &lt;i&gt;c", "a & b c"),
        ("x <b>bold</b>\n\ty", "x bold y"),
        (r"we \textbf{show} \cite[1]{k} it", "we it"),
        (r"\begin{equation} body \end{equation} tail", "body tail"),
        ("cost $x$ and $a long formula$ end", "cost $x$ and end"),
        ("cafÃ© â€“ Ã¼ber â€œquoteâ€\x9d", 'café - über "quote"'),
        (" a   b", "a b"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, t.clean_text(F.col("x")), x=raw) == want


def test_words_and_stats(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab Z'-.,é5_½<>!?日\n") for _ in range(r.randrange(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.words(F.col("x")).alias("w"), F.struct(*[v.alias(k) for k, v in t.text_stats(F.col("x")).items()]).alias("s")).collect()
    for row in rows:
        x = row.x
        assert row.w == re.findall(r"\b[a-zA-Z][a-zA-Z'-]*\b", x.lower())
        assert row.s.alpha_chars == sum(c.isalpha() for c in x) and row.s.period_count == x.count(".")
        signs = [c for c in x if not c.isalnum() and not c.isspace()]
        assert row.s.punct_ratio == pytest.approx(len(signs) / len(x) if x else 0)
        assert row.s.symbol_ratio == pytest.approx(sum(c not in ".,;:!?-'\"()" for c in signs) / len(x) if x else 0)


LONG = GOOD * 2
REASONS = [
    ("N/A", "placeholder_abstract"),
    ("too short.", "too_short_chars"),
    (None, "too_short_chars"),
    ("a" * 99, "too_short_chars"),
    ("a" * 100, "too_few_words"),
    ("a. " * 25 + "1" * 60, "too_few_alphabetic_chars"),
    ("ab " * 20 + "1" * 40, "low_alphabetic_ratio"),
    ("abcdefg " * 20 + "!" * 80, "high_punctuation_ratio"),
    (GOOD * 50, "too_long_chars_possible_full_text"),
    ("a b " * 40 + "present.", "low_lexical_diversity"),
    (LONG + "=+" * 30, "formula_or_symbol_heavy"),
    (LONG.replace(".", ","), "no_period"),
    ("The small cat on a big mat by the old red door with some cold milk and a bit of fish for the dog at noon by the sea.", "no_verb_like_word"),
    (LONG + "All Rights Reserved.", "publisher_boilerplate"),
    (LONG + "See references.", "reference_like_content"),
    ("[12] " + LONG, "reference_like_content"),
    (LONG + "a > b > c > d", "remaining_markup_corruption"),
    (LONG + " ".join("abcdefghijklmnopqrstuvwxyzzyxwvu"), "many_single_letter_formula_fragments"),
    (LONG, ""),
]


def test_one_text_for_each_reason(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(REASONS)], "doc_id long, text string")
    got = {r.doc_id: r.removal_reason for r in cleaning.classify(rows).collect()}
    assert [got[i] for i in range(len(REASONS))] == [w for _, w in REASONS]


def test_bounds(spark):
    stats = {k: F.lit(v) for k, v in {"clean_length": 5000, "word_count": 20, "alpha_chars": 30, "alpha_ratio": 0.51, "punct_ratio": 0.29, "lexical_diversity": 0.2, "symbol_ratio": 0.15, "period_count": 1}.items()}
    df = spark.createDataFrame([("it is",)], "x string")
    reason = lambda **more: df.select(cleaning.removal_reason(F.col("x"), stats=stats | {k: F.lit(v) for k, v in more.items()})).first()[0]
    assert reason() == "" and reason(alpha_ratio=0.5) == "low_alphabetic_ratio" and reason(punct_ratio=0.3) == "high_punctuation_ratio"
    assert reason(clean_length=5001).startswith("too_long_chars") and reason(clean_length=99) == "too_short_chars" and reason(lexical_diversity=0.19) == "low_lexical_diversity"
    assert reason(symbol_ratio=0.151) == "formula_or_symbol_heavy"


def greedy(rows):
    kept, dropped = {}, []
    for i, x in sorted(rows):
        form = " ".join(re.sub(r"[^a-z0-9\s]", " ", x.lower()).split())
        own = kept.setdefault(form[:120], [])
        if any(SequenceMatcher(None, form, k).ratio() >= 0.95 for k in own):
            dropped.append(i)
        else:
            own.append(form)
    return dropped


def test_near_duplicates_are_greedy_in_order(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["river", "stone", "water", "green", "moves"]) + str(r.randrange(99)) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(25, 60)] = "other" + str(r.randrange(99))
        rows.append((i, " ".join(w)))
    rows.append((99, "x" + rows[0][1]))  # another prefix: never compared
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").repartition(5)
    assert sorted(x[0] for x in cleaning.near_duplicates(df).collect()) == greedy(rows)


def test_clean_keeps_every_row_once(spark):
    rows = [(i, x) for i, (x, _) in enumerate(REASONS)] + [(50, LONG.upper()), (51, LONG + "And it was more."), (52, html.escape(LONG))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, removed = cleaning.clean(df)
    a, b = {x.doc_id for x in kept.collect()}, {x.doc_id: x.removal_reason for x in removed.collect()}
    assert not a & set(b) and len(a) + len(b) == len(rows)
    assert b[50] == cleaning.EXACT and b[52] == cleaning.EXACT and 18 in a


def test_join_takes_the_first_right_row(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, has_doi string")
    right = spark.createDataFrame([(1, 5, 0), (1, 4, 1), (2, 9, 2), (2, 8, 1)], "k long, has_doi int, at int")
    got = {r.k: r.has_doi for r in cleaning.left_join_first(left, right, "k", ["at"]).collect()}
    assert got == {1: 5, 2: 8, 3: None}


def test_likeness_is_that_of_sequence_matcher():
    """Places that are looked at alone give SequenceMatcher's ratio, popular characters and early ends included."""
    r = random.Random(4)
    near = 0
    for _ in range(1500):
        size, letters = r.choice([0, 1, 6, 90, 199, 200, 201, 700]), r.choice(["ab", "abcdefghij klmnopqrstuvwxyz", "eeeeeettttaaaa xzq019"])
        a = "".join(r.choice(letters) for _ in range(size))
        b = list(a)
        for _ in range(r.choice([0, 1, 3, 12])):
            b.insert(r.randrange(len(b) + 1), r.choice(letters)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        b = "".join(b)
        ratio = SequenceMatcher(None, a, b).ratio()
        near += 0.5 < ratio < 1
        for limit in (0.5, 0.95, ratio, ratio + 1e-12):
            assert cleaning._Known(b, cleaning._places(b)).like(a, cleaning._places(a), limit) == (ratio >= limit)
    assert near > 500


def test_prefixes_are_decided_in_many_tasks(spark, monkeypatch):
    """A few kilobytes of texts take long to compare; adaptive execution has them in one task unless they are dealt."""
    start = "a beginning that two texts share {} and that is longer than the prefix of a hundred and twenty characters by which texts meet in one group of "
    df = spark.createDataFrame([(i, start.format(i // 2) + f" ends with {i}" * 9) for i in range(80)], "doc_id long, clean_text string")
    df = df.withColumn("clean_text", F.concat(F.expr("string(doc_id div 2)"), "clean_text"))
    seen = []

    def settled(rows, tag, settle=cleaning.settle):
        out = settle(rows, tag)
        if tag == "decided":
            seen.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(cleaning, "settle", settled)
    cleaning.near_duplicates(df).count()
    assert seen[0] > 1
