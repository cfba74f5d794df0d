import random

import pytest

from textloom.llm import decontaminate as d

ITEM = "A train leaves Boston with 120 passengers and travels for 3 hours at 60 mph until Alice and Bob count 120 empty seats."
ITEMS = [(1, ITEM), (2, "What colour is the sky over the wide green sea today?"), (3, None), (4, "too short"), (5, "four little words here"), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]


def found(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.leaks(docs, bench, **options).collect()}


def test_reparameterised_and_inconsistent(spark):
    again = ITEM.replace("120", "75").replace("3", "8").replace("Boston", "Berlin").replace("Alice", "Carol")
    wrong = ITEM.replace("120", "75", 1)  # the same number of the item becomes two
    texts = [(1, "before this " + ITEM + " and after"), (2, "xx " + again), (3, "xx " + wrong), (4, ITEM.upper()), (5, ITEM[: len(ITEM) // 3]), (6, "a clean text about the sky and the sea and green fields today"), (7, None), (8, ""), (None, "it said: what colour is the sky over\nthe wide -- green sea | today")]
    got = found(spark, texts)
    assert {k for k in got if k[1] == 1 and k[0] in (1, 2)} == {(1, 1), (2, 1)}
    assert got[1, 1].changed_slots == 0 and got[2, 1].changed_slots >= 4
    assert (3, 1) not in got and (5, 1) not in got and (None, 2) in got
    assert not {k for k in got if k[0] in (6, 7, 8)} and not {k for k in got if k[1] in (3, 4, 6)}


def test_short_items_and_blocks(spark):
    texts = [(i, f"so {'four little words here' if i % 2 else 'four little things here'} {i}") for i in range(20)] + [(50, ITEM), (50, ITEM)]
    got = found(spark, texts)
    assert set(got) == {(i, 5) for i in range(20) if i % 2} | {(50, 1)}
    assert set(found(spark, texts, exact_hashes=3)) == set(got)
    assert not found(spark, [], ITEMS) and not found(spark, texts, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randrange(10, 40)))) for i in range(12)]
    texts = []
    for i in range(80):
        w = [word() for _ in range(r.randrange(5, 80))]
        if r.random() < 0.5:
            own = r.choice(items)[1].split()
            a = r.randrange(len(own))
            w[3:3] = own[a : a + r.randrange(1, len(own) + 1)]
        texts.append((i, " ".join(w)))
    want = set()
    for i, t in texts:
        w = t.split()
        for k, item in items:
            own = item.split()
            hit = set()
            for a in range(len(own) - 7):
                if any(w[b : b + 8] == own[a : a + 8] for b in range(len(w) - 7)):
                    hit |= set(range(a, a + 8))
            if 2 * len(hit) >= len(own):
                want.add((i, k))
    assert set(found(spark, texts, items)) == want and want


def test_clean(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "fine", "y"), (None, ITEM, "z"), (None, "good", "w"), (3, None, None)], "doc_id long, text string, source string")
    kept = d.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text is null or text in ('fine', 'good')").collect()))


def test_copies_in_other_case(spark):
    items = [(1, ITEM), (2, "El niño comió según Óscar más piñas que Ángel Núñez y después también bebió té frío."), (3, "Die Straße führt, so sagt Jürgen Müller, über schöne Brücken bis nach Österreich und Ähnliches.")]
    texts = [(10 * i + k, f"so {f(t)} end") for i, t in items for k, f in enumerate((str, str.upper, str.lower, str.title))]
    got = found(spark, texts, items)
    assert set(got) == {(10 * i + k, i) for i, _ in items for k in range(4)}
    assert all(r.covered_words == r.item_words and not r.changed_slots for r in got.values())


def test_one_slot_against_the_majority(spark):
    item = "Each of 40 boxes holds some red apples and green pears, all 40 boxes go to the market by an old truck, and when the market opens 40 people buy 12 apples each until the evening."
    texts = [(1, item), (2, item.replace("40", "41", 1)), (3, item.replace("40", "75").replace("75", "41", 1)), (4, item.replace("12", "40")), (5, item.replace("40", "41", 1).replace("40", "42", 1).replace("40", "43", 1))]
    got = found(spark, texts, [(1, item)])
    assert set(got) == {(i, 1) for i in (1, 2, 3, 4)}  # in 5 no number stands for 40 more often than the others together
    assert all(got[i, 1].covered_words < got[i, 1].item_words for i in (2, 3, 4))
    assert got[2, 1].changed_slots == got[4, 1].changed_slots == 0 and got[3, 1].changed_slots == 2


def test_rich_in_slots_and_long_runs(spark):
    r = random.Random(7)
    passage = [f"w{r.randrange(10**6)}" for _ in range(500)]
    items = [ITEMS[5], (7, " ".join(passage)), (8, "3 km 4 kg 5 m"), (9, " ".join(f"{w} 5" for w in passage[:40]))]
    other = [f"v{i}" for i in range(30)]
    texts = [(1, "so 1 2 3 4 5 6 7 8 9 10 11 12 end"), (2, "so 2 4 6 8 10 12 14 16 18 20 22 24 end"), (3, " ".join(other + passage[100:300] + other)), (4, " ".join(passage[100:119])), (5, "run 3 KM 4 kg 5 m far"), (6, "run 3 km 4 kg 6 m far"), (7, items[3][1].replace("5", "6", 1)), (8, " ".join(passage[200:220]))]
    got = found(spark, texts, items)
    assert set(got) == {(1, 6), (3, 7), (5, 8), (7, 9), (8, 7)}
    assert got[3, 7].covered_words == 200 and got[1, 6].covered_words == 12 and got[8, 7].first_word == 0


def test_numbers_word_by_word_beside_a_template(spark):
    item = "every farmer sold 7 large sacks of very fresh corn to his old neighbour 1 2 3 4 7 5 6 8"
    assert set(found(spark, [(1, item.replace("7", "9", 1))], [(1, item)])) == {(1, 1)}


def test_windows_out_of_order_are_no_run(spark):
    """13 windows of an item in reverse order, each among other words, and the same windows in order but apart, are no leak; a run of 20 words is."""
    words = [f"w{k}" for k in range(100)]
    apart = lambda places: " ".join(" ".join([f"x{p}{i}" for i in range(9)] + words[p : p + d.WINDOW]) for p in places)
    texts = [(1, apart(range(40, 27, -1))), (2, apart(range(28, 41))), (3, "so " + " ".join(words[28 : 28 + d.RUN]) + " end")]
    got = found(spark, texts, [(7, " ".join(words))])
    assert set(got) == {(3, 7)} and got[3, 7].first_word == 1 and got[3, 7].covered_words == d.RUN
