import random

import numpy as np

from polygate.llm import decontam

SCHEMA = "doc_id long, text string, item_id string, kind string"
ITEM = "If Alice walks 12 km each day and then Alice rests for 3 long hours, what distance does Alice cover in 7 days of such careful walking by Alice?"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))


def find(spark, docs, items):
    b = spark.createDataFrame([(i, t, "u") for i, t in items], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([(i, t, None, "x") for i, t in docs], SCHEMA)
    return {(r.doc_id, r.item_id): (r.kind, r.covered, r.first_word) for r in decontam.contaminated(spark, d, b).collect()}


def brute(text, item, numbers):
    """The best of all alignments of a text and an item."""
    d, c = decontam.Canon.of([text], numbers), decontam.Canon.of([item], numbers)
    return best_of(d, c)


def best_of(d, c):
    n, best = len(c.plain), None
    pad = lambda x: np.concatenate([np.zeros(n, x.dtype), x, np.zeros(n, x.dtype)])
    plain, loose, kinds, real = pad(d.plain), pad(d.hashes[2]), pad(d.kinds), pad(np.ones(len(d.plain), bool))
    for shift in range(1 - n, len(d.plain)) if n else ():
        at = slice(n + shift, 2 * n + shift)
        if max((plain[at] == c.plain).sum(), (loose[at] == c.hashes[2]).sum()) < min(n, decontam.WINDOW):
            continue  # not one window can agree
        said = decontam.judged(c, decontam.Canon(plain[at], kinds[at], np.empty(0)), real[at])
        if said and (best is None or said[1] > best[1]):
            best = (said[0], said[1], said[2] + shift)
    return best


def all_pairs(docs, items):
    numbers = decontam.Words()
    docs, items = ([(i, decontam.Canon.of([t], numbers)) for i, t in some] for some in (docs, items))
    return {(d, i): said for d, t in docs for i, x in items if (said := best_of(t, x))}


def kinds(found):
    return {k: v[0] for k, v in found.items()}


def test_planted_passages(spark):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(15, 50))) for i in range(30)] + [(100, ITEM), (101, None), (102, "Two words"), (103, ""), (104, "five short words of text")]
    docs = [(i, words(rng, 400)) for i in range(20)]
    docs += [(50 + i, words(rng, 30) + ". " + t.upper() + "! " + words(rng, 9)) for i, t in items[:10]]
    docs += [(80, "intro " + ITEM.replace("Alice", "Bernard").replace("12", "45").replace("km", "miles").replace("3", "5").replace("7", "9") + " outro"), (81, ITEM.replace("Alice rests", "Bob rests").replace("3", "5").replace("7", "9").replace("12", "6")), (82, None), (83, ""), (84, "five short words of text"), (None, items[3][1])]
    got = find(spark, docs, items)
    assert kinds(got) == {(50 + i, i): "exact" for i in range(10)} | {(80, 100): "template", (84, 104): "exact", (None, 3): "exact"}
    assert got == all_pairs(docs, items)


def question(rng):
    """A question made of words, numbers, names and units; and the same with other slots."""
    shape = [rng.choice(["w", "w", "w", "n", "N", "u"]) for _ in range(rng.randrange(3, 30))]
    fill = {"n": lambda: str(rng.randrange(1000)), "N": lambda: rng.choice(["Anna", "Ben", "Chloe", "Dov", "Ema"]), "u": lambda: rng.choice(["km", "kg", "hours", "miles"])}
    fixed = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) if s == "w" else "" for s in shape]
    ends = [rng.random() < 0.1 for _ in shape]
    some = fill["N"]
    def say():
        return " ".join((w or fill[s]()) + (". " if e else "") for s, w, e in zip(shape, fixed, ends))
    return say(), say, some


def test_join_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    made = [question(rng) for _ in range(40)]
    head = words(rng, 10)  # a window of it is shared by many items, but is too short for them
    long_head = words(rng, 20)
    items = [(i, t) for i, (t, _, _) in enumerate(made)] + [(100 + i, head + " " + words(rng, 25)) for i in range(12)] + [(200 + i, long_head + " " + words(rng, 9)) for i in range(12)] + [(300, items_ := "Paris is nice"), (301, items_), (302, "Kyoto")]
    docs = []
    for i, (t, again, _) in enumerate(made):
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        docs += [(10 * i, words(rng, 20) + " " + t + " " + words(rng, 5)), (10 * i + 1, again() + " " + words(rng, 9)), (10 * i + 2, " ".join(w)), (10 * i + 3, t[len(t) // 3 :] + " " + words(rng, 3))]
    docs += [(1000 + i, words(rng, 5) + " " + head + " " + words(rng, 40)) for i in range(8)] + [(1100, items[45][1]), (1101, long_head), (1102, " ".join(long_head.split()[:12])), (1103, "so Paris is nice, and Kyoto"), (1104, None), (1105, "")]
    want = all_pairs(docs, items)
    assert {v[0] for v in want.values()} == {"exact", "template"} and sum(v[0] == "template" for v in want.values()) > 5
    assert {i for d, i in want if d == 1101} == set(range(200, 212)) and not any(d in range(1000, 1008) or d == 1102 for d, _ in want)
    for hot in (64, 4, 1):
        monkeypatch.setattr(decontam, "HOT", hot)
        assert find(spark, docs, items) == want


def test_reparameterised_items_in_a_table_of_size(spark):
    rng = random.Random(9)
    names = ["Anna", "Ben", "Chloe", "Dov", "Ema", "Finn"]
    items = []
    for i in range(60):
        a, b = rng.sample(names, 2)
        items.append((i, f"Then {a} bought {rng.randrange(99)} kg of {words(rng, 4)} and gave {b} {rng.randrange(99)} of the {words(rng, 3)} so how many hours did {a} need for {rng.randrange(99)} {words(rng, 2)}?", a, b))
    docs = [(i, words(rng, rng.randrange(20, 300))) for i in range(2000)]
    for i, t, a, b in items:
        other = t.replace(a, "Xenia").replace(b, "Yuri").replace("kg", "miles")
        docs.append((5000 + i, words(rng, 40) + ", " + "".join(str(int(c) * 3 % 10) if c.isdigit() else c for c in other) + " " + words(rng, 40)))
        mixed = t.replace(a, "Xenia", 1).replace(a, "Zoe").replace(b, "Yuri")  # one name became two
        docs.append((6000 + i, words(rng, 40) + ", " + mixed))
    got = find(spark, docs, [(i, t) for i, t, _, _ in items])
    assert {d for d, _ in got if d < 5000} == set()
    assert kinds({k: v for k, v in got.items() if 5000 <= k[0] < 6000}) == {(5000 + i, i): "template" for i in range(60)}
    assert all(v[0] == "exact" for k, v in got.items() if k[0] >= 6000)  # only where plain words alone suffice


def test_repeated_rows_and_long_texts(spark):
    rng = random.Random(4)
    long = words(rng, 150_000) + " " + ITEM + " " + words(rng, 150_000)
    b = spark.createDataFrame([(1, ITEM), (1, ITEM), (1, "another text of the same item for once"), (None, ITEM), (2, ITEM)], "item_id long, text string")
    d = spark.createDataFrame([(5, "x " + ITEM, 1), (5, "x " + ITEM, 1), (None, ITEM, 1), (7, long, 1), (8, "another text of the same item for once", 1)], "doc_id long, text string, row int")
    got = sorted((r.doc_id or 0, r.item_id, r.kind, r.first_word) for r in decontam.contaminated(spark, d, b).collect())
    assert got == sorted([(5, i, "exact", 1) for i in (1, 2)] * 2 + [(0, i, "exact", 0) for i in (1, 2)] + [(7, i, "exact", 150_000) for i in (1, 2)] + [(8, 1, "exact", 0)])


def say(items, text):
    numbers = decontam.Words()
    return [(i, said[0]) for i, t in enumerate(items) if (said := brute(text, t, numbers))]


def test_slots_must_be_consistent():
    t = [ITEM]
    assert say(t, ITEM) == [(0, "exact")]
    assert say(t, ITEM.replace("Alice", "Zoe").replace("hours", "weeks").replace("12", "1.5")) == [(0, "template")]
    assert say(t, ITEM.replace("then Alice", "then Bob").replace("12", "1").replace("3", "4").replace("7", "8")) == []  # Alice can't be both
    assert say(t, "nothing of the kind here at all, really not") == []


def test_empty(spark):
    assert find(spark, [], [(1, ITEM)]) == {} and find(spark, [(1, ITEM)], []) == {} and find(spark, [(1, ITEM)], [(1, None), (2, "?!")]) == {}


def test_items_of_slots_names_and_few_words():
    items = ["What is 12 + 35 * 4?", "Convert 5 km to m.", "Add 4 kg 300 g and 2 kg 900 g.", "Anna has 12 apples. Anna gives Ben 5. How many are left?", "Name three primes", "小明有三个苹果，还剩几个？", "12 35 4 16"]
    for i, text in enumerate(items):
        assert say(items, f"some words before it, {text} And some after") == [(i, "exact")]
    assert say(items, "quiz: What is 7 + 81 * 9? Say it") == [(0, "template")]
    assert say(items, "so Convert 12 miles to yards. now") == [(1, "template")]
    assert say(items, "Add 7 lb.") == [] and say(items, "Add 1 kg 250 g and 6 kg 80 g.") == [(2, "template")]
    assert say(items, "Zoe has 9 apples. Zoe gives Tim 3. How many are left?") == [(3, "template")]
    assert say(items, "Zoe has 9 apples. Max gives Tim 3. How many are left?") == []  # Anna can't be both
    assert say(items, "Add 1 kg 250 g and 6 miles 80 g.") == [] and say(items, "name three of the primes") == [] and say(items, "7 8 9 10 11") == []
