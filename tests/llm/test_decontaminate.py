"""Decontamination against brute-force edit distance."""

import random

import numpy as np
import pytest
from outlay.llm import decontaminate as D

ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards sing about it in the rain."), (2, "Was ist der Sinn des Lebens, wenn niemand mehr nach dem Weg nach Hause fragt und alle schweigen?"), (3, "two words"), (4, "one two three four"), (5, None), (6, ""), (1, "The quick brown fox jumps over the lazy dog while seven wizards sing about it in the rain.")]
FILLER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(text):
    return D._WORD.findall(text.lower())


def closest(item, text):
    """Fewest word edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        last, row = row, [i + 1]
        for j, y in enumerate(text):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return min(row)


def documents(rng, n):
    out = []
    for i in range(n):
        text = rng.choices(FILLER, k=rng.randrange(40))
        if i % 3:
            part = words(rng.choice([t for _, t in ITEMS if t]))
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(part)) if part else 0
                part[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(FILLER)]])
            at = rng.randrange(len(text) + 1)
            text = text[:at] + part + text[at:]
        out.append((i, "  ".join(text).title() + "."))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = documents(rng, 300)
    want = {}
    for d, text in docs:
        for i, item in ITEMS:
            if item:
                edits = closest(words(item), words(text))
                if edits <= D.edits_allowed(len(words(item)), 0.2):
                    want[d, i] = edits
    rows = D.matches(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), recall=0.9999).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert got == want
    texts = dict(docs)
    for r in rows:
        part = words(texts[r.doc_id].lower()[r.first_char : r.end_char])
        assert part == words(texts[r.doc_id])[r.first_word : r.end_word]


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame(documents(random.Random(4), 60), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {tuple(r) for r in D.matches(spark, docs, items).collect()}
    many = {tuple(r) for r in D.matches(spark, docs, items, index_bytes=3 * D.WINDOW_BYTES).collect()}
    assert {r[:3] for r in one if r[2] == 0} == {r[:3] for r in many if r[2] == 0}
    assert D.clean(spark, docs, items, index_bytes=3 * D.WINDOW_BYTES).count() == 60 - len({r[0] for r in many})


def test_clean_keeps_all_columns_and_clean_rows(spark):
    rows = [(1, ITEMS[0][1], "a"), (2, "nothing here", "b"), (3, None, "c"), (4, "", "d"), (None, "x " + ITEMS[1][1], "e"), (2, "nothing here", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").selectExpr("*", "1 AS edits")
    kept = D.clean(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.item_id for r in kept.collect()) == ["b", "b", "c", "d"]


def test_items_without_an_id_count(spark):
    items = spark.createDataFrame([(None, ITEMS[0][1]), (2, ITEMS[1][1]), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + ITEMS[0][1]), (2, ITEMS[1][1]), (3, "nothing here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.matches(spark, docs, items).collect()) == [(1, None), (2, 2)]
    assert [r.doc_id for r in D.clean(spark, docs, items).collect()] == [3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    some = spark.createDataFrame([(1, "The quick brown fox")], "doc_id long, text string")
    assert D.matches(spark, none, items).count() == 0
    assert D.matches(spark, some, items.limit(0)).count() == 0
    assert D.clean(spark, some, items.limit(0)).count() == 1


def test_long_text_and_repeats(spark):
    rng = random.Random(1)
    filler = " ".join(rng.choices(FILLER, k=300_000))
    text = f"{filler} {ITEMS[0][1]} {filler} {ITEMS[0][1]} {filler}"
    got = D.matches(spark, spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.first_word) for r in got] == [(1, 1, 0, 300_000)]


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.mark.parametrize("sizes", [(8,), (30,), (100,), (300,), (5, 8, 12, 30, 60, 100, 300, 700)])
def test_recall_of_each_size(sizes):
    """At the most edits, of any kind, each size is found as often as asked for, alone and among others."""
    rng, draw = random.Random(6), np.random.default_rng(7)
    items = [(i, text_of(rng, n)) for i, n in enumerate([n for n in sizes for _ in range(60 if n == min(sizes) else 12)])]
    index = D.build(items, 0.2, 0.99, 11)
    vocabulary = list(index.vocabulary)
    for size in sizes:
        own = [i for i, s in enumerate(index.items) if len(s) == size]
        texts, want = [], []
        for n in range(240):
            i = own[n % len(own)]
            part = D._changed(index.items[i].tolist(), index.allowed[i], n % 2 == 0, len(vocabulary), draw)
            words = [vocabulary[w] if w >= 0 else "unknown" for w in part]
            texts.append(" ".join(["x"] * 30 + words + ["y"] * 30))
            want.append((n, i))
        found = {(t, i) for t, i, *_ in D.search(index, texts)}
        assert len(found & set(want)) >= 0.99 * len(want), (size, len(found & set(want)))


def test_edits_in_one_end_of_a_long_item():
    rng = random.Random(8)
    items = [(i, text_of(rng, 400)) for i in range(20)]
    index = D.build(items, 0.2, 0.99, 11)
    for half in (0, 1):
        found = 0
        for i, t in items:
            words = t.split()
            for at in rng.sample(range(200 * half, 200 * half + 200), index.allowed[i]):
                words[at] = f"w{rng.randrange(3000)}"
            found += i in {r[1] for r in D.search(index, ["x " * 20 + " ".join(words)])}
        assert found == 20


def test_letters_without_spaces():
    index = D.build([(1, "这是一个没有空格的问题请你回答它为什么")], 0.2, 0.99, 11)
    assert len(index.items[0]) == 19
    assert [(r[2], r[3]) for r in D.search(index, ["前言这是一个没有空格的问题请他回答它为什么后记"])] == [(1, 2)]


@pytest.mark.parametrize("n,rate,k", [(2, 0.2, 0), (4, 0.2, 0), (5, 0.2, 1), (6, 0.2, 1), (30, 0.2, 6), (15, 0.2, 3)])
def test_edits_allowed(n, rate, k):
    assert D.edits_allowed(n, rate) == k


def test_walks_are_those_of_single_steps():
    rng = np.random.default_rng(1)
    stream = np.append(rng.integers(0, 20, 300), D.PAD)
    walks = D.Walks(stream, 20, 3)
    walks.start(2)
    at = np.arange(len(stream))
    for step in range(40):
        assert (at - np.arange(len(stream)) == walks.moved(0, step)).all()
        at = at + walks._bit(step)[np.minimum(at, len(stream) - 1)]


def test_edit_span():
    assert D.edit_span(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (0, 1, 4)
    assert D.edit_span(np.array([1, 2, 3]), np.array([9, 1, 3, 9]))[0] == 1
    assert D.edit_span(np.array([1]), np.array([], dtype=np.int64))[0] == 1


def test_blocks_are_bounded_by_the_bytes_of_their_index(spark):
    """What is broadcast of each of several real blocks is no larger than asked for, though the text is far smaller."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([5, 5, 12, 30, 90])))) for i in range(1500)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    most = 2 << 20
    sizes, seen = [], []
    for shared, _ in D._blocks(spark, items, "item_id", "text", 0.2, 0.99, most, 11):
        index = D.pickle.loads(shared.broadcast.value)
        keys = sum(x.nbytes for p in index.parts for per in (p.keys, p.owners) for each in per for x in each)
        once = sum(x.nbytes for p in index.parts for r in p.may for k in r for x in k)
        assert len(shared.broadcast.value) <= 1.2 * (keys + once) + (1 << 20)
        sizes.append(keys)
        seen += index.item_ids
    text = sum(len(t) for _, t in rows)
    assert len(sizes) > 1 and max(sizes) <= 1.2 * most and sum(sizes) > 5 * text
    assert sorted(seen) == list(range(1500))


def test_few_places_have_their_keys_worked_out(monkeypatch):
    """Of places whose words are all the items', one in twenty of a key's at most is more than a signature."""
    rng, seen, key = random.Random(13), [], D._key
    index = D.build([(i, text_of(rng, 20)) for i in range(100)], 0.2, 0.99, 11)
    monkeypatch.setattr(D, "_key", lambda words: seen.append(len(words[0])) or key(words))
    text = " ".join(rng.choices(list(index.vocabulary), k=20_000))
    assert D.search(index, [text]) == []
    part = index.parts[0]
    assert sum(seen) <= 20_000 * part.repetitions * D.KEYS / 20


def test_walks_of_words_as_they_are_met():
    rng = np.random.default_rng(2)
    stream = np.append(rng.integers(-1, 20, 300), D.PAD)
    walks = D.Walks(stream, 20, 3)
    walks.start(2)
    samples = [[0, 3, 3], [7, 39]]
    moves = walks.moves(samples)
    at = np.arange(0, 290, 3)
    places, signatures = D._walked(D._met(20, 3, 2)[stream], at, samples, np.uint32)
    share = (D._mix(np.arange(22), 5) >> np.uint64(D.STEPS)).astype(np.uint32)
    for steps, signature in zip(samples, signatures, strict=True):
        words = walks.sampled(steps, moves, at)
        assert all((stream[np.minimum(places[s], 300)] == w).all() for s, w in zip(steps, words, strict=True))
        assert ((sum(share[w] for w in words) ^ signature) & ((1 << D.MOST) - 1) == 0).all()


def test_many_windows_have_a_wider_bit_map():
    rng = random.Random(14)
    items = [(i, text_of(rng, 400)) for i in range(300)]
    index = D.build(items, 0.2, 0.99, 11)
    assert [p.bits for p in index.parts] == [17]
    assert {r[:3] for r in D.search(index, [f"x {t} y" for _, t in items])} == {(i, i, 0) for i in range(300)}


def test_words_cut_by_a_table_are_those_of_the_pattern():
    texts = [f"a{chr(i)}B {chr(i)}{chr(i)} {chr(i)}9_" for i in range(256)] + ["", "Ça été ÀÉß µm² x", "naïve 是 ÉTÉ", "\x1c\x85\xa0a"]
    index = D.build([(n, t) for n, t in enumerate(texts)], 0.2, 0.99, 11)
    for t in [*texts, "unknown words"]:
        assert D._numbered(index, t) == [index.vocabulary.get(w, D.UNKNOWN) for w in words(t)]
