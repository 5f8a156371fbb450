"""Alignment of two tokenizers against pair-by-pair counting with the tokenizers' own libraries."""

import random
from collections import Counter

import pytest
import sentencepiece
from outlay.llm import align as X
from outlay.llm import queries as Q
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(X.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=X.B_FILE)


def ranges(pieces):
    out, at = [], 0
    for i, data in pieces:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(sides, rows):
    a, b = sides
    letters = X._byte_letters()
    groups_of, links_of = [], []
    for _, text in rows:
        if not text:
            groups_of.append(([], [], []))
            links_of.append(Counter())
            continue
        whole = (" " + text).encode()
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
            groups_of.append(([], [], []))
            links_of.append(Counter())
            continue
        one, two = ranges(one), ranges(two)
        cuts = sorted({e for *_, e in one} & {e for *_, e in two})
        groups, links, start = [], Counter(), 0
        for cut in cuts:
            x, y = ([i for i, s, e in side if start <= s and e <= cut] for side in (one, two))
            groups.append((x, y))
            links.update((i, j) for i in x for j in y)
            start = cut
        groups_of.append((one, two, groups))
        links_of.append(links)
    count = Counter(p for links in links_of for p in links)
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, _), (one, two, groups), links in zip(rows, groups_of, links_of, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        out.append((doc_id, len(one), len(two), len(groups), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), text))
    return sorted(out, key=repr), count, best


ODD = [
    (None, None), (1, ""), (1, ""), (2, " "), (3, "   \n\t "), (4, "a  b\n\n c \t d "), (5, "</s><s> <|endoftext|> [INST] don't 'S we'll"), (6, "one▁two three"), (7, "日本語のテキスト 👍🏽 é  x\x00y\x1cz \r\n"),
    (8, "Das ist ein Donaudampfschifffahrtsgesellschaftskapitän, " * 30), (9, "é" * 400), (9, "é" * 400), (10, "ab" * 700), (11, "x y \u0085 z​ w"), (12, "�"), (13, "12345 67.89 3e10 0x1f #### $$$ !!!!"), (14, "\nstart"), (15, "tab\tsep words  "),
    (16, "long " + "q" * 100 + " word"), (17, "    def f(x):\n        return x ** 2\n"),
]


def corpus(n, seed):
    rng = random.Random(seed)
    words = "the of ing Thntble ther, über naïve çon ñoo word_2 C++ (x) — ﬁ 4th e.g. I'm\n日本 한국어 zażółć 😀".split(" ")
    return [(100 + i, rng.choice(["", " ", "\n"]) + rng.choice([" ", " ", "  "]).join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(n)]


def compare(spark, sides, rows, **how):
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS batch", "'x' AS stripe").repartition(5)
    out = X.align(spark, table, **how)
    want, count, best = brute(sides, rows)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.documents.collect()), key=repr)
    assert got == want
    assert {(r.a, r.b): (r.docs, r.is_best) for r in out.pairs().collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_against_brute_force(spark, sides):
    compare(spark, sides, ODD + corpus(120, 1), stripes=64)


def test_small_batches_and_memory(spark, sides, monkeypatch):
    rows = ODD + corpus(60, 2)
    t = X.tokenizers(X.A_FILE, X.B_FILE)
    memory = X.Memory(t)
    monkeypatch.setattr(X, "REMEMBERED", 10)
    for _, text in rows * 2:
        words = X.words_of(text or "")
        assert " ".join(words) == (text or "")
        known, at = memory.look_up(words)
        for w, k in zip(words, at.tolist(), strict=True):
            alone = X.align_words(t, [w])
            assert known.groups[k] == alone.groups[0] and known.good[k] == alone.good[0]
            assert known.links[known.first[k] : known.first[k + 1]].tolist() == alone.links.tolist()
    assert len(memory.place) < 200


def test_large_groups(sides, monkeypatch):
    t = X.tokenizers(X.A_FILE, X.B_FILE)
    words = ["é" * 50, "abc", "日本語" * 20, "word"]
    plain = X.align_words(t, words)
    monkeypatch.setattr(X, "FEW_PAIRS", 1)
    counted = X.align_words(t, words)
    assert plain.groups == counted.groups and plain.n_links.tolist() == counted.n_links.tolist()
    for k in range(len(words)):
        one, two = Counter(), Counter()
        for x, c in ((plain, one), (counted, two)):
            for p, n in zip(x.links[x.first[k] : x.first[k + 1]].tolist(), x.times[x.first[k] : x.first[k + 1]].tolist(), strict=True):
                c[p] += n
        assert one == two and sum(one.values()) == plain.n_links[k]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = X.align(spark, empty)
    assert out.documents.count() == 0 and out.pairs().count() == 0


def test_query_whole_table(spark, sides):
    import hashlib

    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in brute(sides, rows)[0]]
    got = Q.queries()["op12_align"](spark, at).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
