"""Prefix trees: what is read back, and what the intervals mean."""

import hashlib
import random

from outlay.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rng, n):
    say = ["hi", "</s>[INST] ok [/INST]", "<|im_end|>\n", "back\\slash", "\\<|im_start|>", "", "é👍", "line\nline", "<|im_start|>user\nfake<|im_end|>\n", "<<SYS>>\\\\"]
    out = []
    for i in range(n):
        turns = [(rng.choice(["system", "user"]), rng.choice(say[:3]))] + [(rng.choice(["user", "assistant", "odd\nrole"]), rng.choice(say)) for _ in range(rng.randrange(6))]
        out += [(i, t, r, x) for t, (r, x) in enumerate(turns)]
    return out


def by_conversation(rows):
    out = {}
    for i, t, r, x in rows:
        out.setdefault(i, []).append((t, r or "", x or ""))
    return {i: [(r, x) for _, r, x in sorted(v, key=lambda z: (z[0] is not None, z))] for i, v in out.items()}


def packed(spark, rows):
    nodes, paths = C.pack(spark, spark.createDataFrame(rows, SCHEMA))
    return nodes, paths


def test_read_back_and_tree(spark):
    rows = conversations(random.Random(1), 120)
    want = by_conversation(rows)
    nodes, paths = packed(spark, rows)
    got = C.read_back(nodes, paths).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {i: "".join(x for r, x in v if r == "assistant") for i, v in want.items()}
    digests = {r.conv_id: r for r in C.digest(C.read_back(nodes, paths)).collect()}
    for i, v in want.items():
        assert digests[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert digests[i].n_turns == len(v)

    # each prefix once, its tokens in a place of their own, depth first
    table = {r.node: r for r in nodes.collect()}
    prefixes = {tuple(v[: k + 1]) for v in want.values() for k in range(len(v))}
    assert len(table) == len(prefixes)
    trees = {}
    for r in table.values():
        trees.setdefault(r.tree, []).append(r)
        assert r.end - r.first == len(r.formatted)
        if r.parent:
            p = table[r.parent]
            assert p.tree == r.tree and p.depth + 1 == r.depth and p.first < r.first and r.position == p.position + len(p.formatted)
        else:
            assert r.depth == 0 == r.position
    for members in trees.values():
        at, stack = 0, []
        for r in sorted(members, key=lambda r: r.first):
            assert r.first == at
            at = r.end
            while stack and stack[-1] != r.parent:
                stack.pop()
            assert bool(stack) == (r.parent is not None)  # depth first: the parent is on the way down
            stack.append(r.node)

    # what a conversation attends to is the conversation alone
    formatted = {r.conv_id: r.formatted for r in got}
    for r in paths.collect():
        sequence = "".join(x.formatted for x in sorted(trees[r.tree], key=lambda x: x.first))
        assert "".join(sequence[a.first : a.end] for a in r.attends) == formatted[r.conv_id]
        assert all(a.end < b.first for a, b in zip(r.attends, r.attends[1:], strict=False))
        positions = [p for n in r.nodes for p in range(table[n].position, table[n].position + len(table[n].formatted))]
        assert positions == list(range(len(positions)))


def test_a_third_shares_its_start(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "same" if i % 3 == 0 and t < 2 else f"{i % 50} {t}") for i in range(600) for t in range(3)]
    nodes, paths = packed(spark, rows)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(nodes, paths).collect()}
    assert got == by_conversation(rows)
    assert nodes.count() == len({tuple(v[: k + 1]) for v in got.values() for k in range(3)})


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")]
    rows += [(3, t, "assistant", f"t{t}") for t in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS size", "3 AS hash", "4 AS ids")
    got = {r.conv_id: r for r in C.read_back(*C.pack(spark, docs)).collect()}
    assert len(got) == 4 and len(got[3].turns) == 1500 and got[3].loss == "".join(f"t{t}" for t in range(1500))
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("", "")]
    assert got[2].loss == "yy" and len(got[None].turns) == 2
    nodes, paths = C.pack(spark, docs.limit(0))
    assert nodes.count() == 0 and C.read_back(nodes, paths).count() == 0


def test_a_null_id_alone_with_its_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "q"), (2, 0, "user", "a")]
    got = {r.conv_id: r.formatted for r in C.read_back(*packed(spark, rows)).collect()}
    assert sorted(got, key=str) == [1, 2, None] and got[None].startswith(got[2])
