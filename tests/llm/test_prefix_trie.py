"""The trie of conversation prefixes against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, level long, k1 string"


def plain(rows):
    """The nodes of (conv_id, turn, role, text) rows, as the contract words them."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - c % 5, []) if c >= 0 else own.get(c + (-c) % 5, [])
        whole = tuple(base[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda n: [x for x in members if len(x) == len(n) + 1 and x[:-1] == n]
        ids = ",".join(map(str, sorted(ends[node]))) if node in ends else ""
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    out = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed(df)))
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", (2, 3, 4096)[seed])
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-10, 60), 30):
        opening = [rnd.choice("ab") for _ in range(4)]
        for turn in range(rnd.randrange(1, 15)):
            rows.append((c, turn, rnd.choice(["user", "bot"]), opening[turn] if turn < 4 else rnd.choice(["a", "b", "éé"])))
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = [(0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, None, None, None), (1, 2, "user", ""), (1, 2, None, "x"), (2, 5, "user", "long " * 50000), (3, 1, "a:", "b"), (4, 1, "a", ":b"), (None, 1, "user", "lost"), (-3, 1, "user", "hi"), (-1, 1, "user", "hi")]
    rows += [(100, i, "user", str(i % 3)) for i in range(60)]  # one conversation with most of the rows
    rows += [(200 + i, i, "user", "same") for i in range(20)]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_query(spark, compare):
    own, other = compare(queries.queries()["op11_prefix_trie"], queries.oracle_sql()["op11_prefix_trie"], "/root/testdata/sf0.001")
    assert own == other
