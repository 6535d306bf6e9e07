"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib

import pytest

from roomledger.llm import prefixtrie
from roomledger.llm.queries import op13_prefix_trie

COLUMNS = prefixtrie.NODE


def plain_lists(rows):
    """conv_id: [(role, text)] from (conv_id, turn, role, text) rows."""
    def turn_id(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found.setdefault(c, []).append((turn is not None, turn or 0, role, turn_id(role, text), text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in found.items()}


def plain_branched(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(lists):
    members, ends = {}, {}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    below = {node: set() for node in members}
    for node in members:
        if node:
            below[node[:-1]].add(node)

    def saved(node):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        return own + sum(map(saved, below[node]))

    def leaves(node):
        return sum(map(leaves, below[node])) or 1

    return sorted((
        min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(below[n]), leaves(n), saved(n),
        hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
    ) for n in members)


def rows_of(frame):
    assert frame.columns == list(COLUMNS)
    return sorted(tuple(r) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def random_rows(seed, count, choices, most):
    pick = random.Random(seed)
    return [
        (c, t, pick.choice(["user", "assistant", None]), "".join(pick.choice("aé") for _ in range(pick.randint(0, choices))))
        for c in range(count) for t in range(pick.randint(1, most))
    ]


@pytest.mark.parametrize("turns", [1, 7, 60, 4096])
def test_random_conversations(spark, turns):
    rows = random_rows(turns, 250, 1, 6)
    lists = prefixtrie.branched(prefixtrie.turn_lists(table(spark, rows)))
    assert rows_of(prefixtrie.prefix_trie(lists, turns)) == plain_trie(plain_branched(plain_lists(rows)))


def test_long_common_beginning_takes_one_round(spark, monkeypatch):
    rounds = []
    burst = prefixtrie._burst
    monkeypatch.setattr(prefixtrie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(60)]
    rows += [(c, 60, "user", f"end of {c % 20}") for c in range(30)] + [(99, t, "user", f"turn {t}") for t in range(60)]
    found = rows_of(prefixtrie.prefix_trie(prefixtrie.turn_lists(table(spark, rows)), 100))
    assert found == plain_trie(plain_lists(rows))
    assert len(rounds) == 2


def test_blocks_of_copies(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(500)] + [(1000, 0, "user", "other")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert rows_of(prefixtrie.prefix_trie(prefixtrie.turn_lists(table(spark, rows)), 1)) == plain_trie(plain_lists(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_ties_and_empties(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "a", "tie"), (None, 3, "user", "nobody"),
        (2, 5, "user", ""), (3, 1, "", "ab"), (4, 1, "a", "b"), (8, 0, "user", "cut off"), (-3, 1, "user", "below"), (13, 2, "x", "y" * 100_000),
    ]
    given = table(spark, rows).selectExpr("*", "1 AS depth", "'x' AS head")
    lists = prefixtrie.branched(prefixtrie.turn_lists(given))
    plain = {c: own for c, own in plain_lists(rows).items()}
    branched = {}
    for c, own in plain.items():
        h, origin = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        branched[c] = plain.get(origin, [])[:h] + own[h:]
    assert any(not turns for turns in branched.values())
    for turns in (1, 4096):
        assert rows_of(prefixtrie.prefix_trie(lists, turns)) == plain_trie(branched)


def test_no_conversations(spark):
    empty = table(spark, [])
    assert rows_of(prefixtrie.prefix_trie(prefixtrie.branched(prefixtrie.turn_lists(empty)))) == []
    nobody = table(spark, [(None, 1, "user", "x")])
    assert rows_of(prefixtrie.prefix_trie(prefixtrie.turn_lists(nobody))) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_prefix_trie(spark, folder)) == plain_trie(plain_branched(plain_lists(rows)))
