"""The prefix trie against a trie built one conversation at a time."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tachygraph.llm import prefix_trie as module
from tachygraph.llm import scratch
from tachygraph.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            at = nodes.setdefault(tuple(full[:d]), {"members": [], "ends": []})
            at["members"].append(c)
        nodes[tuple(full)]["ends"].append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        below = [sums[q] for q in children.get(p, [])]
        sums[p] = (sum(a for a, _ in below) or (not below) * 1, (len(nodes[p]["members"]) - 1) * words + sum(b for _, b in below))
    out = []
    for p, n in nodes.items():
        parent = min(nodes[p[:-1]]["members"]) if p else None
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        out.append((min(n["members"]), len(p), parent, len(n["members"]), len(children.get(p, [])), *sums[p], ends))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("mid", "key", "node", "depth", "name", "at", "part", "owner", "weight")})
    got = prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def conversation(c, n, word="w", base=0):
    return [(c, base + k, "user" if k % 2 == 0 else "bot", f"{word} {k % 5} ") for k in range(n)]


ODD = [
    (None, 1, "user", "of nobody"), (0, None, None, None), (0, 2, "user", "a b"), (0, 2, "user", "a b"), (0, 2, "bot", "tie"), (0, 3, None, " \t"), (20, 5, "user", ""),
    (21, 0, "", ""), (22, 0, "user", "x"), (23, 0, "user", "x"), (24, 1, "user", "x"), (24, 2, "user", "y z"), (41, 0, "u", "base is absent"), (-3, 0, "u", "negative"), (-20, 0, "u", "negative base"),
    (-20, 1, "u", "two"), (1, 0, "u", "long " * 20_000), (2, 0, "u", "long " * 20_000), (60, 0, "u", "2:ux"), (61, 0, "u2", ":ux"),
]


def test_odd_rows(spark):
    check(spark, ODD)


def test_long_and_shared(spark):
    """Copies, common first turns, lengths around powers of two, and a conversation that holds most rows."""
    rows = []
    for c in range(40, 80):
        rows += conversation(c, c % 11, "same" if c % 3 else "other")
    for c, n in ((100, 1), (120, 15), (140, 16), (160, 17), (180, 31), (200, 33)):
        rows += conversation(c, n)
    rows += conversation(300, 700)
    check(spark, rows)


def test_small_pieces_and_no_broadcast(spark, monkeypatch):
    """The ways for large tables: pieces of few depths and ids, hot names broadcast and others shuffled."""
    monkeypatch.setattr(module, "DEPTHS", 4)
    monkeypatch.setattr(module, "ID_RANGE", 8)
    monkeypatch.setattr(module, "HOT_KEYS", 3)
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    rows = []
    for c in range(0, 60):
        rows += conversation(c, 3 + c % 9, "same" if c % 2 else "other") + ([(c, 99, "u", f"last {c % 4}")] if c % 5 else [])
    check(spark, rows + conversation(500, 40))


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(5, 1, "u", "x")]])
def test_little(spark, rows):
    check(spark, rows)
