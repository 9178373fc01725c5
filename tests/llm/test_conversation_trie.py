"""The conversation tree against a tree of dictionaries, on edge cases, and with shards of few turns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitemill.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, seq string, n long, shard string"


def brute(rows):
    """Node rows, by nested dictionaries."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            node = nodes.setdefault(tuple(seq[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    for path in sorted(nodes, key=len, reverse=True):
        node, below = nodes[path], kids.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        node["leaves"] = sum(nodes[k]["leaves"] for k in below) or 1
        node["saved"] = (len(node["members"]) - 1) * words + sum(nodes[k]["saved"] for k in below)
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["members"]) if path else None
        out.append((min(node["members"]), len(path), parent, len(node["members"]), len(below), node["leaves"], node["saved"], ends))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Shared first turns, equal conversations, short, long and turnless ones, nulls, repeated rows, families without their first."""
    draw, out = random.Random(5), []
    for c in range(130):
        if c in (20, 61):
            continue
        for t in range(draw.choice([1, 2, 3, 4, 8])):
            text = draw.choice(["hi there", "hi", "", "\x0b one\x0ctwo ", None, "é ñ", f"only {c}"])
            out.append((c, draw.choice([t, t, None]), draw.choice(["user", "assistant", None]), text))
    out += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]
    out += [(300, t, "user", f"long {t}") for t in range(500)] + [(307, t, "user", f"long {t}") for t in range(400)]
    return [*out, *out[:7], (None, 0, "user", "nobody"), (10**15, 0, "user", "far")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 3, "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("turns", [trie.SHARD_TURNS, 40, 1])
def test_against_dictionaries(spark, rows, turns, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(trie, "CHUNK", trie.CHUNK if turns > 40 else 5)
    got = trie.prefix_tree(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_turnless_and_alone(spark):
    assert trie.prefix_tree(frame(spark, [])).collect() == []
    assert trie.prefix_tree(frame(spark, [(None, 1, "user", "x")])).collect() == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    for data in ([(lone, 0, "user", "x")], [(0, None, None, None)], [(0, 0, "user", "a b"), (0, 1, "assistant", "c")]):
        assert sorted(map(tuple, trie.prefix_tree(frame(spark, data)).collect()), key=str) == brute(data)
    assert len(brute([(lone, 0, "user", "x")])) == 1  # its one turn is among the first that it takes from a conversation that is not there


def test_double_array_holds_its_sequences_alone():
    draw = random.Random(1)
    seqs = sorted({tuple(draw.choices(range(50), k=draw.randint(0, 6))) for _ in range(800)} | {tuple(range(300)), (7,) * 200})
    sizes = np.array([len(s) for s in seqs])
    da = trie.DoubleArray(np.array([x for s in seqs for x in s]), np.cumsum(sizes) - sizes, sizes)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (da.check[: da.end] >= 0).sum() == len(prefixes)
    for s in draw.sample(sorted(prefixes), 300):
        node = np.array([0])
        for x in s:
            node = da.step(node, np.array([x]))
            assert node[0] > 0
        for x in range(60):
            assert (da.step(node, np.array([x]))[0] >= 0) == ((*s, x) in prefixes)
    assert da.end < 2 * len(prefixes) + 400


def test_query_and_sql(spark, tmp_path, rows):
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, trie.op13_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(con.sql(trie.ORACLE).fetchall(), key=str)
