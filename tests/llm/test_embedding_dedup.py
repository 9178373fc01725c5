"""Embedding near-dedup against all pairs, on edge cases, and with every bound made small."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sitemill.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label string, v string, cls string, kept string"


def brute(rows, cosine=0.95):
    """(n_links, component_id) of each distinct (vec_id, vector) that can have links, over all pairs."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    keys = list(dict.fromkeys((i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and fine(v)))
    n, near = len(keys), {}
    for a in range(n):
        x = np.array(keys[a][1])
        for b in range(n):
            y = np.array(keys[b][1])
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                near.setdefault(a, set()).add(b)
    out, seen = {}, set()
    for a in range(n):
        if a in seen:
            continue
        group, queue = {a}, [a]
        while queue:
            new = near.get(queue.pop(), set()) - group
            group |= new
            queue += new
        seen |= group
        out |= {keys[g]: (len(near.get(g, ())), min(keys[k][0] for k in group)) for g in group}
    return out


def told(rows, got):
    """got as in brute, with the rows that can have no links checked on the way."""
    want = brute(rows)
    for r in got:
        key = (r["vec_id"], None if r["embedding"] is None else tuple(r["embedding"]))
        links, comp = want.get(key, (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"]) == (links, comp), key
        assert r["kept"] == (r["vec_id"] is None or comp == r["vec_id"])
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def vectors():
    """A hot group of near copies, exact copies, chains of vectors that are each near the next, two lengths, unusable vectors, repeated rows."""
    draw = np.random.default_rng(4)
    centre = draw.normal(size=12)
    rows = [(i, centre + 0.02 * draw.normal(size=12)) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(140, [2.0, 4.0, 6.0])]
    chain = [(200 + i, [np.cos(0.25 * i), np.sin(0.25 * i), 0.0, 0.0]) for i in range(12)]
    loose = [(300 + i, draw.normal(size=12)) for i in range(60)]
    odd = [(400, None), (401, []), (402, [0.0, 0.0]), (403, [float("nan"), 1.0]), (404, [None, 1.0]), (405, [float("inf"), 1.0]), (None, [1.0, 2.0, 3.0]), (7, rows[7][1]), (8, [1.0, 2.0, 3.0])]
    rows = [*rows, *chain, *loose, *odd]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 10, "MOST_BUCKET": 5}, {"BLOCK": 10, "LEADER_ROUNDS": 1}])
def test_against_all_pairs(spark, vectors, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(dedup, name, value)
    clean = [(i, v) for i, v in vectors if v is None or None not in v and not any(np.isnan(v))]
    told(clean, dedup.near_copies(frame(spark, clean)).collect())
    out = dedup.near_copies(frame(spark, vectors))
    assert out.columns == ["vec_id", "embedding", "label", "v", "cls", "n_links", "component_id", "kept"]
    odd = {r["vec_id"]: r for r in out.filter("vec_id between 400 and 405").collect()}
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, i, True) for i, r in odd.items()) and len(odd) == 6


def test_forest_asks_each_row_once(monkeypatch):
    draw = np.random.default_rng(2)
    for at_once in (3, 500):
        monkeypatch.setattr(dedup, "ROWS_AT_ONCE", at_once)
        links = draw.random((40, 40)) < 0.02
        links, asked = links | links.T | np.eye(40, dtype=bool), []
        root = dedup._forest(40, lambda rows, links=links, asked=asked: asked.extend(rows) or links[rows])
        reach = links.copy()
        for _ in range(40):
            reach = reach @ links
        assert root.tolist() == [int(np.flatnonzero(r)[0]) for r in reach] and sorted(asked) == list(range(40))


def test_empty_and_alone(spark):
    assert dedup.near_copies(frame(spark, [])).collect() == []
    told([(5, [1.0, 0.0])], dedup.near_copies(frame(spark, [(5, [1.0, 0.0])])).collect())
    assert dedup.near_copies(frame(spark, [(1, None)])).first()["kept"]


def test_tables_meet_the_recall():
    for n in (1, 1000, 10**6, 10**9):
        bits = dedup.hash_bits(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** dedup.n_tables(bits, 0.95) >= dedup.RECALL


def test_pairs_just_at_the_threshold(spark):
    """600 pairs of cosine 0.9501 in 32 dimensions, and as many of 0.9499."""
    draw, rows = np.random.default_rng(3), []
    for k, cosine in enumerate([0.9501] * 600 + [0.9499] * 600):
        a, b = draw.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (cosine * a + (1 - cosine**2) ** 0.5 * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = {r["vec_id"] for r in dedup.near_copies(df).filter("n_links > 0").collect()}
    assert len([i for i in linked if i < 1200]) >= 1198 and not [i for i in linked if i >= 1200]


def test_query_and_sql(spark, tmp_path, vectors):
    clean = list({i: (i, v) for i, v in vectors if i is not None and (v is None or None not in v)}.values())
    frame(spark, clean).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, dedup.op12_embedding_near_dedup(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in clean], "embedding": pa.array([v for _, v in clean], pa.list_(pa.float32()))}))
    assert got == sorted(con.sql(dedup.ORACLE).fetchall())
