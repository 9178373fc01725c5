"""Phrase mining against a count of all n-grams, on edge cases, beyond every bound, and its filters by themselves."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitemill.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, n long, hi string"


def brute(rows, least, top=phrases.TOP):
    f, size = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            f.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(100 * b >= 80 * a for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, size[lang], -score))
    return ranked


@pytest.fixture(scope="module")
def rows():
    """Repeated phrases, ties, capitals, odd blanks, words of 5,000 characters, nulls, empties, a hot language, repeated rows."""
    draw = random.Random(6)
    words = ["New", "york", "état", "Zoë", "x", " ", "a\x00b", "x" * 5000, "日本", "the", "of"]
    out = [("en", "".join(w + draw.choice([" ", "\t", "  ", ". ", "\n", ",", ";\x0b", "!"]) for w in draw.choices(words, k=draw.randint(0, 60)))) for _ in range(60)]
    out += [("en", "in new york city today"), ("en", "In New York City, now")] * 6 + [("fr", "a b a b a b a b"), (None, "c d e f c d e f c d e f"), ("", "c d c d c d"), ("de", None), ("de", ""), (None, None)]
    return [*out, out[0], ("xx", " . ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", 1, "b") for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("bounds", [{}, {"MOST_WORDS": 0}, {"MOST_GRAMS": 0, "SHARD_GRAMS": 16, "HELD_WORDS": 3}, {"MOST_GRAMS": 12, "SHARD_GRAMS": 16}])
def test_against_all_grams(spark, rows, bounds, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 3)
    for name, value in bounds.items():
        monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(frame(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 3))


def test_first_rows_of_a_language(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 2)
    got = phrases.collocations(frame(spark, rows), top=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 5))


def test_empty(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("en", None), (None, "a b")])).collect() == []


def test_query_and_sql(spark, tmp_path, rows):
    rows = [(lang, t if t is None else t.replace("\x00", "0")) for lang, t in rows] * 6
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, phrases.op11_phrases(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"], dtype=object))
    assert got == sorted(con.sql(phrases.ORACLE).fetchall()) == sorted(brute(rows, 30)) and len(got) > 20


@pytest.mark.parametrize("half", [1, 2, 5, 17, 31, 32, 40, 62])
def test_filters_lose_nothing(half):
    draw = np.random.default_rng(half)
    a, b = draw.integers(0, 1 << half, (2, 3000), dtype=np.uint64)
    permute = phrases.Permutation(half)
    there = permute.there(a, b)
    assert all((x < 1 << half).all() for x in there) and all((x == y).all() for x, y in zip(permute.back(*there), (a, b), strict=True))
    counts = draw.choice([1, 2, 254, 255, 256, 1 << 40], 3000)
    want = Counter()
    for x, y, n in zip(*(v.tolist() for v in (*there, counts)), strict=True):
        want[x, y] += n
    p, q, n = phrases.merged(*there, counts, half)
    assert list(zip(p.tolist(), q.tolist(), strict=True)) == sorted(want)
    for top in {1, min(4, half), half} - ({half} if half > 10 else set()):
        bucket, out = (p >> np.uint64(half - top)).astype(np.int64), Counter()
        for k in np.unique(bucket).tolist():
            own = bucket == k
            data = phrases.QuotientFilter.pack(p[own], q[own], n[own], half, top)
            x, y, z = phrases.QuotientFilter.unpack(k, data)
            assert (x == p[own]).all() and (y == q[own]).all() and (z == n[own]).all()
            out.update(dict(zip(zip(x.tolist(), y.tolist(), strict=True), z.tolist(), strict=True)))
            slots = own.sum()
            assert len(data) <= 40 + slots * (2 * half / 8 + 1 + 1) + 8 * (n[own] >= 255).sum()
        assert out == want
