"""Bounds of memory that hold whatever the input: what a worker remembers, and the fitted sample."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sitemill.llm import bpe, language_id
from sitemill.llm.common import tokenizer_path


def test_memory_is_bounded_by_bytes():
    kept = bpe.Memory(10_000)
    for i in range(1000):
        kept.keep(f"word {i}", b"12345678")
        assert kept.held <= 10_000 and kept[f"word {i}"] == b"12345678"
    assert len(kept) < 100
    kept.keep("x" * 2000, b"")
    assert "x" * 2000 not in kept


def test_ids_are_the_same_with_small_memories(monkeypatch):
    path, draw = tokenizer_path("word_bpe_49k.json"), random.Random(4)
    texts = [" ".join("".join(draw.choices("abcdeéß.,'!1 ", k=draw.randint(1, 30))) for _ in range(60)) for _ in range(30)] + ["same same"] * 5
    whole = bpe.WordBpe(path)
    small = bpe.WordBpe(path)
    for memory in (small.known_words, small.known_chunks, small.pairs._known):
        memory.most = 3000
    for text in texts:
        assert small.encode(text).tolist() == whole.encode(text).tolist()
    assert all(m.held <= 3000 for m in (small.known_words, small.known_chunks, small.pairs._known))


DOCS = "doc_id long, text string, lang string"


def test_every_one_of_many_languages_is_in_a_bounded_sample(spark, monkeypatch):
    """5,000 languages, one of them in a third of all rows, one with only a very long text."""
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 5000 * 400)
    rows = [(4 * i + (i % 2), f"text {i} " * 3, f"l{i % 5000}") for i in range(10_000)] + [(10**6 + i, f"hot {i}", "hot") for i in range(5000)] + [(8, "long " * 200_000, "far")]
    found = language_id.sample(spark.createDataFrame(rows, DOCS))
    by = {}
    for text, lang in found:
        by.setdefault(lang, []).append(text)
    free = {lang for i, _, lang in rows if not _held_out(i)}
    assert by.keys() == free and len(free) > 4000
    assert sum(len(t.encode()) for t, _ in found) <= 2 * 5000 * 400 and len(by["hot"]) <= language_id.SAMPLE_DOCS
    assert all(len(t) <= language_id.WINDOW_CHARS for t in by["far"])


def _held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_texts_are_sampled_whole(spark):
    rows = [(i, f"start {i} " + "x" * 5000 + f" end {i}", "en") for i in range(40)]
    found = language_id.sample(spark.createDataFrame(rows, DOCS))
    assert {t for t, _ in found} == {t for i, t, _ in rows if not _held_out(i)}
    assert language_id.sample(spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("batch", [2, 7, 2048])
def test_runs_are_pooled_alike_however_they_are_batched(monkeypatch, batch):
    net = language_id.train([("abc def " * 20, "a"), ("xyz uvw " * 20, "b"), ("éèê ôö " * 20, "c")], steps=20)
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcxyzé ", k=n)) for n in (0, 1, 95, 96, 97, 192, 1000, 5000, 3, 0)]
    monkeypatch.setattr(language_id, "BATCH_RUNS", batch)
    best, score = net.pooled(texts)
    for i, text in enumerate(texts):
        data = text.encode()
        p = [net.positions(np.frombuffer(data[k : k + 96].ljust(96, b"\0"), np.uint8)[None])[0][: len(data) - k] for k in range(0, len(data), 96)]
        mean = np.concatenate(p).mean(axis=0) if p else np.zeros(3)
        assert best[i] == mean.argmax() and abs(score[i] - mean.max()) < 1e-5


def test_what_is_used_again_outlives_what_is_not():
    """A full memory forgets what was not recalled since it was full last, not all that it held."""
    kept = bpe.Memory(10_000)
    kept.keep("often", b"ids")
    for k in range(1000):
        kept.keep(f"seldom {k}", b"ids")
        if kept.get("often") is None:
            assert kept.recall("often") == b"ids"
    assert kept.recall("seldom 1") is None
    assert kept.held <= 5000 and 104 * (len(kept) + len(kept.old)) <= 10_000


def test_short_words_are_encoded_together(monkeypatch):
    """Words that no memory holds are walked through side by side; only those beyond SHORT_WORD bytes are met one by one."""
    path, draw = tokenizer_path("word_bpe_49k.json"), random.Random(5)
    b = bpe.WordBpe(path)
    words = list({"".join(draw.choices("etaoinshrdlé漢'!1", k=draw.randint(1, 20))) for _ in range(3000)})
    one_by_one = [np.array(b.encode_word(w), "<u4").tobytes() for w in words]
    far = "thonreti" * 20
    seen = []
    monkeypatch.setattr(bpe.WordBpe, "encode_word", lambda self, w, f=bpe.WordBpe.encode_word: seen.append(w) or f(self, w))
    for together in (1 << 15, 7):
        monkeypatch.setattr(bpe, "_TOGETHER", together)
        assert bpe.WordBpe(path).encode_words(words) == one_by_one
    assert not seen
    texts = [f"{w} {far} {w}!" for w in words[:50]]
    both = bpe.WordBpe(path).encode_all(texts)
    assert set(seen) == {far} and [x.tolist() for x in both] == [b.encode(t).tolist() for t in texts]


def test_many_entries_are_kept_within_the_bound():
    kept = bpe.Memory(10_000)
    kept.keep_all({f"word {i}": b"12345678" for i in range(960)} | {"x" * 2000: b""})
    assert kept.held <= 5000 and len(kept) + len(kept.old) < 100 and kept["word 959"] == b"12345678" and "x" * 2000 not in kept
    held = len(kept)
    found = kept.recall_all({"word 959", "word 1", *list(kept.old)[:2]})
    assert len(found) == 3 and len(kept) == held + 2
