"""Exact BPE in linear time by backtracking over longest matches, and decoding through an offset table."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sitemill.llm.common import read, tokenizer_path

#: Bytes of each of a worker's three memories: of pairs, of words, and of texts between white space. A full one is emptied.
CACHE_BYTES = 1 << 25
#: What an entry takes beside its key's and value's own bytes, about: its place in the table and, of a pair, the pair.
_ENTRY_BYTES = 104
#: Where the last byte of a word lies in the automaton's alphabet: words end in symbols of their own.
_WORD_END = 0x1000
#: Words of so many bytes at most are encoded together, step by step; longer ones one by one.
SHORT_WORD = 64
#: Words that are encoded together at most.
_TOGETHER = 1 << 15
#: Above every token's id.
_NO_TOKEN = 1 << 30

#: Unicode's white space, as the tokenizers library takes it: U+001C to U+001F are none.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_NO_SPACES = re.compile("[\\x1c-\\x1f]")
_BLANKS = re.compile(f"[{_SPACES}]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Memory(dict):
    """A dictionary of bounded bytes: where an entry does not fit into half of them any more, all entries become old ones and those that
    were old before are forgotten. An old one that is recalled is new again, so frequent ones stay; a key beyond the bound is not kept."""

    def __init__(self, most: int = CACHE_BYTES):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def keep(self, key, value) -> None:
        size = sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY_BYTES
        if size > self.most // 16:
            return
        if self.held + size > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size

    def recall(self, key):
        """The value of a key that is not among the new ones; None where it is forgotten or was never kept."""
        if (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value


    def keep_all(self, entries: dict) -> None:
        """keep() of many entries, whose sizes are added up in runs where a run fits."""
        keys, values = list(entries), list(entries.values())
        sizes = [k + v + _ENTRY_BYTES for k, v in zip(map(sys.getsizeof, keys), map(sys.getsizeof, values), strict=True)]
        for at in range(0, len(keys), 512):
            run, total = slice(at, at + 512), sum(sizes[at : at + 512])
            if self.held + total > self.most // 2 or max(sizes[run]) > self.most // 16:
                for k, v in zip(keys[run], values[run], strict=True):
                    self.keep(k, v)
            else:
                self.update(zip(keys[run], values[run], strict=True))
                self.held += total

    def recall_all(self, keys: set) -> dict:
        """The entries of those keys that are not forgotten."""
        found = {k: v for k, v in zip(keys, map(self.get, keys), strict=True) if v is not None}
        if self.old:
            rest = keys.difference(found)
            old = {k: v for k, v in zip(rest, map(self.old.get, rest), strict=True) if v is not None}
            self.keep_all(old)
            found.update(old)
        return found


class Numbers:
    """A table of numbers by number, none below 0, that is asked for many at once: open addressing in four to eight times as many slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            slot, order = (x[np.argsort(slot, kind="stable")] for x in (slot, np.arange(len(keys))))
            first = np.r_[True, slot[1:] != slot[:-1]] & (self._keys[slot] < 0)
            self._keys[slot[first]], self._values[slot[first]] = keys[order[first]], values[order[first]]
            keys, values, slot = keys[order[~first]], values[order[~first]], (slot[~first] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._values[slot], default)
        rows = np.flatnonzero((held != keys) & (held >= 0))
        while len(rows):
            slot[rows] = (slot[rows] + 1) & self._mask
            held = self._keys[slot[rows]]
            same = held == keys[rows]
            out[rows[same]] = self._values[slot[rows[same]]]
            rows = rows[~same & (held >= 0)]
        return out


class Automaton:
    """Aho and Corasick's automaton of reversed patterns. Texts are read from their ends, so that a state tells the longest pattern that
    starts at its place; many texts are read side by side, one symbol of each a step."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        """patterns: uint16 symbols below 2^13."""
        sizes = np.array([len(t) // 2 for t in patterns])
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(patterns), "<u2").astype(np.int64)
        node, levels, self._n, edges = np.zeros(len(sizes), dtype=np.int64), [], 1, []
        terminal = []
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            keys, of = np.unique(node[live] << 13 | symbols[ends[live] - 1 - depth], return_inverse=True)
            node[live] = self._n + of
            edges.append(keys)
            levels.append(np.arange(self._n, self._n + len(keys)))
            self._n += len(keys)
            whole = live[sizes[live] == depth + 1]
            terminal.append((node[whole], np.array(numbers)[whole]))
        self._next = Numbers(np.concatenate(edges), np.arange(1, self._n))
        self._fail, self._longest = np.zeros(self._n, dtype=np.int64), np.full(self._n, -1, dtype=np.int64)
        for depth, (keys, level) in enumerate(zip(edges, levels, strict=True)):
            if depth:
                self._fail[level] = self._step(self._fail[keys >> 13], keys & 0x1FFF)
            self._longest[level] = self._longest[self._fail[level]]
            self._longest[terminal[depth][0]] = terminal[depth][1]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self._next.get(state << 13 | symbol, -1)
        rows = np.flatnonzero(out < 0)
        while len(rows):
            rows = rows[state[rows] > 0]
            state[rows] = self._fail[state[rows]]
            out[rows] = self._next.get(state[rows] << 13 | symbol[rows], -1)
            rows = rows[out[rows] < 0]
        return np.maximum(out, 0)

    def longest(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest pattern that starts at each symbol of texts that lie one after another; -1 where none does."""
        sizes = np.diff(ends, prepend=0)
        order = np.argsort(-sizes, kind="stable")
        sizes, at = sizes[order], ends[order] - 1
        out, state = np.full(len(symbols), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for done in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -done))
            state = self._step(state[:n], symbols[at[:n] - done])
            out[at[:n] - done] = self._longest[state]
        return out


class PairTable:
    """Merges by rank: how each token splits, and which two tokens may stand side by side."""

    def __init__(self, merged: dict[tuple[int, int], int]):
        self.merged = merged
        self.halves = {token: pair for pair, token in merged.items()}
        self._known = Memory()
        pairs = np.array(list(merged), dtype=np.int64).reshape(-1, 2)
        tokens = np.array(list(merged.values()), dtype=np.int64)
        self._span = int(max(pairs.max(initial=0), tokens.max(initial=0))) + 1
        # The token's two halves; -1 where it has none.
        self._split = np.full((self._span, 2), -1, dtype=np.int64)
        self._split[tokens] = pairs
        self._made = Numbers(pairs[:, 0] * self._span + pairs[:, 1], tokens)

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined text gives just these two.

        The merges that made both are undone from the newest down. At each step the parts that touch the border are looked up: if
        they would have merged before the step that is undone, the border would not stand. Token ids rise with rank.
        """
        key = (left, right)
        if (known := self._known.get(key)) is None and (known := self._known.recall(key)) is None:
            known = self._border_stands(left, right)
            self._known.keep(key, known)
        return known

    def _border_stands(self, left: int, right: int) -> bool:
        newest = float("inf")
        while True:
            if self.merged.get((left, right), newest) < newest:
                return False
            # Undo the later merge of the two; of equal tokens the right one was made last.
            sides = sorted(((left, 0), (right, 1)), reverse=True)
            for token, side in sides:
                if token in self.halves:
                    newest = token + side
                    left, right = (self.halves[token][1], right) if side == 0 else (left, self.halves[token][0])
                    break
            else:
                return True


    def all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """fits() of many pairs at once: each step undoes one merge of every pair that is still open."""
        keys, of = np.unique(left * self._span + right, return_inverse=True)
        out = np.zeros(len(keys), dtype=bool)
        rows, (left, right), newest = np.arange(len(keys)), np.divmod(keys, self._span), np.full(len(keys), _NO_TOKEN)
        while len(rows):
            merged = self._made.get(left * self._span + right, _NO_TOKEN)
            inner, outer = self._split[left, 1], self._split[right, 0]
            undo_right = (outer >= 0) & ((right >= left) | (inner < 0))
            undo_left = (inner >= 0) & ~undo_right
            stands = merged >= newest
            out[rows[stands & ~undo_left & ~undo_right]] = True
            newest = np.where(undo_right, right + 1, left)
            left, right = np.where(undo_left, inner, left), np.where(undo_right, outer, right)
            going = stands & (undo_left | undo_right)
            rows, left, right, newest = rows[going], left[going], right[going], newest[going]
        return out[of]


class WordBpe:
    """A tokenizer file whose model is BPE over byte letters with an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_alphabet()
        symbol = {c: chr(b) for b, c in letters.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pairs = PairTable({(vocab[a], vocab[b]): vocab[a + b] for a, b in merges})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = ahocorasick.Automaton()
        known: dict[str, int] = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            word_end = token.endswith(self.suffix) and token != self.suffix
            chars = [symbol[c] for c in (token[: -len(self.suffix)] if word_end else token)]
            if word_end:
                chars[-1] = chr(ord(chars[-1]) + _WORD_END)
            known["".join(chars)] = i
        for text, i in known.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in known.items()}
        self.shorter = {i: next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), None) for t, i in known.items()}
        self._reversed = Automaton([t.encode("utf-16-le") for t in known], list(known.values()))
        self._lengths, self._shorter = np.zeros(max(known.values()) + 1, dtype=np.int64), np.full(max(known.values()) + 1, -1, dtype=np.int64)
        for i, n in self.length.items():
            self._lengths[i] = n
            self._shorter[i] = -1 if self.shorter[i] is None else self.shorter[i]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _SPACES))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The offset table: every token's text and a blank after it, one after another.
        names = {i: t for t, i in (vocab | self.special).items()}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.known_words, self.known_chunks = Memory(), Memory()

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        text = data[:-1].decode("latin-1") + chr(data[-1] + _WORD_END)
        n = len(text)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, token in self.automaton.iter(text):
            size = self.length[token]
            start = end + 1 - size
            if size > reach[start]:
                reach[start], longest[start] = size, token
        if reach[0] == n:
            return [longest[0]]
        tokens: list[int] = []
        open_at = [True] * (n + 1)
        at, trial, length, known = 0, longest[0], self.length, self.pairs._known.get
        while at < n:
            end = at + length[trial]
            stands = open_at[end]
            if stands and tokens and (stands := known((tokens[-1], trial))) is None:
                stands = self.pairs.fits(tokens[-1], trial)
            if stands:
                tokens.append(trial)
                at = end
                trial = longest[at] if at < n else None
            elif (less := self.shorter[trial]) is not None:
                trial = less
            else:  # nothing fits here: this place is closed, and the token before it is shortened
                open_at[at] = False
                trial = tokens.pop()
                at -= self.length[trial]
        return tokens

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as encode_word gives them: short words together, longer ones one by one."""
        data = [w.encode("utf-8") for w in words]
        out = [b""] * len(words)
        short = [k for k, d in enumerate(data) if len(d) <= SHORT_WORD]
        for k in range(0, len(short), _TOGETHER):
            part = short[k : k + _TOGETHER]
            for i, ids in zip(part, self._together([data[i] for i in part]), strict=True):
                out[i] = ids
        for k, d in enumerate(data):
            if len(d) > SHORT_WORD:
                tokens = self.encode_word(words[k])
                out[k] = struct.pack(f"<{len(tokens)}I", *tokens)
        return out

    def _together(self, data: list[bytes]) -> Iterator[bytes]:
        """The steps of encode_word, each taken for all words that are not done."""
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        symbols[ends - 1] += _WORD_END
        longest = np.append(self._reversed.longest(symbols, ends), -1)
        open_at = np.ones(len(symbols) + 1, dtype=bool)
        at = np.r_[0, ends[:-1]]
        stack = np.full((len(data), int(np.diff(ends, prepend=0).max())), -1, dtype=np.int64)
        sizes = np.zeros(len(data), dtype=np.int64)
        rows, goal, trial, depth = np.arange(len(data)), ends, longest[at], np.zeros(len(data), dtype=np.int64)
        while len(rows):
            end = at + self._lengths[trial]
            stands = open_at[end]
            met = np.flatnonzero(stands & (depth > 0))
            stands[met] = self.pairs.all_fit(stack[rows[met], depth[met] - 1], trial[met])
            less = self._shorter[trial]
            stack[rows[stands], depth[stands]] = trial[stands]
            # Where nothing fits the place is closed, and the token before it is shortened.
            back = np.flatnonzero(~stands & (less < 0))
            open_at[at[back]] = False
            depth[stands] += 1
            depth[back] -= 1
            at = np.where(stands, end, at)
            trial = np.where(stands, longest[at], less)
            trial[back] = stack[rows[back], depth[back]]
            at[back] -= self._lengths[trial[back]]
            done = at == goal
            sizes[rows[done]] = depth[done]
            rows, goal, at, trial, depth = (x[~done] for x in (rows, goal, at, trial, depth))
        ids = stack[np.arange(stack.shape[1]) < sizes[:, None]].astype("<u4").tobytes()
        bounds = np.r_[0, 4 * np.cumsum(sizes)].tolist()
        return (ids[a:b] for a, b in itertools.pairwise(bounds))

    def normalise(self, text: str) -> str:
        """White space is left as it is: no word holds any."""
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a sigma is lowered alike wherever it stands

    def _words_of(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The chunks' words one after another, and where each chunk's begin and the last one's end. No word holds a blank, so chunks are
        searched as one text wherever their words leave nothing out."""
        words = self.words.findall(" ".join(chunks))
        word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        chunk_ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        cuts = np.searchsorted(word_ends, chunk_ends) + 1
        if chunks and (len(words) < len(chunks) or cuts[-1] != len(words) or (word_ends[cuts - 1] != chunk_ends).any()):
            parts = [self.words.findall(c) for c in chunks]
            words, cuts = list(itertools.chain.from_iterable(parts)), np.cumsum([len(p) for p in parts])
        return words, [0, *cuts.tolist()]

    def _chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks that are not remembered."""
        plain = [c for c in chunks if c.isascii() and c.isalpha()]  # one word, which is remembered as a chunk
        others = list(chunks.difference(plain))
        parts, bounds = self._words_of(others)
        words = set(parts)
        own = self.known_words.recall_all(words)
        rest = words.difference(own, plain)
        own.update((w, self.known_chunks[w]) for w in rest if w in self.known_chunks)
        rest = list(rest.difference(own))
        ids = self.encode_words(plain + rest)
        out, new = dict(zip(plain, ids)), dict(zip(rest, ids[len(plain) :], strict=True))
        self.known_words.keep_all(new)
        own.update(new)
        own.update((w, out[w]) for w in words.intersection(out))
        ids = list(map(own.__getitem__, parts))  # flat, as many small lists would keep Python's collector busy
        out.update(zip(others, (b"".join(ids[a:b]) for a, b in itertools.pairwise(bounds)), strict=True))
        return out

    def _chunks_of(self, text: str) -> list[str]:
        if _NO_SPACES.search(text):  # Python parts strings at these too
            return [c for c in _BLANKS.split(text) if c]
        return text.split()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids. Words never hold white space, so what stands between it is encoded once for all texts and remembered."""
        parts = [(k, [self.special[part]] if k % 2 else self._chunks_of(self.normalise(part))) for t in texts for k, part in enumerate(self.specials.split(t))]
        known = self.known_chunks
        found = [[np.uint32(chunks[0]).tobytes()] if k % 2 else list(map(known.get, chunks)) for k, chunks in parts]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        missing = {chunks[i] for (_, chunks), places in zip(parts, gaps, strict=True) for i in places}
        own = known.recall_all(missing)  # of these texts only
        if fresh := missing.difference(own):
            new = self._chunk_ids(fresh)
            known.keep_all(new)
            own.update(new)
        out: list[list[bytes]] = []
        for (k, chunks), ids, places in zip(parts, found, gaps, strict=True):
            for i in places:
                ids[i] = own[chunks[i]]
            if k == 0:
                out.append([])
            out[-1].append(b"".join(ids))
        return [np.frombuffer(b"".join(x), dtype="<u4") for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' texts, blanks between them."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[places[:-1]].tobytes()


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


#: Ids of one row at most, so that a long text needs bounded memory beside itself.
DECODE_IDS = 1 << 18
#: Characters of the texts that are encoded together, about; a longer text is encoded alone.
ENCODE_CHARS = 1 << 20
#: Bytes of one batch that is handed on, about.
BATCH_BYTES = 1 << 23
ENCODED = "doc_id long, run long, ids array<int>, text string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of rows that follow each other, of ENCODE_CHARS characters about."""
    for batch in batches:
        doc_ids, texts, held = [], [], 0
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if texts and held + len(text) > ENCODE_CHARS:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text)
        if texts:
            yield doc_ids, texts


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids and their decoded text, in runs of DECODE_IDS ids. No shuffle.

    A document's rows follow each other by run, from 0; its ids are its runs' ids one after another, its decoded text the runs' texts
    with a blank between them. A null text is empty; an empty one has one run without ids. Repeated rows have runs of their own.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            ids = [x[2] for x in out]
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            values = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values))]
            columns.append(pa.array([x[3] for x in out], pa.binary()).cast(pa.string()))
            out, held = [], 0
            return pa.record_batch(columns, schema=_ENCODED)

        for doc_ids, texts in _stretches(batches):
            for doc_id, ids in zip(doc_ids, bpe.encode_all(texts), strict=True):
                for run, k in enumerate(range(0, len(ids) or 1, DECODE_IDS)):
                    part = ids[k : k + DECODE_IDS]
                    out.append((doc_id, run, part, bpe.decode(part)))
                    held += 4 * len(part) + len(out[-1][3])
                    if held >= BATCH_BYTES:
                        yield flush()
        yield flush()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(runs, ENCODED)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded text of encode_documents. No shuffle."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []  # now: doc_id, ids so far, and the digests of the document whose runs are read

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3].hexdigest()))

        for batch in batches:
            ids = batch.column(2)
            values, ends = ids.values.to_numpy().view("<u4"), ids.offsets.to_numpy()
            texts = batch.column(3)
            for k, (doc_id, run) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)):
                if run == 0:
                    close()
                    now = [doc_id, 0, hashlib.sha256(), hashlib.sha256()]
                part = values[ends[k] : ends[k + 1]]
                now[1] += len(part)
                now[2].update(part.tobytes())
                now[3].update(b" " if run else b"")
                now[3].update(texts[k].as_buffer())  # no copy of the text
            if done:
                yield pa.record_batch([list(c) for c in zip(*done, strict=True)], schema=_ARROW)
                done.clear()
        close()
        yield pa.record_batch([list(c) for c in zip(*done, strict=True)] if done else [[], [], [], []], schema=_ARROW)

    return encode_documents(docs, path).mapInArrow(digests, SCHEMA)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
