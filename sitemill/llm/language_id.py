"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.llm.common import read

#: Bytes that the network reads in one run; longer texts are runs side by side, and every byte of them is labelled. Each run starts from
#: a state of zeros in both directions, so no context crosses its borders, which may also lie within a character.
RUN_BYTES = 96
HIDDEN = 12
#: The fitted sample: so many documents of each language at most, those of the smallest hashes, and so many bytes of all languages
#: together, an equal share of them for each. Texts are taken whole; of one that is larger than its language's share, windows of
#: WINDOW_CHARS characters are, spread evenly from its first character to its last. Every language with a labelled document is learned.
SAMPLE_DOCS, SAMPLE_BYTES, WINDOW_CHARS = 400, 1 << 25, 288
_HASHES = 1 << 40
#: Languages whose names and numbers of documents are broadcast; of more, documents are joined with them.
FEW_LANGUAGES = 100_000
#: Runs, and documents, that a worker labels at a time.
BATCH_RUNS, BATCH_DOCS = 2048, 1024
UNDETERMINED = "und"
#: The pipeline turns documents away whose pooled probability is below this; a few short words of a known language reach about 0.35.
MIN_SCORE = 0.3

_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * np.sqrt(2.0 / (shape[0] + shape[-1]))).astype(np.float32)


class Gru:
    """One direction. Gates z, r and candidate c in this order; the byte's share of each is a table row, its bias within."""

    def __init__(self, table: np.ndarray, recur: np.ndarray):
        self.table, self.recur = table, recur

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of bytes x (steps, rows); with keep also what backpropagation needs."""
        h = np.zeros((x.shape[1], self.recur.shape[0]), dtype=np.float32)
        k = h.shape[1]
        if not keep:
            return self._states(x, h), []
        states, kept = np.empty((*x.shape, k), dtype=np.float32), []
        for t in range(len(x)):
            g, u = self.table[x[t]], h @ self.recur
            gates = _sigmoid(g[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(g[:, 2 * k :] + r * u[:, 2 * k :])
            if keep:
                kept.append((h, z, r, c, u[:, 2 * k :]))
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def _states(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """As run, each gate an array of its own that is worked on in place; a sigmoid is half a tanh of half its argument, and a half."""
        k = h.shape[1]
        part = lambda w, i, by: np.ascontiguousarray(w[:, i * k : (i + 1) * k] * np.float32(by))
        (tz, tr, tc), (uz, ur, uc) = ([part(w, i, by) for i, by in enumerate((0.5, 0.5, 1.0))] for w in (self.table, self.recur))
        states, half = np.empty((*x.shape, k), dtype=np.float32), np.float32(0.5)
        for t in range(len(x)):
            at = x[t]
            r = h @ ur
            r += tr.take(at, axis=0)
            np.tanh(r, out=r)
            r *= half
            r += half
            r *= h @ uc
            r += tc.take(at, axis=0)
            np.tanh(r, out=r)
            r -= h
            z = h @ uz
            z += tz.take(at, axis=0)
            np.tanh(z, out=z)
            z *= half
            z += half
            z *= r
            h = np.add(h, z, out=states[t])
        return states

    def back(self, x: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recur from those of the states, from the last step to the first."""
        d_recur, steps = np.zeros_like(self.recur), np.empty((*x.shape, self.table.shape[1]), dtype=np.float32)
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, uc = kept[t]
            dh = dh + grad[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            steps[t] = np.concatenate((dz, dr, dc), axis=1)
            du = np.concatenate((dz, dr, dc * r), axis=1)
            d_recur += h.T @ du
            dh = dh * (1 - z) + du @ self.recur.T
        flat, d_table = x.ravel(), np.zeros_like(self.table)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order].astype(np.int16), prepend=np.int16(-1)))
        d_table[flat[order][first]] = np.add.reduceat(steps.reshape(len(flat), -1)[order], first)
        return d_table, d_recur


@dataclass
class Network:
    languages: list[str]
    weights: list[np.ndarray]  # forward table and recurrence, backward table and recurrence, output weights and bias

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, steps, languages) of each byte of x (rows, steps)."""
        return self._forward(np.ascontiguousarray(x.T), keep=False)[0].transpose(1, 0, 2)

    def _forward(self, x: np.ndarray, keep: bool) -> tuple:
        ft, fr, bt, br, wo, bo = self.weights
        ahead, kept_f = Gru(ft, fr).run(x, keep)
        behind, kept_b = Gru(bt, br).run(x[::-1], keep)
        both = np.concatenate((ahead, behind[::-1]), axis=2)
        logits = both @ wo + bo
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, kept_f, kept_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of the positions under mask, and its gradients; x and mask (steps, rows)."""
        ft, fr, bt, br, wo, bo = self.weights
        p, both, kept_f, kept_b = self._forward(x, keep=True)
        n = max(1.0, float(mask.sum()))
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, rows, label] + 1e-9) * mask).sum() / n)
        d = p.copy()
        d[:, rows, label] -= 1
        d *= (mask / n)[:, :, None]
        k = fr.shape[0]
        d_both = d @ wo.T
        gf = Gru(ft, fr).back(x, kept_f, d_both[:, :, :k])
        gb = Gru(bt, br).back(x[::-1], kept_b, d_both[::-1, :, k:])
        flat = both.reshape(-1, 2 * k)
        return loss, [*gf, *gb, flat.T @ d.reshape(len(flat), -1), d.sum(axis=(0, 1))]

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its index) and mean probability over all bytes of each text; an empty text has 0 and 0."""
        if not self.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        total, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        # Runs are laid out as they come, a full batch at a time, so that a text of any length needs no more than itself.
        runs, used, owner, n = np.zeros((BATCH_RUNS, RUN_BYTES), np.uint8), np.zeros(BATCH_RUNS, np.int64), np.zeros(BATCH_RUNS, np.int64), 0

        def label(n: int) -> None:
            p = self.positions(runs[:n])
            p *= (np.arange(RUN_BYTES) < used[:n, None])[:, :, None]
            np.add.at(total, owner[:n], p.sum(axis=1, dtype=np.float64))

        for i, text in enumerate(texts):
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            sizes[i], at = len(data), 0
            while at < len(data):
                m = min(BATCH_RUNS - n, -(-(len(data) - at) // RUN_BYTES))
                part = data[at : at + m * RUN_BYTES]
                runs[n + m - 1] = 0
                runs[n : n + m].reshape(-1)[: len(part)] = part
                used[n : n + m], owner[n : n + m] = RUN_BYTES, i
                used[n + m - 1] = len(part) - (m - 1) * RUN_BYTES
                n, at = n + m, at + len(part)
                if n == BATCH_RUNS:
                    label(n)
                    n = 0
        if n:
            label(n)
        mean = total / np.maximum(sizes, 1)[:, None]
        return mean.argmax(axis=1), np.clip(mean.max(axis=1), 0.0, 1.0)


def train(samples: list[tuple[str, str]], hidden: int | None = None, steps: int | None = None, batch: int = 128, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on windows of at most RUN_BYTES bytes; the batches take the languages in turn and draw their windows anew.

    Where they are not given, hidden states and steps grow with the number of languages.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    n_lang = len(languages)
    hidden = hidden or max(HIDDEN, 4 * math.ceil(math.log2(max(n_lang, 1))))
    steps = steps or 160 * math.ceil(max(n_lang, 1) / 16)
    by = [[t.encode("utf-8") for t, lang in samples if lang == x] for x in languages]
    table = lambda: _glorot(rng, 256, 3 * hidden)
    weights = [table(), _glorot(rng, hidden, 3 * hidden), table(), _glorot(rng, hidden, 3 * hidden), _glorot(rng, 2 * hidden, n_lang), np.zeros(n_lang, np.float32)]
    net = Network(languages, weights)
    if n_lang < 2:
        return net
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        label = rng.permutation((np.arange(batch) + (0 if n_lang <= batch else step * batch)) % n_lang)
        x, mask = np.zeros((batch, RUN_BYTES), np.uint8), np.zeros((batch, RUN_BYTES), np.float32)
        for i, k in enumerate(label):
            data = by[k][rng.integers(len(by[k]))]
            at = int(rng.integers(max(1, len(data) - RUN_BYTES // 2)))
            piece = np.frombuffer(data[at : at + RUN_BYTES], np.uint8)
            x[i, : len(piece)], mask[i, : len(piece)] = piece, 1
        _, grads = net.gradients(np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T), label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, language) of the bounded sample of labelled documents that are not held out, in a fixed order; see SAMPLE_DOCS."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = sizes.count()
    share = SAMPLE_BYTES // max(1, n_languages)
    if n_languages <= FEW_LANGUAGES:
        sizes = F.broadcast(sizes)  # so that texts are not shuffled to meet them
    # A share of each language's hashes that holds its sample many times over, so that few rows are ranked however many there are.
    hashed = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(_HASHES))
    rows = labelled.join(sizes, "lang").filter(hashed < F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.col("n")) * _HASHES)
    size, length = F.octet_length("text"), F.length("text")
    n_windows = F.greatest(F.lit(1), F.floor(F.lit(share / (4 * WINDOW_CHARS)))).cast("int")
    window = lambda k: F.substring(F.col("text"), (F.greatest(length - WINDOW_CHARS, F.lit(0)) * k / F.greatest(n_windows - 1, F.lit(1))).cast("int") + 1, F.lit(WINDOW_CHARS))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), n_windows - 1), window))
    rows = rows.select("lang", hashed.alias("h"), F.least(size, F.lit(share)).alias("size"), F.when(size <= share, F.array("text")).otherwise(spread).alias("parts"))
    first = W.partitionBy("lang").orderBy("h", "parts")
    ranked = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_DOCS)
    ranked = ranked.withColumn("before", F.sum("size").over(first.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).filter(F.col("before") < share)
    found = [(part, r["lang"]) for r in ranked.select("parts", "lang").toLocalIterator() for part in r["parts"]]
    return sorted(found, key=lambda x: (x[1], x[0]))


def fit(docs: DataFrame) -> Network:
    """Trained on the bounded sample of labelled documents that are not held out.

    Every language that has such a document is learned. Without any the network knows none.
    """
    return train(sample(docs))


SCHEMA = "doc_id long, lang_pred string, score double"


def _judge(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; und and 0 for one without letters, or where nothing was learned."""
    best, score = net.pooled([t or "" for t in texts])
    known = [bool(net.languages) and _LETTER.search(t or "") is not None for t in texts]
    return (
        [net.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known, strict=True)],
        [s if k else 0.0 for s, k in zip(score.tolist(), known, strict=True)],
    )


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: lang_pred (und where the text is null or has no letter) and score, the mean probability over all bytes.

    Repeated rows are predicted one by one; without any labelled document every prediction is und.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(k, BATCH_DOCS)
                pred, score = _judge(net, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)


def keep_known(docs: DataFrame, net: Network, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is known with a score of at least min_score, columns as they were.

    Where nothing was learned, all documents with letters stay.
    """
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(k, BATCH_DOCS)
                texts = part.column(at).to_pylist()
                if net.languages:
                    keep = [p != UNDETERMINED and s >= min_score for p, s in zip(*_judge(net, texts), strict=True)]
                else:
                    keep = [t is not None and _LETTER.search(t) is not None for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
