"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word is the bag of itself, its character n-grams and its first bytes, hashed to a fixed number of embedding rows, so that
misspelt and inflected forms never seen in training share vectors with known ones. A text is cut into segments of a few
words. The embeddings of its most toxic segments together are averaged and go through a linear softmax: so length does not dilute
slurs, and one word that only looks like one counts less than several. Embeddings and softmax are trained jointly, in numpy, on a
bounded sample of labelled rows. As everything after the lookup is linear, a trained model folds into one
number a row, which is all that the tasks need to score every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import rows, small

BUCKET_BITS, DIM, GRAMS, STARTS = 18, 8, (3, 4, 5), (6, 8)
SEGMENT, TOP = 3, 3  # words of a segment, and segments that decide
BUCKETS = 1 << BUCKET_BITS
_EDGES = b".,;:!?\"'()[]{}<>|*%$&#-_/\\"
_PRIME, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; of a word repeated on end, one is left."""
    words = text.lower().split()
    return words[:1] + [b for a, b in zip(words, words[1:], strict=False) if a != b]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, words): the embedding rows of the words, their n-grams of bytes and their starts, and the place in words that each belongs to.

    A word is taken without punctuation at its ends and stands between < and >. Each has one row at least. Starts are of
    STARTS bytes, of words with more.
    """
    bare = [b"<" + (w.strip(_EDGES) or w) + b">" for w in words]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    text = np.frombuffer(b"".join(bare), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(bare)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes from here to the word's end
    rows_ = [np.fromiter(map(zlib.crc32, bare), np.uint32, len(bare)) * _SPREAD]
    owners = [np.arange(len(bare))]
    gram = text
    for n in range(2, GRAMS[-1] + 1):
        gram = gram[:-1] * _PRIME ^ text[n - 1 :] if len(gram) > 1 else gram[:0]
        if n in GRAMS:
            keep = left[: len(gram)] >= n
            rows_.append((gram[keep] ^ np.uint32(n)) * _SPREAD)
            owners.append(owner[: len(gram)][keep])
    for n in STARTS:
        owners.append(np.flatnonzero(size > n))
        rows_.append(np.fromiter((zlib.crc32(bare[i][:n], n) for i in owners[-1].tolist()), np.uint32, len(owners[-1])) * _SPREAD)
    return (np.concatenate(rows_) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """weight of each row and bias, folded from the trained parameters; shift and scale calibrate the score."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def scores(self, texts: list[bytes], known: Known | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts, known) + self.shift, -30, 30)))

    def logits(self, texts: list[bytes], known: Known | None = None) -> np.ndarray:
        """Log odds of the most toxic segments of each text; the bias for a text without words."""
        known = known or Known(self.weight)
        words = [tokens(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(texts), self.bias)
        if n.any():
            total, count = known.look_up([w for ws in words for w in ws])
            owner = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            opens = np.flatnonzero(inside % SEGMENT == 0)
            sums, counts, of = np.add.reduceat(total, opens), np.add.reduceat(count, opens), owner[opens]
            order = np.lexsort((-sums / counts, of))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            top = order[np.arange(len(of)) - np.repeat(first, np.diff([*first, len(of)])) < TOP]
            out[n > 0] += (np.bincount(of[top], sums[top], len(n)) / np.maximum(np.bincount(of[top], counts[top], len(n)), 1))[n > 0]
        return out


class Known:
    """The sum of weights and the number of rows of each word met so far; forgets all when it has met too many."""

    def __init__(self, weight: np.ndarray, limit: int = 300_000):
        self.weight, self.limit, self.at = weight, limit, {}
        self.total, self.count = np.zeros(0), np.zeros(0)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > self.limit:
            self.at, self.total, self.count = {}, np.zeros(0), np.zeros(0)
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            rows_, owner = subwords(new)
            self.total = np.concatenate([self.total, np.bincount(owner, self.weight[rows_], len(new))])
            self.count = np.concatenate([self.count, np.bincount(owner, minlength=len(new))])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.total[at], self.count[at]


def _segment_sums(x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.arange(0, len(x), SEGMENT))


def train(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 7) -> Model:
    """Joint training: first on averages of whole texts, then each step takes the currently most toxic segments of each text of a batch.

    Embeddings start along the softmax's direction at the log odds of the texts that hold their row, so that a few
    toxic texts already point at the right segments.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(t)], np.int64) for t in texts]
    docs, y = [d for d in docs if len(d)], np.array([v for v, d in zip(labels, docs, strict=True) if len(d)], float)
    if not docs or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(y.mean() * 10 - 5) if len(y) else -5.0)
    flat, owner = subwords(list(vocab))
    order = np.argsort(owner, kind="stable")
    flat, sizes = flat[order], np.bincount(owner)
    starts = np.cumsum(sizes) - sizes
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    axis = out[:, 1] - out[:, 0]
    held = (np.concatenate([flat[starts[w] : starts[w] + sizes[w]] for w in np.unique(d)]) for d in docs)
    emb += _log_odds(held, y)[:, None] * axis / (axis**2).sum()
    seen_e, seen_o = np.full((BUCKETS, 1), 1e-6), np.full((DIM, 2), 1e-6)
    share = y.mean()
    weights = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            if lo % (batch * 16) == 0:
                part = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[flat], starts)
            at = order[lo : lo + batch]
            chosen, owner = [], []
            for k, i in enumerate(at):
                d = docs[i]
                if epoch == 0:
                    words = d
                else:
                    means = _segment_sums(part[d]) / _segment_sums(sizes[d].astype(float))
                    words = np.concatenate([d[s * SEGMENT : (s + 1) * SEGMENT] for s in np.argsort(-means, kind="stable")[:TOP].tolist()])
                rows_ = np.concatenate([flat[starts[w] : starts[w] + sizes[w]] for w in words])
                chosen.append(rows_)
                owner.append(len(rows_))
            n = np.array(owner)
            rows_, seg = np.concatenate(chosen), np.repeat(np.arange(len(at)), n)
            hidden = np.add.reduceat(emb[rows_], np.cumsum(n) - n) / n[:, None]
            z = hidden @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at].astype(int)] -= 1
            g = p * weights[at][:, None] / len(at)
            g_out = hidden.T @ g
            g_row = (g @ out.T / n[:, None])[seg]
            unique, inverse = np.unique(rows_, return_inverse=True)
            g_emb = np.zeros((len(unique), DIM))
            np.add.at(g_emb, inverse, g_row)
            seen_e[unique] += (g_emb**2).mean(axis=1, keepdims=True)
            emb[unique] -= rate * g_emb / np.sqrt(seen_e[unique])
            seen_o += g_out**2
            out -= rate * 0.2 * g_out / np.sqrt(seen_o)
            bias -= rate * 0.1 * g.sum(axis=0)
    model = Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    x = model.logits([t for t in texts if t.split()])
    model.scale, model.shift = _calibrate(x, y)
    return model


def _log_odds(held: Iterable[np.ndarray], y: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """Log of how much more often toxic texts hold an embedding row than others, with prior texts of either kind added; 0 for rows never met."""
    n, texts = np.bincount(y.astype(int), minlength=2), np.zeros((2, BUCKETS))
    for rows_, v in zip(held, y, strict=True):
        texts[int(v), np.unique(rows_)] += 1
    share = (texts + prior * n[:, None] / len(y)) / (n[:, None] + prior)
    return np.log(share[1]) - np.log(share[0])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on log odds, by Newton's method with a slight pull to zero."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (p - y) + 1e-3 * w)
    return float(w[0]), float(w[1])


def is_training(id_col: Column) -> Column:
    """Rows that training may see: CRC-32 of the id as text, modulo 3, is not 1."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 1500, other_rows: int = 3000, row_chars: int = 4000) -> Model:
    """Train on a bounded sample of labelled rows.

    The sample is of the labelled training rows (see is_training). Of label 1 the 2 * toxic_rows ids with the
    smallest hash are looked up, of label 0 the 2 * other_rows; of these, up to toxic_rows and other_rows
    are used, among the rows whose text has at most row_chars characters. Other labels, and rows with a null
    id or text, are left out. An id labelled more than once counts as toxic if any of its labels does; of several texts
    of one id the smallest is used. Empty tables give a model that scores every text alike, near 0.
    """
    seen = labels.where(F.col(label_col).isin(0, 1) & is_training(F.col(id_col)))
    seen = seen.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = [seen.where(F.col("y") == y).orderBy("h", "id").limit(2 * n) for y, n in ((1, toxic_rows), (0, other_rows))]
    text = docs.where(F.length(text_col) <= row_chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * (toxic_rows + other_rows) rows at most
    one = text.join(ids, "id").groupBy("id", "y", "h").agg(F.min("text").alias("text"))  # no more rows than ids, of row_chars at most
    found = sorted(one.collect(), key=lambda r: (r.h, r.id, r.text))
    sample = [[r for r in found if r.y == y][:n] for y, n in ((1, toxic_rows), (0, other_rows))]
    sample = sorted(sample[0] + sample[1], key=lambda r: (r.h, r.id, r.text))
    return train([r.text.encode() for r in sample], [r.y for r in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(tox_id, tox_score) of every row, with the columns of carry as c0, c1 and so on: the model's score of the whole text, from 0 to 1.

    Null and empty texts score as the model's bias; repeated rows score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    def run(batches):
        known = Known(held.value.weight)
        for batch in small(batches):
            ids, texts, out, size = [], [], [], 0
            for i, text in rows(batch, "id", "text"):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size > 1 << 20:
                    out.append(held.value.scores(texts, known))
                    texts, size = [], 0
            if texts:
                out.append(held.value.scores(texts, known))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0)), *batch.columns[2:]], ["tox_id", "tox_score", *batch.schema.names[2:]])

    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[2:])
    return taken.mapInArrow(run, "tox_id long, tox_score double" + extra)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(~is_training(F.col("tox_id")), F.lit(False))
    return out.select(F.col("tox_id").alias("doc_id"), held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.7).cast("int").alias("predicted"))
