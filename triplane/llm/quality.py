"""Quality: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters run over each chunk, each
filter's largest answer in the chunk is kept (max pooling), chunks are combined by their mean and their maximum, and
one logistic unit gives the probability. Trained by gradient descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import first_by_hash, held_out, per_text

#: Bounds on training alone: labelled rows, and the bytes of their texts; the row that passes the second is the last. Each is taken whole.
TRAIN_ROWS, TRAIN_BYTES = 3_000, 64_000_000
CHUNK, OVERLAP, EMBED, WIDTH, STRIDE, FILTERS = 512, 32, 6, 12, 2, 32
#: Least steps of training.
STEPS = 200
#: Windows that one matrix product takes at once.
ROWS_AT_ONCE = 256


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks of byte codes 1..256, padded with 0; one chunk of zeros for an empty text."""
    n, step = len(data), CHUNK - OVERLAP
    k = max(1, -(-(n - OVERLAP) // step)) if n else 1
    flat = np.zeros((k - 1) * step + CHUNK, np.int16)
    flat[:n] = np.frombuffer(data, np.uint8)
    flat[:n] += 1
    return np.lib.stride_tricks.as_strided(flat, (k, CHUNK), (flat.strides[0] * step, flat.strides[0]))


@dataclass
class ByteCnn:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    shift: float

    @classmethod
    def start(cls, seed: int = 3) -> ByteCnn:
        r = np.random.default_rng(seed)
        w = lambda *s, f: (r.standard_normal(s) * f).astype(np.float32)
        return cls(w(257, EMBED, f=0.5), w(WIDTH * EMBED, FILTERS, f=0.12), np.zeros(FILTERS, np.float32), w(2 * FILTERS, f=0.1), 0.0)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded windows: chunks x places x (WIDTH * EMBED)."""
        e = np.take(self.embed, chunks, axis=0).reshape(len(chunks), -1)
        places = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(e, (len(chunks), places, WIDTH * EMBED), (e.strides[0], STRIDE * EMBED * e.itemsize, e.itemsize))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer in each chunk, and its place."""
        best, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for lo in range(0, len(chunks), ROWS_AT_ONCE):
            part = slice(lo, lo + ROWS_AT_ONCE)
            answers = self.windows(chunks[part]).reshape(-1, WIDTH * EMBED) @ self.filters
            answers = answers.reshape(len(chunks[part]), -1, FILTERS)
            at[part] = answers.argmax(1)
            best[part] = np.take_along_axis(answers, at[part][:, None, :], 1)[:, 0] + self.bias
        return best, at

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        """Pooled answers of chunks, without their places."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for lo in range(0, len(chunks), ROWS_AT_ONCE):
            part = chunks[lo : lo + ROWS_AT_ONCE]
            got = self.windows(part).reshape(-1, WIDTH * EMBED) @ self.filters
            out[lo : lo + len(part)] = got.reshape(len(part), -1, FILTERS).max(1) + self.bias
        return np.maximum(out, 0)

    def probability(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of each document; ``starts`` are the first chunks of the documents."""
        sizes = np.diff(np.r_[starts, len(pooled)])[:, None]
        both = np.concatenate([np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts)], 1)
        return 1 / (1 + np.exp(-np.clip(both @ self.head + self.shift, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        parts = [chunks_of(t.encode()) for t in texts]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        return self.probability(np.concatenate([self.answers(p) for p in parts]), starts)

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 5, steps: int = STEPS) -> ByteCnn:
        """Adam on the log loss; each document is an array of chunks. Few documents are seen more often, for ``steps`` steps at least."""
        epochs = max(epochs, -(-steps * batch // len(docs)))
        r, names = np.random.default_rng(seed), ("embed", "filters", "bias", "head")
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        v = {n: np.zeros_like(getattr(self, n)) for n in names}
        self.shift, t, places = float(np.log(y.mean() / (1 - y.mean()))), 0, (CHUNK - WIDTH) // STRIDE + 1
        for epoch in range(epochs):
            order, speed = r.permutation(len(docs)), rate * (1 - epoch / epochs)
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                chunks = np.concatenate([docs[i] for i in pick])
                sizes = np.array([len(docs[i]) for i in pick])
                starts, owner = np.cumsum(np.r_[0, sizes])[:-1], np.repeat(np.arange(len(pick)), sizes)
                best, at = self.pooled(chunks)
                act = np.maximum(best, 0)
                mean, top = np.add.reduceat(act, starts) / sizes[:, None], np.maximum.reduceat(act, starts)
                both = np.concatenate([mean, top], 1)
                p = 1 / (1 + np.exp(-np.clip(both @ self.head + self.shift, -30, 30)))
                d = ((p - y[pick]) / len(pick)).astype(np.float32)
                g_head, g_both = both.T @ d + 1e-4 * self.head, d[:, None] * self.head
                g_act = g_both[owner, :FILTERS] / sizes[owner, None] + g_both[owner, FILTERS:] * (act == top[owner])
                g_act *= best > 0
                g_filters, g_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
                for first in range(0, len(chunks), ROWS_AT_ONCE):
                    part = slice(first, first + ROWS_AT_ONCE)
                    row, filt = np.nonzero(g_act[part])
                    g, place = g_act[part][row, filt], at[part][row, filt]
                    x = self.windows(chunks[part])[row, place]
                    for k in range(FILTERS):
                        mine = filt == k
                        g_filters[:, k] += g[mine] @ x[mine]
                    g_x = (g[:, None] * self.filters.T[filt]).reshape(-1, EMBED)
                    codes = chunks[part][row[:, None], STRIDE * place[:, None] + np.arange(WIDTH)].ravel()
                    g_embed += np.stack([np.bincount(codes, g_x[:, j], 257) for j in range(EMBED)], 1).astype(np.float32)
                t += 1
                for n, grad in (("embed", g_embed), ("filters", g_filters), ("bias", g_act.sum(0)), ("head", g_head)):
                    m[n] = 0.9 * m[n] + 0.1 * grad
                    v[n] = 0.999 * v[n] + 0.001 * grad**2
                    step = speed * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(np.float32))
                self.shift -= 0.5 * speed * float(d.sum()) * len(pick) ** 0.5
        return self


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ByteCnn | float:
    """A network, or the share of label 1 where labels have one class (0 with none).

    The sample: at most ``train_rows`` labelled rows that are not held out, by a hash of ids over the whole table, each with
    all chunks of its text; fewer rows where their texts pass TRAIN_BYTES. Where several labels name a document, the largest holds.
    """
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    usable = first_by_hash(usable, train_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")  # at most train_rows small rows

    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most train_rows rows
    sample = sample.withColumn("_before", F.coalesce(F.sum(F.octet_length("text")).over(upto), F.lit(0))).filter(F.col("_before") < TRAIN_BYTES)
    rows = sorted((r.doc_id, r.text, r.y) for r in sample.select("doc_id", "text", "y").collect())
    y = np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return ByteCnn.start().train([chunks_of(r[1].encode()) for r in rows], y)


def score(docs: DataFrame, model: ByteCnn | float, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the score of each row's whole text."""
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few ten thousand numbers

    def setup():
        return lambda texts: (sent.value.score(texts).astype(float).tolist(),)

    return per_text(docs, "text", keep, setup, "score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.3): one row per row of ``docs``.

    Null and empty texts are scored as one empty chunk; repeated rows each get a row; other columns are ignored; an
    empty table gives an empty result.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
