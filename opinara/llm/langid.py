"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample
of byte windows.  Reading a document, it labels every byte position; the document's
probabilities are the mean over all its positions.  Texts are cut into windows only
so that many of them advance together; every byte of a text is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = 8
WINDOW = 96
LANES = 2048  # windows that advance together


def squash(x: np.ndarray) -> np.ndarray:
    """A rational tanh, in place: exact at 0 and +-3, within 0.025 elsewhere."""
    np.clip(x, -3.0, 3.0, out=x)
    s = x * x
    x *= s + 27.0
    s *= 9.0
    s += 27.0
    x /= s
    return x


def gate(x: np.ndarray) -> np.ndarray:
    """The logistic function by way of :func:`squash`, in place."""
    x *= 0.5
    squash(x)
    x *= 0.5
    x += 0.5
    return x


class Reader:
    """One direction of the network: ``x`` (3h, 256) holds each byte's gate inputs,
    ``u`` (3h, h) the recurrent weights; rows are update, reset and candidate."""

    def __init__(self, x: np.ndarray, u: np.ndarray):
        self.x, self.u, self.h = x, u, u.shape[1]

    def step(self, state: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = self.h
        a, b = np.take(self.x, codes, axis=1), self.u @ state
        a[:2 * h] += b[:2 * h]
        zr = gate(a[:2 * h])
        z, r, back, n = zr[:h], zr[h:], b[2 * h:], a[2 * h:]
        n += r * back
        squash(n)
        new = state - n
        new *= z
        new += n
        if keep is not None:
            keep.append((state, z, r, back, n))
        return new

    def unroll(self, dstates: np.ndarray, codes: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``x`` and ``u`` from those of the states, in the order read."""
        h, du = self.h, np.zeros_like(self.u)
        dx = np.empty((len(kept), 3 * h, codes.shape[1]), np.float32)
        carry = np.zeros_like(dstates[0])
        for t in range(len(kept) - 1, -1, -1):
            state, z, r, back, n = kept[t]
            d = dstates[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * back * r * (1 - r)
            rec = np.concatenate([dz, dr, dn * r])
            dx[t, :h], dx[t, h:2 * h], dx[t, 2 * h:] = dz, dr, dn
            du += rec @ state.T
            carry = d * z + self.u.T @ rec
        flat = codes.ravel()
        return np.stack([np.bincount(flat, dx[:, i].ravel(), 256) for i in range(3 * h)]).astype(np.float32), du


class Model:
    """Languages and the weights of both directions and of the position classifier."""

    def __init__(self, langs: list[str], weights: list[np.ndarray]):
        self.langs, self.weights = langs, weights

    def readers(self):
        xf, uf, xb, ub, wo, bo = self.weights
        return Reader(xf, uf), Reader(xb, ub), wo, bo

    def window_sums(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sums over positions of the label probabilities: (windows, langs)."""
        ahead, behind, wo, bo = self.readers()
        out = np.zeros((len(codes), len(self.langs)))
        for at in range(0, len(codes), LANES):
            c, m = codes[at:at + LANES].T, mask[at:at + LANES].T
            steps = int(m.any(axis=1).sum())
            state, left = np.zeros((ahead.h, c.shape[1]), np.float32), []
            for t in range(steps):
                state = ahead.step(state, c[t])
                left.append(state)
            state, total = np.zeros_like(left[0]), np.zeros((len(self.langs), c.shape[1]), np.float32)
            for t in range(steps - 1, -1, -1):
                state = behind.step(state, c[t])
                state *= m[t]  # padding behind a text's end leaves no trace
                p = wo @ np.concatenate([left[t], state]) + bo
                np.exp(p, out=p)
                p *= m[t] / p.sum(axis=0)
                total += p
            out[at:at + LANES] = total.T
        return out

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for texts without a letter."""
        pieces = [t.encode("utf-8", "replace") if t and any(map(str.isalpha, t)) else b"" for t in texts]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return pred, score
        at = 0
        while at < len(pieces):  # about a megabyte of text at a time, or one long document
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) < 1 << 20):
                size += len(pieces[end])
                end += 1
            sums = self._pooled(pieces[at:end])
            for i, s in enumerate(sums, at):
                if pieces[i]:
                    pred[i], score[i] = self.langs[int(s.argmax())], min(1.0, float(s.max() / s.sum()))
            at = end
        return pred, score

    def _pooled(self, pieces: list[bytes]) -> np.ndarray:
        sizes = np.array([-(-len(p) // WINDOW) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(n * WINDOW, b"\0") for p, n in zip(pieces, sizes)), np.uint8)
        mask = np.frombuffer(b"".join((b"\1" * len(p)).ljust(n * WINDOW, b"\0") for p, n in zip(pieces, sizes)), np.uint8)
        sums = np.zeros((len(pieces), len(self.langs)))
        if len(data):
            full = self.window_sums(data.reshape(-1, WINDOW), mask.reshape(-1, WINDOW).astype(np.float32))
            np.add.at(sums, np.repeat(np.arange(len(pieces)), sizes), full)
        return sums


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 240, batch: int = 384,
          rate: float = 0.02, seed: int = 7) -> Model:
    """Fit a model to byte windows by Adam on the cross entropy of every position."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    new = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
    h3 = 3 * hidden
    model = Model(langs, [new(h3, 256), new(h3, hidden), new(h3, 256), new(h3, hidden), new(len(langs), 2 * hidden),
                          np.zeros((len(langs), 1), np.float32)])
    if len(langs) < 2:
        return model
    codes = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0")[:WINDOW] for w in windows), np.uint8).reshape(-1, WINDOW)
    mask = (np.arange(WINDOW)[None, :] < np.array([len(w) for w in windows])[:, None]).astype(np.float32)
    target = np.searchsorted(langs, labels)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(codes), batch)
        grads = _gradients(model, codes[pick].T, mask[pick].T, target[pick])
        for w, g, (a, b) in zip(model.weights, grads, moments):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (1 - k / (steps + 1)) * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-8)
    return model


def _gradients(model: Model, c: np.ndarray, m: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    ahead, behind, wo, bo = model.readers()
    steps, lanes = c.shape
    kf, kb, left, right = [], [], [], [None] * steps
    state = np.zeros((ahead.h, lanes), np.float32)
    for t in range(steps):
        state = ahead.step(state, c[t], kf)
        left.append(state)
    state = np.zeros_like(state)
    for t in range(steps - 1, -1, -1):
        state = behind.step(state, c[t], kb)
        state = state * m[t]
        right[t] = state
    truth = np.zeros((len(model.langs), lanes), np.float32)
    truth[target, np.arange(lanes)] = 1
    dwo, dbo = np.zeros_like(wo), np.zeros_like(bo)
    df, db = [], [None] * steps
    for t in range(steps):
        both = np.concatenate([left[t], right[t]])
        p = wo @ both + bo
        p = np.exp(p - p.max(axis=0))
        d = (p / p.sum(axis=0) - truth) * (m[t] / m.sum())
        dwo += d @ both.T
        dbo += d.sum(axis=1, keepdims=True)
        dboth = wo.T @ d
        df.append(dboth[:ahead.h])
        db[steps - 1 - t] = dboth[ahead.h:] * m[t]  # in the order in which it was read
    dxf, duf = ahead.unroll(df, c, kf)
    dxb, dub = behind.unroll(db, np.ascontiguousarray(c[::-1]), kb)
    return [dxf, duf, dxb, dub, dwo, dbo]


def sample_windows(rows: DataFrame, text: str, lang: str, key: str, per_lang: int, each: int = 4) -> DataFrame:
    """(lang, w): at most about ``per_lang`` documents a language, ``each`` windows of
    every one, at places drawn from the key's hash over the whole text."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each class of the model
    if not sizes:
        return rows.sparkSession.createDataFrame([], "key string, lang string, at long, w binary")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, per_lang / r.n)])
    u = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(u < F.element_at(share, F.col("lang"))).select("key", "lang", "text")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, lang_, t in zip(f["key"], f["lang"], f["text"]):
                b = t.encode("utf-8", "replace")
                rng = np.random.default_rng(np.frombuffer(str(key).encode().ljust(8, b"\0")[-8:], np.uint64))
                for s in rng.integers(0, max(1, len(b) - WINDOW + 1), each if len(b) > WINDOW else 1):
                    out.append((key, lang_, int(s), b[s:s + WINDOW]))
            yield pd.DataFrame(out, columns=["key", "lang", "at", "w"])

    return picked.mapInPandas(cut, "key string, lang string, at long, w binary")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 500, **how) -> Model:
    """A model of the languages in ``rows``; the sample is bounded by ``per_lang``
    documents of each language.  Without any labelled row the model knows none."""
    got = sorted(sample_windows(rows, text, lang, key, per_lang).collect())
    return train([bytes(r.w) for r in got], [r.lang for r in got], **how) if got else Model([], [])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; null, empty and letterless texts are
    ``und`` with score 0.  The whole text counts; nothing is shuffled."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pred, score = model.documents(batch.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    got = docs.withColumn("_lang", run(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "_lang.lang_pred", "_lang.score")
