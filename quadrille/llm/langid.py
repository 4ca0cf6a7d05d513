"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows, forwards and backwards, labels every byte
position with a distribution over languages, and a document's probabilities are the mean
over all positions of all its windows. It is trained in numpy by backpropagation through
time on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import slices

#: Hidden units of a direction, bytes of a window, windows run at once.
UNITS, WINDOW, LANES = 8, 96, 4096
#: Labelled documents of a language in the sample, on average, and windows of one document.
TRAIN_ROWS, TRAIN_WINDOWS = 1200, 3
#: Languages that are learned, the most frequent labels: rare ones beyond are taken for slips.
MOST_LANGUAGES = 200
UNKNOWN = "und"


def _sigmoid2(x: np.ndarray) -> np.ndarray:
    """Logistic function of 2x, in place."""
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


@dataclass
class Direction:
    """One gated recurrent layer: per-byte input terms (256, 3H) and recurrent weights (3H, H).

    Rows of the gates: update z, reset r, candidate c. Gate pre-activations are halved by
    construction (the logistic function of 2x), the candidate is tanh.
    """

    inputs: np.ndarray
    recurrent: np.ndarray

    def run(self, codes: np.ndarray) -> np.ndarray:
        """States (T, H, B) of byte codes (T, B)."""
        steps, lanes = codes.shape
        h = self.recurrent.shape[1]
        table, gates, new = self.inputs.T.copy(), self.recurrent[: 2 * h], self.recurrent[2 * h :]
        out = np.empty((steps, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        for t in range(steps):
            x = table[:, codes[t]]
            zr = gates @ state
            zr += x[: 2 * h]
            _sigmoid2(zr)
            c = new @ (zr[h:] * state)
            c += x[2 * h :]
            np.tanh(c, out=c)
            c -= state
            c *= zr[:h]
            state = np.add(state, c, out=out[t])
        return out

    def train_run(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """States, and what back() needs."""
        steps, lanes = codes.shape
        h = self.recurrent.shape[1]
        gates, new = self.recurrent[: 2 * h], self.recurrent[2 * h :]
        state, kept, out = np.zeros((h, lanes)), [], np.empty((steps, h, lanes))
        for t in range(steps):
            x = self.inputs[codes[t]].T
            zr = _sigmoid2(gates @ state + x[: 2 * h])
            z, r = zr[:h], zr[h:]
            c = np.tanh(new @ (r * state) + x[2 * h :])
            kept.append((state, z, r, c))
            state = state + z * (c - state)
            out[t] = state
        return out, kept

    def back(self, codes: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and recurrent weights, given those of the states."""
        h = self.recurrent.shape[1]
        gates, new = self.recurrent[: 2 * h], self.recurrent[2 * h :]
        d_in, d_rec = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        carry = np.zeros_like(grad[0])
        for t in range(len(codes) - 1, -1, -1):
            state, z, r, c = kept[t]
            d = grad[t] + carry
            dc = d * z * (1 - c * c)
            drs = new.T @ dc
            dz = d * (c - state) * 2 * z * (1 - z)
            dr = drs * state * 2 * r * (1 - r)
            dg = np.concatenate([dz, dr])
            carry = d * (1 - z) + drs * r + gates.T @ dg
            d_rec[: 2 * h] += dg @ state.T
            d_rec[2 * h :] += dc @ (r * state).T
            whole = np.concatenate([dg, dc])
            order = np.argsort(codes[t], kind="stable")
            values, first = np.unique(codes[t][order], return_index=True)
            d_in[values] += np.add.reduceat(whole[:, order], first, axis=1).T
        return d_in, d_rec


@dataclass
class Network:
    """Both directions and the position labeller (languages, 2H) with its bias."""

    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray
    bias: np.ndarray

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (T, languages, B) of byte codes (T, B)."""
        h = self.output.shape[1] // 2
        logits = self.output[:, :h] @ self.forward.run(codes)
        logits += self.output[:, h:] @ self.backward.run(codes[::-1])[::-1]
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over all positions of whole texts; zeros for empty ones.

        A text's last window is filled up with spaces, always to a whole window, so that a
        text's result does not depend on the texts beside it.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        windows = [(len(t[a : a + WINDOW]), i, a) for i, t in enumerate(texts) for a in range(0, len(t), WINDOW)]
        windows.sort()
        for lo in range(0, len(windows), LANES):
            part = windows[lo : lo + LANES]
            codes = np.frombuffer(b"".join(texts[i][a : a + n].ljust(WINDOW, b" ") for n, i, a in part), np.uint8).reshape(len(part), WINDOW)
            probability = self.positions(np.ascontiguousarray(codes.T))
            lengths = np.array([n for n, _, _ in part])
            if lengths[0] < WINDOW:
                probability = probability * (np.arange(WINDOW)[:, None, None] < lengths)
            np.add.at(sums, np.array([i for _, i, _ in part]), probability.sum(axis=0).T)
        return sums / np.maximum(np.array([[len(t)] for t in texts]), 1)


def train(samples: list[bytes], labels: np.ndarray, languages: list[str], units: int = UNITS, rounds: int = 200, lanes: int = 160, rate: float = 0.02) -> Network:
    """Fits by Adam on the mean cross-entropy of all positions of random batches of windows."""
    rng = np.random.default_rng(7)
    width = max(map(len, samples))
    codes = np.frombuffer(b"".join(s.ljust(width, b" ") for s in samples), np.uint8).reshape(len(samples), width)
    real = np.arange(width)[None, :] < np.array([[len(s)] for s in samples])
    scale = 0.3
    p = [rng.normal(0, scale, (256, 3 * units)), rng.normal(0, scale, (3 * units, units)), rng.normal(0, scale, (256, 3 * units)), rng.normal(0, scale, (3 * units, units)), rng.normal(0, scale, (len(languages), 2 * units)), np.zeros(len(languages))]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(x, lanes // len(by_label) + 1) for x in by_label if len(x)])
        batch, mask = codes[pick].T, real[pick].T
        f, b = Direction(p[0], p[1]), Direction(p[2], p[3])
        hf, kf = f.train_run(batch)
        hb, kb = b.train_run(batch[::-1])
        states = np.concatenate([hf, hb[::-1]], axis=1)
        logits = p[4] @ states + p[5][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(axis=1, keepdims=True)
        error[:, labels[pick], np.arange(len(pick))] -= 1.0
        error *= mask[:, None, :] / mask.sum()
        back = p[4].T @ error
        df, rf = f.back(batch, kf, back[:, :units])
        db, rb = b.back(batch[::-1], kb, back[::-1, units:])
        gradients = [df, rf, db, rb, np.einsum("tlb,thb->lh", error, states), error.sum(axis=(0, 2))]
        size = np.sqrt(sum((g * g).sum() for g in gradients))
        for k, g in enumerate(gradients):
            g = g * min(1.0, 1.0 / (size + 1e-12))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.005 * (g * g - second[k])
            p[k] -= rate * (1 - 0.9 * step / rounds) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)
    f32 = [x.astype(np.float32) for x in p]
    return Network(languages, Direction(f32[0], f32[1]), Direction(f32[2], f32[3]), f32[4], f32[5])


def _bytes(text: str | None) -> bytes:
    """UTF-8 of the lower-case text; empty if it has no letter."""
    return text.lower().encode("utf-8", "replace") if text and any(map(str.isalpha, text)) else b""


def windows_of(text: str) -> list[bytes]:
    """Up to TRAIN_WINDOWS windows spread over a training text."""
    raw = _bytes(text)
    starts = range(0, len(raw), WINDOW)
    return [raw[a : a + WINDOW] for a in starts[:: max(1, -(-len(starts) // TRAIN_WINDOWS))]]


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = TRAIN_ROWS, languages: int = MOST_LANGUAGES) -> Network | None:
    """Trains on labelled rows of df, about `train_rows` of each of the `languages` most frequent labels by a hash of the id; None without any."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    frequent = rows.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(languages)
    sizes = {r[0]: r[1] for r in frequent.collect()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(min(1.0, train_rows / n) * (1 << 30)))])
    chosen = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(1 << 30)) < shares[F.col(lang_col)]

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, lang) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in windows_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.string())], names=["bytes", "lang"])

    found = rows.where(chosen).select(text_col, lang_col).mapInArrow(cut_windows, "bytes binary, lang string").collect()
    samples = sorted((bytes(r[0]), r[1]) for r in found)
    known = sorted({x for _, x in samples})
    if not samples:
        return None
    return train([x for x, _ in samples], np.array([known.index(x) for _, x in samples]), known)


def identify(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; score is the pooled probability of the language.

    A null text, one without a letter, and any text without a network are `und` with score
    0. Ids pass through, null and repeated ones too; other columns are not read; an empty
    table gives an empty result. Every byte of a text is read.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    held = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            raw = [_bytes(t) for t in batch.column(1).to_pylist()]
            langs, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
            if net is not None:
                for lo, hi in slices(raw, LANES * WINDOW):
                    means = net.pooled(raw[lo:hi])
                    best = means.argmax(axis=1)
                    for k in range(hi - lo):
                        if raw[lo + k]:
                            langs[lo + k], scores[lo + k] = net.languages[best[k]], min(1.0, float(means[k, best[k]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def fold_of(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = learn(docs.where(fold_of("doc_id") != 2), "doc_id", "text", "lang")
    found = identify(docs, network)
    return found.select("doc_id", F.coalesce(fold_of("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
