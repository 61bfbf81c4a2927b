"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A gated recurrent unit runs over the bytes in each direction; every position gets a distribution
over the languages from both states, and a document's probabilities are the mean over its positions.
Training is by backpropagation through time on a bounded sample of labelled documents. Texts are
cut into stretches that run side by side, each with what surrounds it; every byte of every text is
a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import among_lowest, materialise, table

#: Documents of each language that the network learns from at most, and bytes of each of them.
TRAIN_DOCS, TRAIN_BYTES = 300, 768
#: Bytes of a stretch, bytes read before and after it, states of a direction.
STRETCH, HALO, HIDDEN = 192, 32, 8
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name: for each direction f and b the byte table e (256, 3H), the recurrent u
    (H, 2H) of both gates and c (H, H) of the candidate; o (2H, L) and its bias p (L)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        r, h, n = np.random.default_rng(seed), hidden, len(labels)
        self.labels, self.hidden = labels, hidden
        scale = lambda *shape: (r.standard_normal(shape) * 0.4).astype(np.float32)
        self.w = {d + k: scale(*shape) / div for d in "fb" for k, shape, div in (("e", (256, 3 * h), 1), ("u", (h, 2 * h), h**0.5), ("c", (h, h), h**0.5))}
        self.w |= {"o": scale(2 * h, n), "p": np.zeros(n, np.float32)}

    def _states(self, x: np.ndarray, d: str, keep: list | None = None, inside: np.ndarray | None = None) -> np.ndarray:
        """x: (T, B) bytes in reading order of direction d -> (T, B, H) states in that order.

        inside: (T, B) ones and zeros; where it is zero there is no text, and the state stays zero."""
        h, e, u, c = self.hidden, self.w[d + "e"], self.w[d + "u"], self.w[d + "c"]
        out = np.empty((*x.shape, h), np.float32)
        s = np.zeros((x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            a = e[x[t]]
            g = _sigmoid(a[:, : 2 * h] + s @ u)
            z, r = g[:, :h], g[:, h:]
            rs = r * s
            n = np.tanh(a[:, 2 * h :] + rs @ c)
            new = s + z * (n - s)
            if inside is not None:
                new *= inside[t][:, None]
            if keep is not None:
                keep.append((s, z, r, rs, n))
            s = out[t] = new
        return out

    def _read(self, x: np.ndarray, d: str, inside: np.ndarray) -> np.ndarray:
        """The states of _states() for predictions, as (T, H, B): rows of all B texts are added up and squashed at once, in place."""
        h, e = self.hidden, self.w[d + "e"].copy()
        e[:, : 2 * h] *= 0.5  # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2
        u, c = np.ascontiguousarray(self.w[d + "u"].T) * np.float32(0.5), np.ascontiguousarray(self.w[d + "c"].T)
        steps, width = x.shape
        out, s = np.empty((steps, h, width), np.float32), np.zeros((h, width), np.float32)
        a, rows, g, n = (np.empty(size, np.float32) for size in ((width, 3 * h), (3 * h, width), (2 * h, width), (h, width)))
        for t in range(steps):
            np.take(e, x[t], axis=0, out=a, mode="clip")
            rows[:] = a.T
            np.matmul(u, s, out=g)
            g += rows[: 2 * h]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            g[h:] *= s
            np.matmul(c, g[h:], out=n)
            n += rows[2 * h :]
            np.tanh(n, out=n)
            n -= s
            n *= g[:h]
            n += s
            s = np.multiply(n, inside[t], out=out[t])
        return out

    def positions(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """(T, B) bytes, and where they are text (None: everywhere) -> (T, B, L) probabilities of each position."""
        h, back = self.hidden, None if inside is None else inside[::-1]
        z = self._states(x, "f", inside=inside) @ self.w["o"][:h] + (self._states(x[::-1], "b", inside=back) @ self.w["o"][h:])[::-1] + self.w["p"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        return z / z.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions, and its gradients by backpropagation through time."""
        h, kept = self.hidden, {"f": [], "b": []}
        f, b = self._states(x, "f", kept["f"]), self._states(x[::-1], "b", kept["b"])[::-1]
        states = np.concatenate([f, b], axis=2)
        z = states @ self.w["o"] + self.w["p"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        p = z / z.sum(axis=2, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = -float(np.log(p[:, rows, y] + 1e-9).mean())
        dz = p
        dz[:, rows, y] -= 1
        dz /= x.size
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["p"] = np.tensordot(states, dz, ([0, 1], [0, 1])), dz.sum((0, 1))
        ds_all = dz @ self.w["o"].T
        for d, data, ds_out in (("f", x, ds_all[:, :, :h]), ("b", x[::-1], ds_all[::-1, :, h:])):
            u, c = self.w[d + "u"], self.w[d + "c"]
            carry = np.zeros((x.shape[1], h), np.float32)
            da_all = np.empty((*x.shape, 3 * h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                s, z1, r, rs, n = kept[d][t]
                ds = ds_out[t] + carry
                dn = ds * z1 * (1 - n * n)
                drs = dn @ c.T
                dg = np.concatenate([ds * (n - s) * z1 * (1 - z1), drs * s * r * (1 - r)], axis=1)
                carry = ds * (1 - z1) + drs * r + dg @ u.T
                g[d + "c"] += rs.T @ dn
                g[d + "u"] += s.T @ dg
                da_all[t, :, : 2 * h], da_all[t, :, 2 * h :] = dg, dn
            np.add.at(g[d + "e"], data.reshape(-1), da_all.reshape(-1, 3 * h))
        return loss, g

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 140, batch: int = 96, length: int = 48, rate: float = 0.03, seed: int = 5) -> float:
        """Adam over stretches of the texts, languages in turn from step to step; returns the last losses' mean.

        Beyond 24 languages the steps grow with their number, so a language gets as many stretches."""
        r, m, v = np.random.default_rng(seed), {}, {}
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        by = [b for b in by if b.size]
        steps = max(steps, -(-steps * len(by) // 24))
        last: list[float] = []
        for step in range(1, steps + 1):
            rows = np.array([r.choice(by[((step - 1) * batch + i) % len(by)]) for i in range(batch)])
            x = np.full((length, batch), 32, np.uint8)
            for j, i in enumerate(rows):
                t = texts[i]
                a = int(r.integers(0, max(1, len(t) - length + 1)))
                part = np.frombuffer(t[a : a + length], np.uint8)
                x[: part.size, j] = part
            loss, g = self.gradients(x, y[rows])
            last.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * min(1, 4 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * a
                v[k] = 0.98 * v.get(k, 0) + 0.02 * a * a
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(last[-10:]))

    def pooled(self, texts: list[bytes], stretch: int = STRETCH, halo: int = HALO) -> np.ndarray:
        """(documents, L): the mean over all positions of each text; an empty text gives zeros.

        A stretch is read with up to `halo` bytes of the text before and after it, so both directions
        reach it with the states that its surroundings leave."""
        out = np.zeros((len(texts), len(self.labels)))
        size = np.array([len(t) for t in texts], np.int64)
        pieces, steps = -(-size // stretch), stretch + 2 * halo
        owner = np.repeat(np.arange(len(texts)), pieces)
        piece = np.arange(owner.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        used = np.minimum(size[owner] - piece * stretch, stretch)
        # Each text stands between bytes that are not read: a halo before, and the rest of its last stretch and a halo after it.
        raw = np.frombuffer(b"".join(b" " * halo + t + b" " * (int(n) * stretch - len(t) + halo) for t, n in zip(texts, pieces, strict=True)), np.uint8)
        begin = np.r_[0, np.cumsum(pieces * stretch + 2 * halo)][:-1][owner] + piece * stretch
        width = max(64, min(1024, (1 << 24) // (steps * max(1, len(self.labels)))))
        for a in range(0, owner.size, width):
            part = slice(a, a + width)
            place = piece[part] * stretch - halo + np.arange(steps)[:, None]
            inside = ((place >= 0) & (place < size[owner[part]])).astype(np.float32)
            x, own = raw[begin[part] + np.arange(steps)[:, None]], slice(halo, halo + stretch)
            # A direction stops at the far end of the stretch: what lies beyond is the other one's.
            f = self._read(x[: halo + stretch], "f", inside[: halo + stretch])[own]
            b = self._read(x[halo:][::-1], "b", inside[halo:][::-1])[own][::-1]
            h, p = self.hidden, self.w["p"][:, None]
            p = np.matmul(self.w["o"][:h].T, f) + np.matmul(self.w["o"][h:].T, b) + p
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= (np.arange(stretch)[:, None] < used[None, part])[:, None, :] / p.sum(axis=1, keepdims=True)
            np.add.at(out, owner[part], p.sum(0, dtype=np.float64).T)
        return out / np.maximum(size, 1)[:, None]


def _bucket(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5


def _drawn(most: int, parts: int = 4):
    """Of each text with more bytes than `most`, parts of that length in all, from places all over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seed, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                t = text.as_py().encode()
                if len(t) > most:
                    size = max(1, most // parts)
                    at = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).integers(0, len(t) - size + 1, most // size)
                    t = b"".join(t[i : i + size] for i in at.tolist())
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["lang", "h", "part"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network:
    """A network from the text and lang of documents outside the held-out fifth.

    The sample: of each language up to train_docs distinct texts with the smallest hash, of each
    train_bytes bytes from places all over it (training only; predictions read whole texts). Rows whose id, text or lang is
    null teach nothing. Without any row the network has no label and predicts "und".
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter((_bucket("id") != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text").alias("h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    hashes = materialise(rows.select("lang", h).distinct())
    many = materialise(hashes.groupBy("lang").agg(F.count("*").alias("many")))
    low = hashes.join(many, "lang").filter(among_lowest(F.col("h"), F.col("many"), train_docs))
    least = low.select("lang", "h", place.alias("n")).filter(F.col("n") <= train_docs)
    ends = materialise(least.groupBy("lang").agg(F.max("h").alias("end")))
    near = rows.join(ends, "lang").filter(F.xxhash64("text") <= F.col("end")).select("lang", h, "text").distinct()
    near = near.mapInArrow(_drawn(train_bytes), "lang string, h long, part binary")
    drawn = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("n") <= train_docs)
    found = drawn.select("lang", "h", "part").collect()
    if not found:
        return Network([])
    labels = sorted({r[0] for r in found})
    number = {lang: i for i, lang in enumerate(labels)}
    sample = [(bytes(part), number[lang]) for lang, _, part in sorted(found, key=lambda r: (number[r[0]], r[1], r[2]))]
    net = Network(labels)
    net.train([t for t, _ in sample], np.array([k for _, k in sample]))
    return net


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score (the winning probability).

    lang_pred is "und" with score 0 where the text is null or has no letter, or nothing was learnt.
    Equal texts get equal results but for rounding; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                if not net.labels:
                    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    p = net.pooled([t.encode() for t in texts])
                    known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                    top = p.argmax(1)
                    names = [net.labels[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
                    best = np.where(known, np.clip(p[np.arange(len(texts)), top], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (_bucket("doc_id") == 0).alias("held_out"), "lang_pred", "score")
