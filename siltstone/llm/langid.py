"""Language ID: a byte convolutional network, trained in numpy, over fixed-length windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut

LENGTH = 128
EMBED, FILTERS, WIDTHS = 8, 16, (2, 3, 4)
UNKNOWN = "und"


def windows(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """(n, length) bytes of a text: side by side from its start, the last one ending with it; short texts are padded with zeros."""
    if len(raw) <= length:
        return np.frombuffer(raw.ljust(length, b"\0"), np.uint8)[None, :]
    b = np.frombuffer(raw, np.uint8)
    n = len(raw) // length
    parts = b[: n * length].reshape(n, length)
    return parts if n * length == len(raw) else np.concatenate([parts, b[None, -length:]])


class Network:
    """Embedded bytes, filters of several widths, the maximum of each over the window, softmax."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p |= {f"w{w}": rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.p |= {"o": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), "ob": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        return np.concatenate([x[:, j : j + n] for j in range(w)], axis=2)

    def features(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        emb, out = self.p["e"][x], []
        for w in WIDTHS:
            cols = self._columns(emb, w)
            z = cols @ self.p[f"w{w}"]
            if keep is not None:
                keep.append((cols, z.argmax(axis=1)))
            out.append(z.max(axis=1) + self.p[f"b{w}"])
        return np.concatenate(out, axis=1)

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        z = np.maximum(h, 0) @ self.p["o"] + self.p["ob"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        h = self.features(x, keep)
        d = np.exp(self.log_softmax(h))
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        a = np.maximum(h, 0)
        g = {"o": a.T @ d, "ob": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            cols, at = keep[k]
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
            picked = cols[rows, at]  # (batch, filters, w * EMBED)
            g[f"w{w}"] = np.einsum("bfc,bf->cf", picked, dz)
            g[f"b{w}"] = dz.sum(axis=0)
            back = dz[:, :, None] * self.p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["e"], x[rows, at + j], back[:, :, j * EMBED : (j + 1) * EMBED])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some, t = order[at : at + batch], t + 1
                for k, g in self.gradients(x[some], y[some]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str], batch: int = 512) -> tuple[list[str], np.ndarray]:
        """Best language and its probability: the mean of the log probabilities of all windows of a text."""
        parts = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
        x, sizes = np.concatenate(parts), [len(p) for p in parts]
        logs = np.concatenate([self.log_softmax(self.features(x[i : i + batch])) for i in range(0, len(x), batch)])
        mean = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.asarray(sizes)[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        return [self.langs[i] for i in best], prob[np.arange(len(best)), best].astype(np.float64)


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from; a null id is one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int = 300, most: int = 4000, per_text: int = 4, epochs: int = 12) -> Network | None:
    """A network from at most per_lang texts of each language and most in all, least hashes of id first; per_text windows of each, spread evenly from its start to its end."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    h = F.xxhash64("id")
    ranked = own.select("id", "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(h, "id"))).where(F.col("r") <= per_lang)
    ids = cut(ranked.orderBy("r", h, "id").limit(most).select("id", "lang").distinct())
    room = F.greatest(F.length("text") - LENGTH, F.lit(0))
    spread = [F.substring("text", F.floor(room * i / max(per_text - 1, 1)).cast("int") + 1, F.lit(LENGTH)) for i in range(per_text)]
    rows = own.join(F.broadcast(ids), ["id", "lang"]).select("id", "lang", F.array_distinct(F.array(*spread)).alias("t")).orderBy("id", "lang", "t").limit(2 * most).collect()
    x, y = [], []
    langs = sorted({r.lang for r in rows})
    for r in rows:
        for t in r.t:
            x.append(windows(t.encode())[:1])
            y.append(langs.index(r.lang))
    if not x:
        return None
    net = Network(langs)
    net.train(np.concatenate(x), np.asarray(y), epochs=epochs)
    return net


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row for each row of docs.

    The network is fitted on a bounded sample of labelled rows (see fit) that are not held out, and then reads all windows of
    every text; nothing but the text goes into a prediction. Null text, and text without a letter, is und with score 0; so is
    all text where nothing could be learned. A null id is held out. Repeated rows each get a row. An empty table gives no row.
    """
    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for at in range(0, len(texts), 64):
                some = [i for i, t in enumerate(texts[at : at + 64]) if any(map(str.isalpha, t))]
                p, s = [UNKNOWN] * len(texts[at : at + 64]), np.zeros(len(texts[at : at + 64]))
                if some and shared.value is not None:
                    found, s[some] = shared.value.predict([texts[at + i] for i in some])
                    for i, lang in zip(some, found, strict=True):
                        p[i] = lang
                pred += p
                score.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
