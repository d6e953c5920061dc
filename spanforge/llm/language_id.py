"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads the
bytes of white-space separated segments (longer ones in pieces of
``SEGMENT_BYTES``), forwards and backwards, and gives each byte position a
probability for each language; a document's probabilities are the mean over all
its positions. Segments repeat, so a task remembers the sums of recent ones.

Texts that are null or hold no letter give ``und`` with score 0. Rows without a
language teach nothing; without any labelled row every document gives ``und``.
Very long texts are read in whole, a segment at a time. Of languages with equal
probabilities the first by name is given. Repeated rows get equal answers; an
empty table gives an empty result. Other columns than the id, the text and (in
training) the language aren't read.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.common import map_rows

SEGMENT_BYTES = 32
#: Bounds of the training sample: rows a language, characters a row, segments drawn from a row (all pieces of each are used).
ROWS_PER_LANGUAGE = 300
LONGEST_ROW = 20_000
SEGMENTS_PER_ROW = 120
#: Segments whose sums a task remembers at a time.
MEMO_SEGMENTS = 250_000

#: Letters are the characters of the Unicode category L: neither digits and fractions nor letter-like numbers.
_LETTER = regex.compile(r"\p{L}")


class ByteGru:
    """h = (1 - z) h' + z tanh(...), in both directions, with one softmax a position."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * hidden, np.float32)
        self.p["o"] = (rng.standard_normal((2 * hidden, classes)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["b"] = np.zeros(classes, np.float32)

    def _sweep(self, bytes_: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, length = bytes_.shape
        k, h = self.hidden, np.zeros((bytes_.shape[0], self.hidden), np.float32)
        states = np.empty((length, n, k), np.float32)
        inputs, recurrent = self.p["x" + d] + self.p["c" + d], self.p["h" + d]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x = inputs[bytes_[:, t]]
            gates = 1 / (1 + np.exp(-(x[:, : 2 * k] + h @ recurrent[:, : 2 * k])))
            z, r = gates[:, :k], gates[:, k:]
            m = np.tanh(x[:, 2 * k :] + (r * h) @ recurrent[:, 2 * k :])
            if keep is not None:
                keep.append((t, h, z, r, m))
            h = h + z * (m - h)
            states[t] = h
        return states

    def positions(self, bytes_: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (length, rows, classes) of byte strings of one length."""
        if keep is not None:
            keep |= {"f": [], "b": []}
        h = np.concatenate([self._sweep(bytes_, d, None if keep is None else keep[d]) for d in "fb"], axis=2)
        a = h @ self.p["o"] + self.p["b"]
        e = np.exp(a - a.max(axis=2, keepdims=True))
        out = e / e.sum(axis=2, keepdims=True)
        if keep is not None:
            keep |= {"h": h, "out": out}
        return out

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions, back through time."""
        keep: dict = {}
        out, k = self.positions(bytes_, keep), self.hidden
        length, n, _ = out.shape
        da = out.copy()
        da[:, np.arange(n), labels] -= 1
        da /= length * n
        g = {key: np.zeros_like(v) for key, v in self.p.items()}
        g["o"] = np.einsum("tnh,tnc->hc", keep["h"], da)
        g["b"] = da.sum(axis=(0, 1))
        dh_all = da @ self.p["o"].T
        for i, d in enumerate("fb"):
            recurrent, dh = self.p["h" + d], np.zeros((n, k), np.float32)
            for t, before, z, r, m in reversed(keep[d]):
                dh = dh + dh_all[t][:, i * k : (i + 1) * k]
                dm = dh * z * (1 - m * m)
                drh = dm @ recurrent[:, 2 * k :].T
                dz = dh * (m - before) * z * (1 - z)
                dr = drh * before * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                g["h" + d][:, : 2 * k] += before.T @ dg
                g["h" + d][:, 2 * k :] += (r * before).T @ dm
                dx = np.concatenate([dg, dm], axis=1)
                np.add.at(g["x" + d], bytes_[:, t], dx)
                g["c" + d] += dx.sum(axis=0)
                dh = dh * (1 - z) + drh * r + dg @ recurrent[:, : 2 * k].T
        return g

    def train(self, segments: list[bytes], labels: list[int], *, steps: int = 900, rows: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches of segments of one length, lengths drawn by their bytes."""
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(i)
        lengths = sorted(by_length)
        share = np.array([n * len(by_length[n]) for n in lengths], float)
        data = {n: np.frombuffer(b"".join(segments[i] for i in by_length[n]), np.uint8).reshape(-1, n) for n in lengths}
        marks = {n: np.array([labels[i] for i in by_length[n]]) for n in lengths}
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            n = lengths[rng.choice(len(lengths), p=share / share.sum())]
            pick = rng.integers(0, len(data[n]), rows)
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for key, g in self.gradients(data[n][pick], marks[n][pick]).items():
                m[key] += 0.1 * (g - m[key])
                v[key] += 0.01 * (g * g - v[key])
                self.p[key] -= (now * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def sums(self, segments: list[bytes]) -> np.ndarray:
        """For each segment of any length the sum of its positions' probabilities."""
        pieces, owner = [], []
        for i, s in enumerate(segments):
            for at in range(0, len(s), SEGMENT_BYTES):
                pieces.append(s[at : at + SEGMENT_BYTES])
                owner.append(i)
        out = np.zeros((len(segments), len(self.p["b"])))
        sizes = np.fromiter(map(len, pieces), int, len(pieces))
        owners = np.array(owner, int)
        for n in np.unique(sizes):
            where = np.flatnonzero(sizes == n)
            for at in range(0, len(where), 4096):
                part = where[at : at + 4096]
                bytes_ = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8).reshape(-1, n)
                np.add.at(out, owners[part], self.positions(bytes_).sum(axis=0))
        return out


def training_sample(docs: DataFrame, *, rows: int = ROWS_PER_LANGUAGE, longest: int = LONGEST_ROW) -> list[tuple[str, str]]:
    """At most ``rows`` distinct labelled texts a language, none above ``longest`` characters, chosen by a hash of the text.

    Copies of a text count once, so what is collected is bounded by ``rows`` for
    each language, however often one text occurs.
    """
    usable = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * rows / max(1, n))))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = usable.where((draw < share[F.col("lang")]) & (F.length("text") <= longest)).distinct().withColumn("draw", draw)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    kept = drawn.withColumn("rank", rank).where(F.col("rank") <= rows).orderBy("lang", "rank").collect()
    return [(r["lang"], r["text"]) for r in kept]


def fit(sample: list[tuple[str, str]], *, segments_per_row: int = SEGMENTS_PER_ROW, seed: int = 3, **kw) -> tuple[list[str], ByteGru | None]:
    langs = sorted({lang for lang, _ in sample})
    rng, segments, labels = np.random.default_rng(seed), [], []
    for lang, text in sample:
        words = text.encode().split()
        for i in rng.permutation(len(words))[:segments_per_row]:
            pieces = [words[i][at : at + SEGMENT_BYTES] for at in range(0, len(words[i]), SEGMENT_BYTES)]
            segments += pieces
            labels += [langs.index(lang)] * len(pieces)
    if not segments:
        return langs, None
    model = ByteGru(len(langs))
    if len(langs) > 1:
        model.train(segments, labels, **kw)
    return langs, model


class Pool:
    """Mean probabilities of documents, with recent segments remembered."""

    def __init__(self, model: ByteGru):
        self.model, self.at = model, {}
        self.table = np.zeros((0, len(model.p["b"])))
        self.size = np.zeros(0)

    def documents(self, texts: list[bytes]) -> list[np.ndarray | None]:
        split = [t.split() for t in texts]
        if len(self.at) > MEMO_SEGMENTS:
            self.at, self.table, self.size = {}, self.table[:0], self.size[:0]
        fresh = list({w for words in split for w in words if w not in self.at})
        if fresh:
            base = len(self.table)
            self.at.update(zip(fresh, range(base, base + len(fresh))))
            self.table = np.concatenate([self.table, self.model.sums(fresh)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, fresh), float, len(fresh))])
        out = []
        for words in split:
            rows = np.fromiter(map(self.at.__getitem__, words), int, len(words))
            out.append(self.table[rows].sum(axis=0) / self.size[rows].sum() if len(rows) else None)
        return out


def predict(docs: DataFrame, langs: list[str], model: ByteGru | None, *, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 256) -> DataFrame:
    """One row a document: doc_id, lang_pred, score and probabilities (map by language)."""
    shipped = docs.sparkSession.sparkContext.broadcast((langs, model))

    def make():
        langs, model = shipped.value
        pool = model and Pool(model)

        def work(cols):
            out = {"doc_id": cols["doc_id"], "lang_pred": [], "score": [], "probabilities": []}
            for at in range(0, len(cols["text"]), rows_at_once):
                texts = [t if t and _LETTER.search(t) else "" for t in cols["text"][at : at + rows_at_once]]
                for p in pool.documents([t.encode() for t in texts]) if pool else [None] * len(texts):
                    best = None if p is None else int(np.argmax(p))
                    out["lang_pred"].append("und" if best is None else langs[best])
                    out["score"].append(0.0 if best is None else float(min(1.0, p[best])))
                    out["probabilities"].append({} if best is None else dict(zip(langs, map(float, p))))
            return out

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, lang_pred string, score double, probabilities map<string,double>")
