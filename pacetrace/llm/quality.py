"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .groups import free_name
from .textops import chunks, utf8, word_bounds, word_hashes

PASSAGE_WORDS = 48
MAX_TRAINING_DOCS = 4000
HIDDEN, ATTENTION = 24, 12


def _byte_kinds() -> np.ndarray:
    """Kinds of bytes whose shares describe a passage, one row each."""
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".,;:'\"()-", "#$%&*+/<=>@\\^_`|~[]{}", "\n\t\r", "|"]
    table = np.zeros((len(kinds) + 1, 256), np.float32)
    for i, k in enumerate(kinds):
        table[i, [ord(c) for c in k]] = 1
    table[-1, 128:] = 1
    return table


_KINDS = _byte_kinds()
FEATURES = len(_KINDS) + 8


def passage_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of ``PASSAGE_WORDS`` words of a run of texts, and the offset of each text in that list.

    A passage at the end that is shorter than half joins the one before.  A text without words has one passage of zeros
    but for the last feature, which tells it.
    """
    start, length, texts = word_bounds(data, off)
    n = np.diff(texts)
    count = np.maximum(1, (n + PASSAGE_WORDS // 2) // PASSAGE_WORDS)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((at[-1], FEATURES), np.float32)
    empty = np.repeat(n == 0, count)
    out[empty, -1] = 1
    if not len(start):
        return out, at
    # First word of each passage of the texts that have words.
    turn = np.arange(at[-1]) - np.repeat(at[:-1], count)
    first = (np.repeat(texts[:-1], count) + turn * PASSAGE_WORDS)[~empty]
    words = np.diff(np.append(first, len(start))).astype(np.float32)
    begin = start[first]
    begin[0] = 0
    size = np.diff(np.append(begin, len(data))).astype(np.float32)
    hashes, _ = word_hashes(data, off)
    own = np.repeat(np.arange(len(first)), words.astype(np.int64))
    cols = [np.add.reduceat(k[data], begin) / size for k in _KINDS]
    mean = np.add.reduceat(length.astype(np.float32), first) / words
    same = np.zeros(len(start), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((hashes, own))
    fresh = np.ones(len(start), np.float32)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
    ends = data[start + length - 1]
    mark = ((ends < 128) & ~(((ends >= 48) & (ends <= 57)) | ((ends | 32) >= 97) & ((ends | 32) <= 122))).astype(np.float32)
    upper = ((data[start] >= 65) & (data[start] <= 90)).astype(np.float32)
    odd = (mark > 0) & ~np.isin(ends, np.frombuffer(b".,;:!?)\"'", np.uint8))
    cols += [
        mean / 10, np.minimum(np.maximum.reduceat(length, first), 100) / 30, np.add.reduceat(same, first) / words, np.add.reduceat(fresh, first) / words,
        np.add.reduceat(mark, first) / words, np.add.reduceat(upper, first) / words, np.add.reduceat(odd.astype(np.float32), first) / words,
    ]
    out[~empty, :-1] = np.column_stack(cols)
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Passage encoder, gated attention over the passages of a document, and a score of their weighted mean.

    ``h = tanh(x W + b)``; ``a = softmax(w . (tanh(h V) * sigmoid(h U)))`` over the document; ``score = sigmoid(c . sum(a h) + d)``.
    """

    def __init__(self, seed: int = 5) -> None:
        g = np.random.default_rng(seed)
        init = lambda *s: g.standard_normal(s) / np.sqrt(s[0])
        self.p = {
            "W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
            "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES),
        }

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p, first, n = self.p, at[:-1], np.diff(at)
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(at)
        do = (f["score"] - y) / len(y)
        dz = np.repeat(do, n)[:, None] * p["c"]
        dh = f["a"][:, None] * dz
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), n))
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de,
            "c": f["z"].T @ do, "d": np.array([do.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, passes: int = 60, batch: int = 64, rate: float = 0.01, seed: int = 6) -> GatedAttention:
        """Adam on the cross-entropy of document labels; deterministic for the same bags in the same order."""
        if not bags:
            return self
        every = np.concatenate(bags)
        self.p["mean"], self.p["scale"] = every.mean(axis=0), every.std(axis=0) + 1e-3
        g, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = passes * -(-len(bags) // batch)
        for _ in range(passes):
            order = g.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                at = np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])])
                grad = self.gradients(self.forward(np.concatenate([bags[k] for k in own]), at), at, labels[own])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, d in grad.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAINING_DOCS) -> GatedAttention:
    """Fit the model to labels 0/1 of at most ``max_docs`` documents, those of the smallest hash of their id.

    Only labels whose ``crc32(id as text) mod 5`` is not 0 are used; the rest are held out.  The features of the sample's
    whole texts come to the driver, nothing else.
    """
    own = labels.filter(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    sample = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(max_docs)
    schema = "id long, y int, features binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            packed = []
            for row, end, part, part_off in chunks(data, off):
                f, at = passage_features(part, part_off)
                packed += [f[at[i] : at[i + 1]].tobytes() for i in range(end - row)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "y", "features"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    known = texts.join(F.broadcast(sample), "id").select("id", "y", "t").mapInArrow(run, schema)
    rows = sorted((r.id, r.y, bytes(r.features)) for r in known.collect())
    bags = [np.frombuffer(f, np.float32).reshape(-1, FEATURES).astype(np.float64) for _, _, f in rows]
    return GatedAttention().fit(bags, np.array([y for _, y, _ in rows], np.float64))


def score(docs: DataFrame, model: GatedAttention, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the model's score in 0 to 1 of each whole text; higher means label 1 is likelier.

    Every passage is encoded, and the score is that of their attention-weighted mean.  Null or empty text, and text of white
    space only, is one passage of its own kind.  All rows and columns are kept; a column named ``into`` is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    schema = StructType([*docs.select(*(docs[c] for c in kept)).schema.fields, StructField(into, DoubleType(), False)])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            data, off = utf8(b.column(n))
            for row, end, part, part_off in chunks(data, off):
                out[row:end] = model.forward(*passage_features(part, part_off))["score"]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out)], names=schema.names)

    return docs.select(*(docs[c] for c in kept), F.col(text_col).cast("string").alias(free_name(kept, "whole text"))).mapInArrow(run, schema)
