"""Quality scores of whole texts by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded from what its words look like; gated attention, learnt
from document labels alone, weighs the codes, and the weighted sum is scored. The model is fitted on a bounded sample of
labelled texts and applied to every passage of every text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import text_only
from tianguis.llm.ragged import LOWER, Powers, Words, lookup, text_steps

PASSAGE = 64
#: Labelled texts, and passages of each, that the model is fitted on: those with the smallest hashes, and evenly spread ones.
SAMPLE_TEXTS = 4000
SAMPLE_PASSAGES = 48
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 220, 0.01, 1e-4
SEED = 11

_UPPER = lookup(np.arange(65, 91))
_LETTER = lookup(np.array([*range(65, 91), *range(97, 123), *range(0xC3, 256)]))
_DIGIT = lookup(np.arange(48, 58))
_ENDS = lookup(np.frombuffer(b".?!", dtype=np.uint8))
_COMMA = lookup(np.frombuffer(b",;:", dtype=np.uint8))
_MARK = lookup(np.frombuffer(b"!", dtype=np.uint8))
_SIGN = lookup(np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", dtype=np.uint8))
_BAR = lookup(np.frombuffer(b"|", dtype=np.uint8))
_WIDE = lookup(np.arange(0x80, 256))
_CLASSES = (_UPPER, _LETTER, _DIGIT, _ENDS, _COMMA, _MARK, _SIGN, _BAR, _WIDE)
_KEEP = np.arange(256, dtype=np.uint8)
N_FEATURES = len(_CLASSES) + 10


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """Different keys in each group."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g[new], minlength=groups)


def passages(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and their number per text; a text without words is one passage of zeros."""
    words = Words(texts, _KEEP, powers)
    folded = Words(texts, LOWER, powers).hash
    n_words = words.ends_of - words.starts_of
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(per_text) - per_text
    total = int(per_text.sum())
    text_of = np.repeat(np.arange(len(texts)), n_words)
    passage = first[text_of] + (np.arange(len(folded)) - words.starts_of[text_of]) // PASSAGE
    n = np.bincount(passage, minlength=total)
    length = words.ends - words.starts

    def total_of(value: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=value, minlength=total)

    chars = np.maximum(total_of(length), 1)
    size = np.maximum(n, 1)
    columns = []
    for table in _CLASSES:
        sums = np.concatenate([[0], np.cumsum(table[words.buffer], dtype=np.int64)])
        columns.append(total_of(sums[words.ends] - sums[words.starts]) / chars)
    same = np.zeros(len(folded))
    same[1:] = (folded[1:] == folded[:-1]) & (passage[1:] == passage[:-1])
    pair = np.zeros(len(folded), dtype=np.uint64)
    pair[1:] = folded[:-1] * np.uint64(3) + folded[1:]
    columns += [
        total_of(length) / size / 10,
        total_of(length.astype(float) ** 2) / size / 100,
        total_of(length <= 3) / size,
        total_of(length >= 12) / size,
        _distinct(passage, folded, total) / size,
        _distinct(passage, pair, total) / size,
        total_of(same) / size,
        np.minimum(n, PASSAGE) / PASSAGE,
        (n == 0).astype(float),
        np.log1p(per_text[np.repeat(np.arange(len(texts)), per_text)]) / 5,
    ]
    return np.stack(columns, axis=1), per_text


@dataclass
class Model:
    """Weights of the encoder, the two gates, the attention and the score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray):
        """Scores of the bags (as logits) and what the gradients need; ``bags``: passages per bag, one at least."""
        w = self.weights
        start = np.cumsum(bags) - bags
        of = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh((x - self.mean) / self.spread @ w["encode"] + w["encode_0"])
        v, u = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        s = (v * u) @ w["attend"]
        e = np.exp(s - np.maximum.reduceat(s, start)[of])
        a = e / np.add.reduceat(e, start)[of]
        z = np.add.reduceat(h * a[:, None], start)
        return z @ w["score"] + w["score_0"], (h, v, u, a, z, of, start)

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, bags)[0], -50, 50)))


def _gradients(model: Model, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w = model.weights
    logit, (h, v, u, a, z, of, start) = model.forward(x, bags)
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    dz = d[:, None] * w["score"]
    da = (dz[of] * h).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, start)[of])
    dg = ds[:, None] * w["attend"]
    dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
    dh = dz[of] * a[:, None] + dv @ w["value"].T + du @ w["gate"].T
    dp = dh * (1 - h**2)
    xs = (x - model.mean) / model.spread
    return {
        "encode": xs.T @ dp, "encode_0": dp.sum(axis=0), "value": h.T @ dv, "gate": h.T @ du,
        "attend": (v * u).T @ ds, "score": z.T @ d, "score_0": d.sum(),
    }


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam from a fixed seed; a constant model where the labels do not differ."""
    rng = np.random.default_rng(SEED)
    width = x.shape[1]
    weights = {
        "encode": rng.normal(0, width**-0.5, (width, HIDDEN)), "encode_0": np.zeros(HIDDEN), "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "attend": rng.normal(0, GATE**-0.5, GATE), "score": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "score_0": np.zeros(()),
    }
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    spread = x.std(axis=0) + 1e-3 if len(x) else np.ones(width)
    model = Model(mean, spread, weights)
    if not len(y) or y.min() == y.max():
        weights["score"][:] = 0
        weights["score_0"] = np.array(0.0 if not len(y) else 4.0 if y[0] else -4.0)
        return model
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for t in range(1, EPOCHS + 1):
        for k, g in _gradients(model, x, bags, y).items():
            g = g + DECAY * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            step = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            weights[k] = np.array(weights[k] - RATE * step)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the row's label may not be learnt from: crc32 of the id as text leaves 1 modulo 3; false of a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, bag sizes and labels of at most SAMPLE_TEXTS labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS)
    texts = text_only(documents, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(known), "doc_id")

    def run(batches):
        powers = Powers()
        for batch in batches:
            rows = []
            for _, _, data in text_steps(batch.column("text")):
                x, bags = passages(data, powers)
                for part in np.split(x, np.cumsum(bags)[:-1]):
                    some = np.unique(np.linspace(0, len(part) - 1, min(len(part), SAMPLE_PASSAGES)).round().astype(int))
                    rows.append(part[some].astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    # a doc_id that repeats counts once, with its first bag in byte order
    bags = texts.mapInArrow(run, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    found = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in bags.collect())
    x = np.frombuffer(b"".join(r[2] for r in found), dtype=np.float64).reshape(-1, N_FEATURES)
    sizes = np.array([len(r[2]) // (8 * N_FEATURES) for r in found], dtype=np.int64)
    return x, sizes, np.array([r[1] for r in found], dtype=np.float64)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``; score 0 to 1, higher: label 1 is likelier.

    Learnt from at most ``SAMPLE_TEXTS`` labelled texts that are not held out; rows of ``labels`` without a doc_id or a
    quality are left aside, and repeated ones of a doc_id count as their majority. Only the text is looked at. Null and
    empty texts are one passage without words, and scored as such. Without labels every score is 0.5. Repeated rows stay
    repeated rows; other columns play no part; an empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(*_sample(documents, labels)))

    def run(batches):
        powers = Powers()
        for batch in batches:
            parts = [model.value.scores(*passages(data, powers)) for _, _, data in text_steps(batch.column("text"))]
            score = np.concatenate([*parts, np.empty(0)])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    docs = text_only(documents, F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are predicted 1, with all their columns; rows without a doc_id are judged alike."""
    model = documents.sparkSession.sparkContext.broadcast(fit(*_sample(documents, labels)))

    @F.arrow_udf("boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = Powers()
        for texts in batches:
            parts = [model.value.scores(*passages(data, powers)) >= 0.5 for _, _, data in text_steps(texts)]
            yield pa.array(np.concatenate([*parts, np.empty(0, dtype=bool)]))

    return documents.where(judged(F.col("text").cast("string")))
