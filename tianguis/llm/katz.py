"""Katz backoff scores of whole texts, learnt from the corpus itself.

Bigram counts with Good-Turing discounts back off to discounted unigrams, and those to one unknown word. Every word of the
training texts is a history. Every count covers the whole corpus.

Denominators are one larger than the counts (c(u) + 1, N + 1): one event is always left for what was not seen, so the
backoff weights, computed from exact sums, are positive and every distribution adds up to one.

Texts are held as chunks: their distinct words, and one number per token. A chunk deals its words into buckets, which answer
with every word's count in the corpus and a number for it, small for common words. It then deals its distinct pairs into buckets
by history, where the counts of the whole corpus meet and the sums behind the backoff weights are taken; a bucket answers every
chunk in the order it was asked, so texts are never sent along. A common history is dealt over several buckets by the word behind
it, by its count alone, and its sums are added up in a table of their own. With the answers a chunk looks up its tokens and adds
them up per text. Numbers travel as byte planes, of which all but the lowest compress to next to nothing.
"""

from __future__ import annotations

import math
import os
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import SENT_ROWS, complete_runs, saved, text_only
from tianguis.llm.ragged import LOWER, Powers, Words, steps

#: A history has at least this share of the training tokens; 0: every word is one.
HISTORY_SHARE = 0.0
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Tokens of a bucket, and bytes of text whose tokens are counted together before they are dealt out.
BUCKET_TOKENS = 500_000
CHUNK_BYTES = 6_000_000
#: A history is dealt over one bucket more for every so many of its tokens, each part by the words behind it.
SPLIT_TOKENS = 125_000
#: Shares into which rows are salted that meet a table of histories too large to be sent.
SALT = 32
#: Hash of the end of a text, smaller than that of any word.
_END = np.uint64(0)
#: Number of the history of the first token of a text; words are numbered from 1.
_BEGIN = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0x94D049BB133111EB)


def discounts(counts: list[float]) -> list[float]:
    """Good-Turing discounts of the counts 1 to DISCOUNTED from the numbers of types that occur 1, 2, ... times.

    ``counts`` has DISCOUNTED + 1 entries. A discount that is not in (0, 1] is 1; without types that occur once all are.
    """
    k = DISCOUNTED
    out = []
    for r in range(1, k + 1):
        d = 1.0
        if counts[0] > 0 and counts[r - 1] > 0:
            common = (k + 1) * counts[k] / counts[0]
            if common < 1:
                d = ((r + 1) * counts[r] / (r * counts[r - 1]) - common) / (1 - common)
        out.append(d if 0 < d <= 1 else 1.0)
    return out


def held_out(doc_id):
    """Whether a row is not learnt from: crc32 of the id as text is a multiple of 10; false of a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _tokens(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, an end behind each, and the text of every token."""
    words = Words(texts, LOWER, powers)
    n = words.ends_of - words.starts_of
    doc = np.repeat(np.arange(len(texts)), n)
    tokens = np.empty(len(words.hash) + len(texts), dtype=np.uint64)
    tokens[np.arange(len(doc)) + doc] = np.maximum(words.hash, np.uint64(1))
    tokens[words.ends_of + np.arange(len(texts))] = _END
    return tokens, np.repeat(np.arange(len(texts)), n + 1)


def _batched(batch: pa.RecordBatch, size: int):
    data = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    for a, b in steps([len(t) for t in data], size):
        yield data[a:b], batch.slice(a, b - a)


def packed(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed as planes: all lowest bytes, then all second ones and so on, without the planes above
    that are zero throughout. In front: the number of planes (one at least) and of values."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    width = int(max(np.flatnonzero(planes.any(axis=1)), default=0)) + 1
    return struct.pack("<BQ", width, planes.shape[1]) + zstandard.compress(planes[:width].tobytes(), 3)


def entries(data: bytes) -> int:
    return struct.unpack_from("<BQ", data)[1]


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    width, size = struct.unpack_from("<BQ", data)
    out = np.zeros((size, 8), dtype=np.uint8)
    if size:
        out[:, :width] = np.frombuffer(zstandard.decompress(data[9:]), dtype=np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def _joined(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    """The packed numbers of all rows one after the other; nulls hold none."""
    parts = [unpacked(b, kind) for b in column.to_pylist() if b is not None]
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (values ^ (values >> np.uint64(31))) * _MIX2
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(33)).astype(np.int64) % buckets


def _range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of word hashes by equal ranges, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _one(values, kind) -> pa.ListArray:
    return pa.array([values], pa.list_(kind))


_TEXTS = {"place": "binary", "token": "binary", "n": "array<int>", "doc_id": "array<long>", "learn": "array<boolean>"}
_CHUNKS = "chunk long, words long, word binary, times binary, " + ", ".join(f"{c} {t}" for c, t in _TEXTS.items())


def chunked(documents: DataFrame, size: int) -> DataFrame:
    """Chunks of texts: sorted hashes of their distinct words with the training counts, tokens as ranks of words (the most frequent
    first), the place of each rank among the sorted words, and the texts."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for data, rows in _batched(batch, size):
                tokens, doc = _tokens(data, powers)
                word, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
                learn = ~rows.column("held_out").to_numpy(zero_copy_only=False)
                times = np.bincount(index, weights=learn[doc], minlength=len(word)).astype(np.int64)
                place = np.argsort(-often, kind="stable")
                rank = np.empty(len(place), dtype=np.int64)
                rank[place] = np.arange(len(place))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()), pa.array([len(word)], pa.int64()),
                        *(pa.array([packed(x)], pa.binary()) for x in (word, times, place, rank[index])),
                        _one(np.bincount(doc, minlength=len(data)).astype(np.int32), pa.int32()),
                        pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), _one(learn, pa.bool_()),
                    ],
                    names=["chunk", "words", "word", "times", *_TEXTS],
                )

    return documents.mapInArrow(run, _CHUNKS)


def _runs_of(batches, key: str):
    """The rows of each value of ``key`` in sorted batches."""
    for table, starts in complete_runs(batches, [key]):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            yield table.slice(a, b - a)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _cuts(sorted_buckets: np.ndarray) -> np.ndarray:
    """Where each run of equal buckets begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1])), len(sorted_buckets))


K = DISCOUNTED
_WORDS = "bucket int, chunk long, n binary, number binary, tie binary, stats array<double>"


def _words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Answers to every chunk on its words: their training counts in the corpus, their numbers, and their places among words of
    the same count, which with the count name a word as well; a row of sums per bucket."""

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                word, times = unpacked(row.column("word")[0].as_py(), np.uint64), unpacked(row.column("times")[0].as_py())
                bucket = _range_of(word, buckets)
                cuts = _cuts(bucket)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, row.column("chunk")[0].as_py())),
                        *(pa.array([packed(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (word, times)),
                    ],
                    names=["bucket", "chunk", "word", "times"],
                )

    def count(batches):
        for table in _runs_of(batches, "bucket"):
            bucket = table.column("bucket")[0].as_py()
            sizes = [entries(b) for b in table.column("word").to_pylist()]
            word, of = np.unique(_joined(table.column("word"), np.uint64), return_inverse=True)
            total = np.bincount(of, weights=_joined(table.column("times"))).astype(np.int64)
            order = np.lexsort((word, -total))
            rank = np.empty(len(word), dtype=np.int64)
            rank[order] = np.arange(len(word))
            number = rank * buckets + bucket + 1
            tie = (rank - np.searchsorted(-total[order], -total)) * buckets + bucket
            at = np.cumsum([0, *sizes])
            stats = [float(total.sum()), float((total > 0).sum()), *(float((total == r).sum()) for r in range(1, K + 2))]
            answers = [[packed(x[of[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)] + [None] for x in (total, number, tie)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket] * (len(sizes) + 1), pa.int32()), pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                    *(pa.array(x, pa.binary()) for x in answers), pa.array([None] * len(sizes) + [stats], pa.list_(pa.float64())),
                ],
                names=["bucket", "chunk", "n", "number", "tie", "stats"],
            )

    dealt = chunks.select("chunk", "word", "times").mapInArrow(deal, "bucket int, chunk long, word binary, times binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _WORDS)


#: count, number and tie of every word of the chunk, one more for the beginning; split: the histories dealt over several buckets.
_NUMBERED = "chunk long, count binary, number binary, tie binary, split array<long>, " + ", ".join(f"{c} {t}" for c, t in _TEXTS.items() if c != "place")


def _with_columns(df: DataFrame, bucket, types: dict[str, str]) -> DataFrame:
    return df.select("chunk", bucket.alias("bucket"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _numbered(chunks: DataFrame, words: DataFrame, deal: Deal) -> DataFrame:
    types = {**_TEXTS, "n_answer": "binary", "number": "binary", "tie": "binary"}
    told = words.where("chunk is not null").withColumnRenamed("n", "n_answer")

    def run(batches):
        for table in _runs_of(batches, "chunk"):
            row = table.slice(0, 1)
            place = unpacked(row.column("place")[0].as_py())
            count, number, tie = (np.append(_joined(table.column(c))[place], 0) for c in ("n_answer", "number", "tie"))
            # the end has the smallest hash; a text begins as often as one ends
            ends = np.flatnonzero(place == 0)[0]
            count[-1], number[-1] = count[ends], _BEGIN
            split = (count >= deal.part) & ((count >= deal.least) | (number == _BEGIN))
            split[ends] = False
            yield pa.RecordBatch.from_arrays(
                [
                    row.column("chunk").combine_chunks(), *(pa.array([packed(x)], pa.binary()) for x in (count, number, tie)),
                    _one(number[split], pa.int64()), *(row.column(c).combine_chunks() for c in _TEXTS if c != "place"),
                ],
                names=["chunk", "count", "number", "tie", "split", *list(_TEXTS)[1:]],
            )

    both = _with_columns(chunks, F.lit(-1), types).unionByName(_with_columns(told, F.col("bucket"), types))
    return both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, _NUMBERED)


class Deal(NamedTuple):
    """How pairs are dealt out: the least count of a history, the buckets, and the tokens of a history's part."""

    least: int
    buckets: int
    part: int


class Pairs:
    """The distinct (history, word) pairs of a chunk, the pair of every token, and those with a history in the order they are dealt."""

    def __init__(self, row: pa.Table, deal: Deal):
        self.count, number = (unpacked(row.column(c)[0].as_py()) for c in ("count", "number"))
        token, self.n = unpacked(row.column("token")[0].as_py()), _flat(row, "n")
        history = np.empty(len(token), dtype=np.int64)
        history[1:] = token[:-1]
        history[np.cumsum(self.n) - self.n] = len(number) - 1
        key, self.of = np.unique(token * len(number) + history, return_inverse=True)
        self.word, self.history = key // len(number), key % len(number)
        n_u = self.count[self.history]
        dealt = np.flatnonzero(np.where(self.history == len(number) - 1, n_u > 0, n_u >= deal.least))
        w, u = number[self.word[dealt]].view(np.uint64), number[self.history[dealt]].view(np.uint64)
        parts = (n_u[dealt] // deal.part + 1).astype(np.uint64)
        part = ((w * _MIX) ^ (w * _MIX >> np.uint64(32))) % parts
        bucket = _bucket_of(u * _MIX2 + part, deal.buckets)
        order = np.lexsort((w, u, bucket))
        #: pairs as they are dealt, and their buckets
        self.dealt, self.bucket = dealt[order], bucket[order]
        u = u[order]
        new = np.append(True, (self.bucket[1:] != self.bucket[:-1]) | (u[1:] != u[:-1])) if len(u) else np.empty(0, dtype=bool)
        #: first pair of every run of one history in a bucket, its number and whether it is dealt over several buckets
        self.first, self.run_of = np.flatnonzero(new), np.cumsum(new) - 1
        self.run_number, self.run_split = u[self.first].view(np.int64), parts[order][self.first] > 1


_DEALT = "bucket int, chunk long, run binary, length binary, tie binary, times binary, below binary"


def _dealt(numbered: DataFrame, deal: Deal) -> DataFrame:
    """Pairs of every chunk by bucket, as runs of one history: the words by their counts in the corpus and ties, and the pair's
    training count in the chunk. A run is twice the number of its history, one more if that is dealt over several buckets."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                p = Pairs(row, deal)
                if not len(p.dealt):
                    continue
                learn = np.repeat(_flat(row, "learn"), p.n)
                times = np.bincount(p.of, weights=learn, minlength=len(p.word)).astype(np.int64)[p.dealt]
                word = p.word[p.dealt]
                below, tie = p.count[word], unpacked(row.column("tie")[0].as_py())[word]
                cuts = _cuts(p.bucket)
                runs = np.searchsorted(p.first, cuts)
                length = np.diff(np.append(p.first, len(p.dealt)))
                by_run = (p.run_number * 2 + p.run_split, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, row.column("chunk")[0].as_py())),
                        *(pa.array([packed(x[a:b]) for a, b in zip(runs[:-1], runs[1:], strict=True)], pa.binary()) for x in by_run),
                        *(pa.array([packed(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (tie, times, below)),
                    ],
                    names=["bucket", "chunk", "run", "length", "tie", "times", "below"],
                )

    return numbered.select("chunk", "count", "number", "tie", "token", "n", "learn").mapInArrow(run, _DEALT)


#: kind a: an answer to chunk a; s: sums of history a, dealt over several buckets; c: types that occur 1, 2, ..., K + 1 times.
_FOUND = "kind string, bucket int, a long, pairs binary, sums binary, v array<double>"
#: Sums of a history: types that occur 1, ..., K times and the counts above K; the same by the counts of its words alone.
WIDTH = 2 * K + 2


def _bucket(table: pa.Table) -> pa.RecordBatch:
    """The counts of one bucket: an answer to every chunk, and sums of histories that other buckets hold as well."""
    sizes = [entries(b) for b in table.column("tie").to_pylist()]
    run_sizes = [entries(b) for b in table.column("run").to_pylist()]
    run, tie, n, below = (_joined(table.column(c)) for c in ("run", "tie", "times", "below"))
    history, run_of = np.unique(run, return_inverse=True)
    u = np.repeat(run_of, _joined(table.column("length")))
    order = np.lexsort((tie, below, u))
    tie, u, n, below = tie[order], u[order], n[order], below[order]
    new = np.append(True, (tie[1:] != tie[:-1]) | (below[1:] != below[:-1]) | (u[1:] != u[:-1]))
    pair_of = np.cumsum(new) - 1
    count = np.bincount(pair_of, weights=n).astype(np.int64)
    answer = np.empty(len(order), dtype=np.int64)
    answer[order] = count[pair_of]
    types = count > 0
    of, c, c1 = u[new][types], count[types], below[new][types]
    sums = np.empty((WIDTH, len(history)), dtype=np.int64)
    for at, counts in ((0, c), (K + 1, c1)):
        for r in range(1, K + 1):
            sums[at + r - 1] = np.bincount(of[counts == r], minlength=len(history))
        sums[at + K] = np.bincount(of, weights=np.where(counts > K, counts, 0), minlength=len(history))
    at, run_at = np.cumsum([0, *sizes]), np.cumsum([0, *run_sizes])
    shared = np.flatnonzero(history & 1)
    chunks, rest = table.num_rows, len(shared) + 1
    classes = [float((c == r).sum()) for r in range(1, K + 2)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["a"] * chunks + ["s"] * len(shared) + ["c"]), pa.array([table.column("bucket")[0].as_py()] * (chunks + rest), pa.int32()),
            pa.array([*table.column("chunk").to_pylist(), *(history[shared] >> 1).tolist(), None], pa.int64()),
            pa.array([packed(answer[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] + [None] * rest, pa.binary()),
            pa.array([packed(sums[:, run_of[a:b]]) for a, b in zip(run_at[:-1], run_at[1:], strict=True)] + [None] * rest, pa.binary()),
            pa.array([None] * chunks + sums[:, shared].T.astype(np.float64).tolist() + [classes], pa.list_(pa.float64())),
        ],
        names=["kind", "bucket", "a", "pairs", "sums", "v"],
    )


def _counted(dealt: DataFrame) -> DataFrame:
    def run(batches):
        for table in _runs_of(batches, "bucket"):
            yield _bucket(table)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


class Model:
    """Everything a chunk needs beside its counts; ``d1`` and ``d2`` are the discounts of the counts 1 to K."""

    def __init__(self, d1: list[float], d2: list[float], total: int, types: int, unknown: float):
        self.kept, self.kept_below = (np.array([*((r + 1) * x for r, x in enumerate(d)), 1.0]) for d in (d2, d1))
        self.d1, self.d2 = (np.log10(np.array([1.0, *d, 1.0])) for d in (d1, d2))
        self.total, self.types, self.unknown = total, types, unknown

    def weight(self, times: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """log10 of the backoff weight of histories that occur ``times`` times: what their seen words leave, over what these
        leave as unigrams."""
        kept, below = sums[:, : K + 1] @ self.kept, sums[:, K + 1 :] @ self.kept_below
        return np.log10((1 - kept / (times + 1)) / (1 - below / (self.total + 1)))

    def scores(self, c_history, weight, c_pair, c_word) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each pair, and its part of the base score; the count of what is no history is 0."""
        known = c_word > 0
        low = np.where(known, np.log10(np.maximum(c_word, 1)) + self.d1[np.minimum(c_word, K + 1)] - np.log10(self.total + 1), np.log10(self.unknown))
        seen = np.log10(np.maximum(c_pair, 1)) + self.d2[np.minimum(c_pair, K + 1)] - np.log10(c_history + 1.0)
        katz = np.where(c_history == 0, low, np.where(c_pair > 0, seen, weight + low))
        return katz, np.log10(c_word + 0.1) - np.log10(self.total + 0.1 * (self.types + 1))


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


#: Place of the sums of shared histories behind the answers of all buckets.
_LAST = 2**31 - 1


def _shared(numbered: DataFrame, counted: DataFrame) -> DataFrame:
    """(chunk, history, v): the whole sums of every history of a chunk that is dealt over several buckets."""
    sums = [F.sum(F.col("v")[i]) for i in range(WIDTH)]
    whole = saved(counted.where("kind = 's'").groupBy(F.col("a").alias("history")).agg(F.array(*sums).alias("v")), "histories")
    asked = numbered.select("chunk", F.explode("split").alias("history"))
    if whole.count() <= SENT_ROWS:
        return asked.join(F.broadcast(whole), "history")
    salted = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return asked.withColumn("salt", F.pmod("chunk", F.lit(SALT)).cast("int")).join(salted, ["history", "salt"]).drop("salt")


def _scored(numbered: DataFrame, counted: DataFrame, model: Model, deal: Deal) -> DataFrame:
    """Scores of the texts of every chunk, whose answers come to it in the order of the buckets, shared histories last."""
    types = {
        **{c: t for c, t in _TEXTS.items() if c not in ("place", "learn")}, "count": "binary", "number": "binary",
        "pairs": "binary", "sums": "binary", "history": "long", "v": "array<double>",
    }
    told = counted.where("kind = 'a'").select(F.col("a").alias("chunk"), "bucket", "pairs", "sums")
    rows = [
        _with_columns(numbered, F.lit(-1), types), _with_columns(told, F.col("bucket"), types),
        _with_columns(_shared(numbered, counted), F.lit(_LAST), types),
    ]

    def run(batches):
        for table in _runs_of(batches, "chunk"):
            row = table.slice(0, 1)
            p = Pairs(row, deal)
            c_pair, c_history, weight = (np.zeros(len(p.word), dtype=t) for t in (np.int64, np.int64, np.float64))
            if len(p.dealt):
                c_pair[p.dealt] = _joined(table.column("pairs"))
                c_history[p.dealt] = p.count[p.history[p.dealt]]
                sums = np.concatenate([unpacked(b).reshape(WIDTH, -1) for b in table.column("sums").to_pylist() if b is not None], axis=1).T
                if p.run_split.any():
                    behind = table.filter(pc.is_valid(table.column("history")))
                    whole = dict(zip(behind.column("history").to_pylist(), behind.column("v").to_pylist(), strict=True))
                    sums[p.run_split] = [whole[h] for h in p.run_number[p.run_split].tolist()]
                weight[p.dealt] = model.weight(c_history[p.dealt][p.first], sums)[p.run_of]
            c_word = p.count[p.word]
            katz, base = model.scores(c_history, weight, c_pair, c_word)
            at = np.cumsum(p.n) - p.n
            added = [np.add.reduceat(x[p.of], at) for x in ((c_word > 0).astype(np.int64), base, katz)]
            yield pa.RecordBatch.from_arrays(
                [row.column("doc_id").combine_chunks().flatten(), pa.array(p.n.astype(np.int64)), *map(pa.array, added)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, _SCORES)


def scores(documents: DataFrame, history_share: float = HISTORY_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    Tokens are the words of the text, A-Z lower-cased, and one end. Learnt from the rows that are not held out. base_score
    is the unigram sum with 0.1 added to each count; score the log10 probability of the text under the Katz model. Null and
    empty texts are an end alone. Without any training row all scores are those of the unknown word, 0. Repeated rows stay
    repeated rows (and count as often); a null doc_id is learnt from; other columns play no part; an empty table gives no
    rows. A pair of words costs one entry per chunk in its bucket, however often it occurs.
    """
    docs = text_only(documents, F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    chunks = saved(chunked(docs, CHUNK_BYTES), "chunks")
    tokens, distinct = chunks.agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")), F.sum("words")).first()
    word_buckets = max(8, (distinct or 0) // BUCKET_TOKENS)
    words = saved(_words(chunks, word_buckets), "words")
    total, types, *c1 = (int(x or 0) for x in words.agg(*[F.sum(F.col("stats")[i]) for i in range(K + 3)]).first())
    d1 = discounts([float(x) for x in c1])
    mass = (sum(r * d * n for r, d, n in zip(range(1, K + 1), d1, c1)) + total - sum(r * n for r, n in zip(range(1, K + 1), c1))) / (total + 1)
    deal = Deal(math.ceil(max(1, total * history_share)), max(8, (tokens or 0) // BUCKET_TOKENS), SPLIT_TOKENS)
    numbered = saved(_numbered(chunks, words, deal), "numbered")
    counted = saved(_counted(_dealt(numbered, deal)), "counts")
    c2 = counted.where("kind = 'c'").agg(*[F.sum(F.col("v")[i]) for i in range(K + 1)]).first()
    model = Model(d1, discounts([float(x or 0) for x in c2]), total, types, 1 - mass)
    scored = _scored(numbered, counted, model, deal)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
