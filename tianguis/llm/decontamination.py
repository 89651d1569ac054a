"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingles.

Documents are partitioned by the size of their shingle set, up to the next power of two. A partition has its own number
of bins, twice its largest size; the MinHash signature of a set in it is the smallest hash of each bin that the set
fills (one permutation of the hashes). An item is sketched once for every partition, with that partition's bins, and a
document is a candidate if one bin agrees. At twice as many bins as shingles about four in five of a set's shingles are
the smallest of their bin, so that an item with m shared shingles is missed with a chance of about 0.2^m. Items of too
few shingles for that are looked up under all of their shingles. Every candidate is compared shingle by shingle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import counted, text_only
from tianguis.llm.ragged import PLAIN, Powers, Words, shingles, steps, text_steps

#: Items of fewer shingles are searched under all of them.
SKETCHED = 12
#: Bytes of benchmark text that one pass over the documents takes along.
BLOCK_BYTES = 32 << 20


def _plain(text: str | bytes | None) -> bytes:
    if text is None:
        return b""
    return (text.decode() if isinstance(text, bytes) else text).lower().encode()


def _partition(size: int) -> int:
    return max(0, math.ceil(math.log2(max(size, 1))))


def signature(hashes: np.ndarray, partition: int) -> np.ndarray:
    """The smallest hash in each filled bin of the partition's bins, ascending."""
    hashes = np.unique(hashes)
    bins = hashes >> np.uint64(64 - (partition + 1))
    return hashes[np.append(True, bins[1:] != bins[:-1])] if len(hashes) else hashes


def shingle_set(text: bytes, k: int) -> set[bytes]:
    """Distinct shingles as texts."""
    words = bytes(PLAIN[np.frombuffer(text, dtype=np.uint8)]).split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Items:
    """Benchmark items with their shingles, and their signatures in each partition as they are asked for."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int):
        powers = Powers()
        self.k = k
        self.ids = [i for i, _ in rows]
        texts = [_plain(t) for _, t in rows]
        self.sets = [shingle_set(t, k) for t in texts]
        self._hashes = []
        for a, b in steps([len(t) for t in texts]):
            flat, count = shingles(Words(texts[a:b], PLAIN, powers), k)
            self._hashes += [np.unique(x) for x in np.split(flat, np.cumsum(count)[:-1])]
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, items) of the partition: the bins of the larger items, all shingles of the small ones."""
        if partition not in self._tables:
            held = [signature(h, partition) if len(h) >= SKETCHED else h for h in self._hashes]
            flat = np.concatenate([*held, np.empty(0, dtype=np.uint64)])
            item = np.repeat(np.arange(len(held)), [len(h) for h in held])
            order = np.argsort(flat, kind="stable")
            self._tables[partition] = flat[order], item[order]
        return self._tables[partition]

    def small(self) -> np.ndarray:
        """Sorted hashes of the items that are not sketched."""
        return np.unique(np.concatenate([*(h for h in self._hashes if len(h) < SKETCHED), np.empty(0, dtype=np.uint64)]))

    def candidates(self, hashes: np.ndarray, small: np.ndarray) -> list[int]:
        """Items of which a bin, or for small items a shingle, agrees with the document's hashes."""
        partition = _partition(len(hashes))
        known, item = self.table(partition)
        if not len(known):
            return []
        sketch = signature(hashes, partition)
        if len(small):
            sketch = np.concatenate([sketch, hashes[np.isin(hashes, small)]])
        sketch = sketch[known[np.minimum(np.searchsorted(known, sketch), len(known) - 1)] == sketch]
        low, high = np.searchsorted(known, sketch), np.searchsorted(known, sketch, side="right")
        return sorted({int(i) for a, b in zip(low, high, strict=True) for i in item[a:b]})


_FOUND = "doc_id long, text_hash long, item_id long, n_shared long, n_item long, containment double"


def _search(documents: DataFrame, items, threshold: float) -> DataFrame:
    def run(batches):
        held, powers = items.value, Powers()
        small = held.small()
        for batch in batches:
            doc_ids, text_hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            out: list[tuple] = []
            for a, _, data in text_steps(batch.column("text")):
                data = [_plain(t) for t in data]
                flat, count = shingles(Words(data, PLAIN, powers), held.k)
                for d, h in enumerate(np.split(flat, np.cumsum(count)[:-1]), start=a):
                    found = held.candidates(np.unique(h), small)
                    there = shingle_set(data[d - a], held.k) if found else set()
                    for i in found:
                        shared, total = len(there & held.sets[i]), len(held.sets[i])
                        if shared >= threshold * total:
                            out.append((doc_ids[d], text_hashes[d], held.ids[i], shared, total, shared / total))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (*[pa.int64()] * 5, pa.float64())
            names = ["doc_id", "text_hash", "item_id", "n_shared", "n_item", "containment"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents.mapInArrow(run, _FOUND)


def _keyed(documents: DataFrame) -> DataFrame:
    return text_only(documents, F.col("doc_id").cast("long").alias("doc_id")).withColumn("text_hash", F.xxhash64("text"))


def contaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shared, n_item, containment) for every document and item that it contains.

    Contained: at least ``threshold`` of the item's distinct shingles of ``k`` words are in the document. Words are runs
    without white space and ASCII punctuation, in lower case. A text of fewer than k words has one shingle, of all of
    them; so a very short item is found only in a document that is nothing else. Null and empty texts contain nothing and
    are contained nowhere. Repeated rows on either side give repeated pairs, null ids are carried along, other columns
    play no part. The benchmark is the query set: it is taken along in blocks of bounded size, one pass for each.
    """
    spark = documents.sparkSession
    queries = text_only(benchmark, F.col("item_id").cast("long").alias("item_id"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else queries
        items = Items([(r["item_id"], r["text"]) for r in part.collect()], k)
        found = _search(_keyed(documents), spark.sparkContext.broadcast(items), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``documents`` that contain no item, with all their columns; those without a doc_id too."""
    found = contaminated(documents, benchmark, k, threshold)
    gone = counted(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    columns = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_hash"))
    return packed.join(gone, same, "left_anti").select(*[F.col(f"_row.`{c}`") for c in columns])
