"""SimHash fingerprints of word shingles, and their links within a Hamming distance by the generalised pigeonhole.

The 64 bits are dealt into groups of correlated bits. Group i gets a threshold t_i >= -1, all of them with the sum
distance - groups + 1: two fingerprints within ``distance`` differ in at most t_i bits of some group i, else they would
differ in sum(t_i + 1) = distance + 1 bits. Thresholds and number of groups are those of the least estimated cost, found
by dynamic programming. For a group of threshold t, a fingerprint is probed under every choice of t of its bits, with
these bits masked out; fingerprints that meet under a mask are compared in full. The choice changes the cost, never the
result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import Forest, counted, in_blocks, pairs_in_runs, per_block_pair, saved, text_only, texts, words_of
from tianguis.llm.components import components

BITS = 64
#: Fingerprints (those with the smallest hashes) on which costs and correlations are estimated.
SAMPLE = 4096
#: Cost of a probe row against that of a compared pair.
ROW_COST, PAIR_COST = 40.0, 1.0


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority of the XXH64 (seed 42) of all shingles, bit by bit; 0 of no words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashed = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = ends - [len(w) + 1 for w in words]
        digest = xxhash.xxh64_intdigest
        hashed = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashed), 65536):
        part = np.array(hashed[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashed), bitorder="little").tobytes(), "little")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed 64-bit number; of null and empty texts it is 0."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(words_of(t), shingle) for t in texts(batch)], dtype=np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    docs = text_only(documents, F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal width; each starts with a free bit and takes those most correlated with it."""
    sample = sample if len(sample) else np.zeros(1, dtype=np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    alike = np.abs(centred.T @ centred) / np.outer(norm, norm)
    free, groups = list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (alike[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _costs(sample: np.ndarray, group: list[int], rows: int, most: int) -> list[float]:
    """Estimated cost of the thresholds -1, 0, ..., ``most`` in one group."""
    mask = np.uint64(sum(1 << b for b in group))
    half = len(sample) // 2
    apart = np.bitwise_count((sample[:half, None] ^ sample[None, half : 2 * half]) & mask) if half else np.zeros((1, 1), int)
    out = [0.0]
    for t in range(most + 1):
        # a pair at distance d of the group meets under comb(width - d, t - d) masks
        meets = sum((apart == d).sum() * comb(len(group) - d, t - d) for d in range(t + 1)) / apart.size
        floor = comb(len(group), t) / 2 ** (len(group) - t)
        out.append(ROW_COST * rows * comb(len(group), t) + PAIR_COST * rows * rows / 2 * max(meets, floor))
    return out


def allocation(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """Bit groups with thresholds that sum to distance - groups + 1, of the least estimated cost."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, distance + 2):
        groups = _bit_groups(sample, m)
        most = min(distance, 3)
        goal = distance - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            costs, nxt = _costs(sample, group, rows, most), {}
            for total, (cost, chosen) in table.items():
                for t in range(-1, most + 1):
                    now = (cost + costs[t + 1], [*chosen, t])
                    if total + t not in nxt or now < nxt[total + t]:
                        nxt[total + t] = now
            table = nxt
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], list(zip(groups, table[goal][1], strict=True)))
    return best[1]


def masks(allocated: list[tuple[list[int], int]]) -> list[int]:
    """Signed 64-bit masks of all probes."""
    out = []
    for group, t in allocated:
        if t >= 0:
            for gone in combinations(group, t):
                mask = sum(1 << b for b in group if b not in gone)
                out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all those within ``distance`` bits."""
    rows = max(2, classes.count())
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    chosen = masks(allocation(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), rows, distance))
    probes = F.posexplode(F.array(*[F.lit(m).cast("long") for m in chosen])).alias("_probe", "_mask")
    probed = classes.select("fp", probes).select("fp", F.xxhash64("_probe", F.col("fp").bitwiseAND(F.col("_mask"))).alias("_key"))

    def compare(table, starts):
        fp = table.column("fp").to_numpy()
        block = table.column("block").to_numpy()
        i, j = table.column("block_i").to_numpy(), table.column("block_j").to_numpy()
        raw, forest, kept = fp.view(np.uint64), Forest(), ([], [])
        for x, y in pairs_in_runs(starts, len(fp)):
            near = (np.bitwise_count(raw[x] ^ raw[y]) <= distance) & ((i[x] == j[x]) | (block[x] != block[y]))
            for a, b in zip(fp[x[near]].tolist(), fp[y[near]].tolist(), strict=True):
                if forest.join(a, b):
                    kept[0].append(a)
                    kept[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64())], names=["a", "b"])

    return per_block_pair(in_blocks(probed, "_key", "fp"), "_key", compare, "a long, b long")


def _grouped(table: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id): the group of every fingerprint, and the smallest doc_id in it."""
    classes = saved(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes, distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(reached, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    # written, so that the join sees two plain shuffles and a group of very many fingerprints may be split
    smallest = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest doc_id reachable over links.

    Fingerprints at ``distance`` or fewer differing bits are linked; equal ones are one class and never paired, so copies
    cost nothing. Null texts count as empty and have fingerprint 0, linked like any other. A row whose doc_id is null
    takes part under its fingerprint, and gets the smallest doc_id of its component (null if there is none). Repeated rows
    stay repeated rows; other columns play no part; an empty table gives no rows.
    """
    table = saved(fingerprints(documents, shingle), "fingerprints")
    named = _grouped(table, distance).select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, rows without one last, then the smallest hash of the text.

    Rows are told apart by doc_id and text, so an id that stands for several texts is decided for each of them.
    """
    table = saved(fingerprints(documents, shingle), "fingerprints")
    rows = saved(table.groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n")), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    # A minimum per fingerprint, then one per group, both combined before they move: no row is joined with its group.
    classes = rows.groupBy("fp").agg(F.min(rank).alias("best"), F.min("doc_id").alias("least"))
    classes = saved(classes, "classes")
    reached = components(links(classes, distance)).withColumnRenamed("node", "fp")
    root = F.coalesce("component", "fp").alias("root")
    best = classes.join(reached, "fp", "left").select(root, "best").groupBy("root").agg(F.min("best").alias("best"))
    best = saved(best.select("best.*"), "best")
    first = best.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))

    def same(id_: str, hash_: str):
        return F.col(id_).eqNullSafe(F.col("_id")) & (F.col(hash_) == F.col("_hash"))

    gone = rows.join(first, same("doc_id", "text_hash"), "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    again = best.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    columns = documents.columns
    keyed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), _text_hash().alias("_text")
    )
    kept = keyed.join(counted(gone, "gone"), same("_doc", "_text"), "left_anti")
    again = counted(again, "again")
    one = kept.join(again, same("_doc", "_text"), "left_semi").dropDuplicates(["_doc", "_text"])
    both = kept.join(again, same("_doc", "_text"), "left_anti").unionByName(one)
    return both.select(*[F.col(f"_row.`{c}`") for c in columns])
