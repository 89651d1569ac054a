"""Best-fit packing of token sequences by linear grouping.

Pieces longer than an eighth of a sequence are grouped into equal shares by length, and every length is rounded up to the
largest of its group. Configurations over those few sizes are chosen one after the other, each the fullest that the
remaining counts allow, and applied as often as they allow. The actual pieces then take the places of their groups, and
the small ones go best-fit into what room is left. All of that runs on the histogram of lengths, which has at most
``capacity`` entries whatever the size of the corpus; only the answer to "where does the r-th piece of length n go", a
table of runs bounded in the same way, is sent to the tasks.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tianguis.llm.common import saved, text_only
from tianguis.llm.ragged import text_steps
from tianguis.llm.word_ids import word_ids

#: Groups of equal cardinality of the large lengths, and the share of a sequence from which a length is large.
GROUPS = 256
LARGE = 1 / 8
#: Pieces of one length that are ranked in one group, and the most groups of a length.
RANKED_ROWS = 2_000
RANKED_GROUPS = 65_536
#: Bytes of text that a task turns into ids at a time.
STEP_BYTES = 500_000


@dataclass
class Shape:
    """``count`` sequences alike: the i-th holds, for each (length, rank), the piece of that length and of rank + i."""

    slots: tuple[tuple[int, int], ...]
    count: int
    room: int

    def split(self, n: int) -> tuple[Shape, Shape]:
        return Shape(self.slots, n, self.room), Shape(tuple((s, r + n) for s, r in self.slots), self.count - n, self.room)


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality, largest first: the rounded size and the actual [length, first rank, count]."""
    total = sum(n for _, n in lengths)
    share = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    free = 0
    for size, n in sorted(lengths, reverse=True):
        rank = 0
        while n:
            if not free:
                out.append((size, []))
                free = share
            take = min(n, free)
            out[-1][1].append([size, rank, take])
            rank, n, free = rank + take, n - take, free - take
    return out


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Groups (one entry per place) that start with the largest left and fill the capacity best."""
    first = next(g for g, n in enumerate(left) if n)
    reach, after = 1 << sizes[first], []
    limit = (1 << (capacity + 1)) - 1
    for g in range(first, len(sizes)):
        n = left[g] - (g == first)
        for _ in range(min(n, capacity // sizes[g])):
            more = reach | (reach << sizes[g]) & limit
            if more == reach:
                break
            after.append((g, reach))
            reach = more
    fill, chosen = reach.bit_length() - 1, [first]
    for g, before in reversed(after):
        if not before >> fill & 1:
            chosen.append(g)
            fill -= sizes[g]
    return chosen


def _configurations(groups, capacity: int) -> list[tuple[list[int], int]]:
    sizes = [s for s, _ in groups]
    left = [sum(n for _, _, n in runs) for _, runs in groups]
    out = []
    while any(left):
        chosen = _fullest(sizes, left, capacity)
        need = {g: chosen.count(g) for g in chosen}
        times = min(left[g] // n for g, n in need.items())
        for g, n in need.items():
            left[g] -= n * times
        out.append((chosen, times))
    return out


def _substituted(groups, configurations, capacity: int) -> list[Shape]:
    """The actual lengths in place of their groups."""
    shapes = []
    for chosen, times in configurations:
        slots = []
        for g in chosen:
            runs, need, parts = groups[g][1], times, []
            while need:
                size, rank, n = runs[0]
                take = min(n, need)
                parts.append([size, rank, take])
                need -= take
                if take == n:
                    runs.pop(0)
                else:
                    runs[0] = [size, rank + take, n - take]
            slots.append(parts)
        while slots[0]:
            n = min(parts[0][2] for parts in slots)
            held = tuple((parts[0][0], parts[0][1]) for parts in slots)
            shapes.append(Shape(held, n, capacity - sum(s for s, _ in held)))
            for parts in slots:
                size, rank, have = parts[0]
                parts[0] = [size, rank + n, have - n]
                if have == n:
                    parts.pop(0)
    return shapes


def _best_fit(shapes: list[Shape], small: list[tuple[int, int]], capacity: int) -> list[Shape]:
    """Small lengths, largest first, each into the least room that holds it."""
    by_room: dict[int, list[Shape]] = {}
    for s in shapes:
        by_room.setdefault(s.room, []).append(s)
    rooms = sorted(by_room)

    def put(shape: Shape) -> None:
        if shape.room not in by_room:
            by_room[shape.room] = []
            bisect.insort(rooms, shape.room)
        by_room[shape.room].append(shape)

    for size, n in sorted(small, reverse=True):
        rank = 0
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(Shape(tuple((size, rank + i * full) for i in range(each)), full, capacity - each * size))
                if rest:
                    first = rank + each * full
                    put(Shape(tuple((size, first + i) for i in range(rest)), 1, capacity - rest * size))
                break
            room = rooms[at]
            shape = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            if shape.count > n:
                shape, other = shape.split(n)
                put(other)
            put(Shape((*shape.slots, (size, rank)), shape.count, room - size))
            rank, n = rank + shape.count, n - shape.count
    return [s for held in by_room.values() for s in held]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> dict[str, np.ndarray]:
    """Runs of pieces: the piece of ``length`` and rank r, for the last ``rank`` <= r, is in sequence + r - rank at offset."""
    lengths = [(s, n) for s, n in histogram.items() if n]
    grouped = _grouped([(s, n) for s, n in lengths if s > capacity * large], groups)
    shapes = _substituted(grouped, _configurations(grouped, capacity), capacity)
    shapes = _best_fit(shapes, [(s, n) for s, n in lengths if s <= capacity * large], capacity)
    rows, sequence = [], 0
    for shape in shapes:
        offset = 0
        for size, rank in shape.slots:
            rows.append((size, rank, sequence, offset))
            offset += size
        sequence += shape.count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer_file: str, capacity: int, separator: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of every document; only longer documents are cut."""

    def cut(doc_ids, batch, out):
        flat, counts = word_ids(tokenizer_file).ids(batch)
        flat = flat.astype("<u4")
        at = 0
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            ids = np.append(flat[at : at + n], np.uint32(separator))
            at += n
            for k, start in enumerate(range(0, n + 1, capacity)):
                part = ids[start : start + capacity]
                out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None))

    def run(batches):
        for batch in batches:
            for a, b, data in text_steps(batch.column("text"), STEP_BYTES):
                out: list[tuple] = []
                cut(batch.column("doc_id").slice(a, b - a).to_pylist(), data, out)
                columns = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types[:keep], strict=True)], names=names[:keep])

    docs = text_only(documents, F.col("doc_id").cast("long").alias("doc_id"))
    return docs.mapInArrow(run, _PIECES + (", ids array<long>" if keep_ids else ""))


def pack(documents: DataFrame, tokenizer_file: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every document's ids and one ``separator``, packed into few sequences of at most ``capacity`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if ``keep_ids``.
    Null and empty texts are a separator alone. Rows with equal or null doc_id are packed each for itself; other columns
    play no part. An empty table gives no rows. The rank of a piece among those of its length comes from counts per
    (length, hash bucket), so a length that a third of all pieces share is ranked in many tasks.
    """
    spark = documents.sparkSession
    table = saved(pieces(documents, tokenizer_file, capacity, separator, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, capacity))
    buckets = min(RANKED_GROUPS, max(1, sum(histogram.values()) // RANKED_ROWS))
    dealt = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*table.columns, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("rank"))

    def place(batches):
        r = runs.value
        keys = (r["length"] << 44) | r["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(r["sequence"][at] + rank - r["rank"][at]), pa.array(r["offset"][at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, _PIECES + (", ids array<long>" if keep_ids else "") + ", sequence_id long, offset long")
