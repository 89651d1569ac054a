"""Repair of conversation structure: faults counted, then the cheapest edits that give a legal sequence of roles.

Rows are dealt out by range of (conversation, turn, ...) and sorted, so a conversation of any size may lie in several
partitions. One that lies within a partition and is short is settled there. Of the others every piece is a chunk:
chunks run the backward costs from a guessed vector at the same time, fix-up passes hand each chunk the vector its right
neighbour begins with and run it again until nothing but a constant changes, and the edits are traced from the stitched
costs. A pass lets a task go through eight times as many neighbouring chunks as the one before, so the number of passes grows
with the logarithm of the chunks even if vectors never meet. Only what needs the whole text in order, the digest of
the repaired conversation, walks through a conversation's chunks one after the other, holding one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tianguis.llm import turns
from tianguis.llm.common import saved

#: Rows and bytes of text after which a conversation is cut into a further chunk.
CHUNK_ROWS = 4096
CHUNK_BYTES = 8 << 20
#: Neighbouring chunks that one task of a fix-up pass goes through, raised to the pass's number.
FAN = 8
#: Rows of results sent at once.
BATCH_ROWS = 2048

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, position long, edit string, role string, text string"
_CHUNK = "conv_id long, part int, seq int, turns array<bigint>, roles array<binary>, texts array<binary>"
_NULL = " "


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped after the damage that crc32 of ``conv_id:turn`` modulo 20 names.

    Null role and text, and null ids and turns within the checksum's text, count as one space. 0 drops the row (it stays, marked,
    so that its conversation is known), 1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats
    the row, 4 makes the user its author.
    """
    spoken = {c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(spoken["conv_id"], F.lit(":"), spoken["turn"])) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        spoken["role"].alias("role"), spoken["text"].alias("text"), fault.alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("dropped"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


class _Faults:
    """Counts over the rows of a conversation in order, and the code of each row."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = self.kind = None

    def code(self, turn: int | None, role: bytes, text: bytes, is_new: Callable[[bytes, bytes], bool]) -> int:
        kind = turns.kind_of(role)
        if self.kind is not None and not turns.legal(self.kind, kind):
            self.illegal += 1
        self.kind = kind
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.distinct += 1
            self.last_turn = turn
        told = text.rstrip(turns.BLANKS)
        if not told:
            self.blank += 1
            return kind | turns.LOST
        if not is_new(role, text):
            self.duplicate += 1
            return kind | turns.LOST
        if told[-1] not in b".!?":
            self.truncated += 1
            return kind | turns.CUT
        return kind

    def report(self, cost: int, audit: str, digest: str) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


class _Repair:
    """Edits of a conversation, traced forward row by row."""

    def __init__(self, conv: int | None, rows: list | None):
        self.conv, self.rows = conv, rows
        self.state, self.cost, self.edits, self.hash, self.said = turns.START, 0, bytearray(), hashlib.sha256(), 0

    def take(self, edits: str, role: bytes = b"", text: bytes = b"", code: int = 0, to: int | None = None) -> None:
        for edit, kind in turns.after_edit(edits, self.state):
            self.edits += edit.encode()
            if edit == "D":
                self.cost += turns.DELETE
                self._row(edit, role, text)
                continue
            if edit == "I":
                self.cost += turns.INSERT
                self._say(edit, turns.ROLES[kind], b"")
                continue
            self.cost += (turns.REROLE if edit == "R" else 0) + (turns.TRUNCATED if code & turns.CUT else 0)
            self._say(edit, turns.ROLES[kind] if edit == "R" else role, text)
        self.state = self.state if to is None else to

    def _say(self, edit: str, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.said else b"") + role + b":" + text)
        self.said += 1
        self._row(edit, role, text)

    def _row(self, edit: str, role: bytes, text: bytes) -> None:
        if self.rows is not None:
            self.rows.append((self.conv, len(self.edits), edit, role, text))

    def walk(self, rows: list[tuple], codes: bytes, end: turns.Vector) -> None:
        vectors, _ = turns.backward(codes, end)
        for (_, role, text), code, after in zip(rows, codes, vectors[1:], strict=True):
            edits, to = turns.moves(after, code, self.state)
            self.take(edits, role, text, code, to)

    def close(self) -> None:
        self.take(turns.last_moves(self.state))


def _settled(conv: int | None, rows: list[tuple], edits: list | None) -> tuple:
    """The report of a conversation whose rows are all here; its edited rows go to ``edits``."""
    seen: set[tuple[bytes, bytes]] = set()

    def is_new(role: bytes, text: bytes) -> bool:
        before = len(seen)
        seen.add((role, text))
        return len(seen) > before

    faults = _Faults(conv)
    codes = bytes(faults.code(*row, is_new) for row in rows)
    repair = _Repair(conv, edits)
    repair.walk(rows, codes, turns.FINAL)
    repair.close()
    return faults.report(repair.cost, repair.edits.decode(), repair.hash.hexdigest())


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
        "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch], chunk_rows: int, chunk_bytes: int) -> Iterator[tuple]:
    """(conv, rows, whole) of a sorted partition; a piece that may go on elsewhere or is one of several is not whole."""
    first, conv, rows, size, cut = True, None, None, 0, False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for c, turn, role, text, dropped in zip(*columns, strict=True):
            if rows is None or c != conv:
                if rows is not None:
                    yield conv, rows, not (first or cut)
                    first = False
                conv, rows, size, cut = c, [], 0, False
            if dropped:
                continue
            if len(rows) >= chunk_rows or size >= chunk_bytes:
                yield conv, rows, False
                rows, size, cut = [], 0, True
            rows.append((turn, role, text))
            size += len(text)
    if rows is not None:
        yield conv, rows, False


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows in order. Rows of one turn come by role and text; equal rows may be parted, so no value is too frequent for a task."""
    text = F.col("text").cast("string")
    named = rows.select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"), text.cast("binary").alias("text"), "dropped",
        F.substring(text, 1, 32).cast("binary").alias("head"), F.xxhash64(text).alias("mix"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "mix", "row"]
    return named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "dropped")


def _solved(rows: DataFrame, edits: bool, chunk_rows: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(reports or edits of conversations settled at once, chunks of all others)."""
    out_ddl = EDITS if edits else REPORT
    schema = _arrow(f"{out_ddl.replace('conv_id', 'conv', 1)}, {_CHUNK}")
    n_out = len(out_ddl.split(", "))
    no_chunk = (None,) * (len(schema) - n_out)

    def run(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for conv, piece, whole in _pieces(batches, chunk_rows, chunk_bytes):
            if whole:
                texts = [] if edits else None
                report = _settled(conv, piece, texts)
                held += [(*r, *no_chunk) for r in (_decoded(texts) if edits else [report])]
            else:
                columns = [list(c) for c in zip(*piece, strict=True)] if piece else [[], [], []]
                yield _batch([(*[None] * n_out, conv, part, seq, *columns)], schema)
                seq += 1
            if len(held) >= BATCH_ROWS:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    found = saved(_ranged(rows).mapInArrow(run, f"{out_ddl.replace('conv_id', 'conv', 1)}, {_CHUNK}"), "conversations")
    names = [c.split(" ")[0] for c in out_ddl.split(", ")]
    whole = found.where("part is null").select(F.col("conv").alias("conv_id"), *names[1:])
    return whole, found.where("part is not null").select("conv_id", "part", "seq", "turns", "roles", "texts")


def _decoded(rows: list[tuple]) -> list[tuple]:
    return [(c, p, e, role.decode(errors="replace"), text.decode(errors="replace")) for c, p, e, role, text in rows]


def _key(role: bytes, text: bytes) -> bytes:
    """128 bits that stand for a role and text."""
    return hashlib.blake2b(len(role).to_bytes(4, "little") + role + text, digest_size=16).digest()


def _chunk_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _coded(chunks: DataFrame) -> DataFrame:
    """Chunks with their rows' codes and counts: conv_id, part, seq, place (1 is the last chunk), turns, roles, texts, codes.

    A row is new where its chunk is the first of the conversation that holds its role and text; the first chunks are told which
    ones those are, at most as many as they have rows.
    """
    keys = chunks.mapInArrow(_keys_of, "conv_id long, part int, seq int, key binary")
    first = keys.groupBy("conv_id", "key").agg(F.min(F.struct("part", "seq")).alias("at"))
    fresh = first.groupBy(F.col("at.part").alias("part"), F.col("at.seq").alias("seq")).agg(F.collect_list("key").alias("fresh"))
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("part"), F.desc("seq"))
    places = chunks.select("conv_id", "part", "seq").select("part", "seq", F.row_number().over(from_end).alias("place"))
    joined = chunks.join(places, ["part", "seq"]).join(fresh, ["part", "seq"], "left")
    schema = _arrow("conv_id long, part int, seq int, place int, turns array<bigint>, roles array<binary>, texts array<binary>, codes binary")

    def run(batches):
        for batch in batches:
            for c in _chunk_rows(batch):
                new = set(c["fresh"] or ())
                faults = _Faults(c["conv_id"])
                codes = bytes(
                    faults.code(turn, role, text, lambda r, t: _taken(new, _key(r, t)))
                    for turn, role, text in zip(c["turns"], c["roles"], c["texts"], strict=True)
                )
                yield _batch([tuple(c[n] for n in schema.names[:-1]) + (codes,)], schema)

    ddl = _CHUNK.replace("seq int,", "seq int, place int,") + ", codes binary"
    return saved(joined.mapInArrow(run, ddl), "coded")


def _taken(new: set[bytes], key: bytes) -> bool:
    found = key in new
    new.discard(key)
    return found


def _keys_of(batches):
    schema = _arrow("conv_id long, part int, seq int, key binary")
    for batch in batches:
        for c in _chunk_rows(batch):
            keys = {_key(r, t) for r, t in zip(c["roles"], c["texts"], strict=True)}
            if keys:
                yield _batch([(c["conv_id"], c["part"], c["seq"], k) for k in keys], schema)


_STATE = "conv_id long, place int, codes binary, end array<int>, begin array<int>, changed int"


def _ends(coded: DataFrame) -> DataFrame:
    """conv_id, place, end: the vector of backward costs behind every chunk, right up to a constant."""
    state_schema = _arrow(_STATE)

    def guess(batches):
        for batch in batches:
            for c in _chunk_rows(batch):
                end = turns.FINAL if c["place"] == 1 else turns.GUESS
                vectors, _ = turns.backward(c["codes"], end)
                yield _batch([(c["conv_id"], c["place"], c["codes"], end, vectors[0], 0)], state_schema)

    def fix(batches):
        conv = group = incoming = None
        begun = False
        for batch in batches:
            for c in _chunk_rows(batch):
                if not begun or (c["conv_id"], c["stretch"]) != (conv, group):
                    conv, group, begun = c["conv_id"], c["stretch"], True
                    incoming = tuple(c["given"] or turns.FINAL)
                old, begin = tuple(c["end"]), tuple(c["begin"])
                now = turns.refitted(c["codes"], old, incoming, begin)
                yield _batch([(c["conv_id"], c["place"], c["codes"], incoming, now, int(now != begin))], state_schema)
                incoming = now

    state = saved(coded.select("conv_id", "codes", "place").mapInArrow(guess, _STATE), "costs")
    stretch, chunks = 1, state.agg(F.max("place")).first()[0] or 0
    while chunks > 1:
        right = Window.partitionBy("conv_id").orderBy("place")
        given = state.select("conv_id", "place", "codes", "end", "begin", F.lag("begin").over(right).alias("given"))
        stretches = given.withColumn("stretch", F.floor((F.col("place") - 1) / F.lit(stretch)).cast("int"))
        state = saved(
            stretches.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place").mapInArrow(fix, _STATE), "costs"
        )
        if stretch >= chunks or state.agg(F.sum("changed")).first()[0] == 0:
            break
        stretch *= FAN
    return state.select("conv_id", "place", "end")


def _stitched(chunks: DataFrame, edits: bool) -> DataFrame:
    """Reports or edits of conversations in chunks: one pass through each, in order, with one chunk in memory."""
    coded = _coded(chunks)
    ends = _ends(coded)
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at"))
    beside = coded.join(ends.select(F.col("conv_id").alias("of"), F.col("place").alias("at"), "end"), same)
    ordered = beside.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place")).drop("of", "at")
    ddl = EDITS if edits else REPORT
    schema = _arrow(ddl)

    def run(batches):
        faults = repair = None
        for batch in batches:
            for c in _chunk_rows(batch):
                if faults is None:
                    faults = _Faults(c["conv_id"])
                    repair = _Repair(c["conv_id"], [] if edits else None)
                rows = list(zip(c["turns"], c["roles"], c["texts"], strict=True))
                for row, code in zip(rows, c["codes"], strict=True):
                    faults.code(*row, lambda r, t, code=code: not code & turns.LOST)
                repair.walk(rows, c["codes"], tuple(c["end"]))
                last = c["place"] == 1
                if last:
                    repair.close()
                if edits and repair.rows:
                    yield _batch(_decoded(repair.rows), schema)
                    repair.rows.clear()
                if last:
                    if not edits:
                        yield _batch([faults.report(repair.cost, repair.edits.decode(), repair.hash.hexdigest())], schema)
                    faults = None

    return ordered.mapInArrow(run, ddl)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows as the operator takes them; a null role or text is one space."""
    def spoken(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias(c)

    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spoken("role"), spoken("text"), dropped.alias("dropped"))


def audits(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal neighbours, cost, the edits' initials, digest of the repaired text.

    Rows are taken by turn (nulls first), those of one turn by role, then text. Rows marked ``dropped`` only name their
    conversation; one that has no others gives zeros, no edits and the digest of nothing. Null ids are one conversation. Other
    columns play no part, whatever their names; an empty table gives no rows.
    """
    whole, chunks = _solved(_marked(rows), False, chunk_rows, chunk_bytes)
    return whole.unionByName(_stitched(chunks, False))


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The edits themselves: conv_id, position (from 1), edit (K, R, D or I), role and text after it; those not D are the repaired turns."""
    whole, chunks = _solved(_marked(rows), True, chunk_rows, chunk_bytes)
    return whole.unionByName(_stitched(chunks, True))
