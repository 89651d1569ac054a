"""Ordered admission over several keys at once: a request is granted only if every key it asks for can give what it wants.

A granted request takes from all its keys, a refused one from none, so verdicts depend on each other across keys. Every
undecided request is held against two bounds per key: what is left if all undecided ones before it were granted, and if
none were. A request within the lower bound on all its keys is granted for certain, one above the upper bound on any key
is refused for certain, and each verdict narrows the bounds of those behind it. A round is a prefix sum per key and a window
per request over the undecided rows alone, which cross to their keys and back once and stay out of all later rounds as soon
as their key can give whatever is still asked of it. Where a round settles few requests (a long chain of requests that all
hang on the one before), the first undecided ones are folded one after the other in an array of bounded length besides,
so a round settles that many at least. A refused request needs the first of its rows that failed; rows that may be it stay
in the rounds, taking nothing, until their bounds tell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tianguis.plans import skew
from tianguis.session import stored

HEAD = 500  # requests folded one after the other when a round of bounds settles fewer
GRANTED = "concedido"
CAPACITY, TIMES, INVALID, RANK = "capacidad", "veces", "invalida", "rango"
_ONE = "_unico"


# What a row is in a round: undecided, granted in the round before, or a row of a refused request that may be short.
_OPEN, _TAKES, _WATCHES = 0, 1, 2


@dataclass(frozen=True)
class Admitted:
    """``first``: every row of the requests with the columns kept. ``verdicts``: (group, ``concedido``), once or more often.

    ``failing``: rows of refused requests that fail; the first of every request by ``rango`` is among them. A row fails if it is
    ``invalida`` or asks for more than the granted requests before it left.
    """

    first: DataFrame
    verdicts: DataFrame
    failing: DataFrame


def _parts(rows: DataFrame, key: str) -> list[str]:
    return [key, skew.CHUNK] if skew.CHUNK in rows.columns else [key]


def _side(rows: DataFrame, key: str, capacity: DataFrame | None, **sums: Column) -> DataFrame | None:
    """What the rows of a key, or of a chunk of one, need beside them: ``capacity`` and the sums over its earlier chunks."""
    if skew.CHUNK not in rows.columns:
        return capacity
    side = skew.carried(rows, [key], **{f"_mas_{n}": a for n, a in sums.items()})
    side = side.withColumn(_ONE, F.count("*").over(Window.partitionBy(key)) == 1)
    return side if capacity is None else side.join(capacity, key, "left")


def _beside(rows: DataFrame, key: str, side: DataFrame | None) -> DataFrame:
    return rows if side is None else rows.join(side, _parts(rows, key), "left")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _more(rows: DataFrame, name: str) -> Column:
    """The sum over earlier chunks, 0 where there are none."""
    return F.coalesce(F.col(f"_mas_{name}"), _zero()) if f"_mas_{name}" in rows.columns else _zero()


def admit_all(
    wants: DataFrame, capacity: DataFrame, group: str, key: str, order: Sequence[str], amount: str,
    ready: Callable[[DataFrame], DataFrame], keep: Sequence[str] = (), limits: skew.Limits = skew.DEFAULT, head: int = HEAD,
    count: int = 0, hot: bool = False,
) -> Admitted:
    """Verdicts for every request, in ``order``, which is total over requests and holds ``group``.

    ``wants``: one row per request and key with the order columns and an amount. ``capacity``: (key, ``capacidad``, ``veces``, further
    columns); a key without a row there has nothing, and one with several (``veces``) is asked by each of them for all. ``ready`` adds to the rows beside their capacity ``invalida`` (the request is
    refused in any case), ``rango`` (the place of the row in its request) and the columns to ``keep``. ``hot`` tells that a key has
    more rows than ``limits`` allows in one piece; then the rows, ``count`` of them, are cut into chunks along (key, ``order``).
    """
    wants = wants.withColumn(amount, F.col(amount).cast("bigint")).withColumnRenamed(amount, "_x")
    if hot:
        wants = skew.in_chunks(wants, [key], [F.col(c) for c in order], count, limits, keep=stored)
    parts = _parts(wants, key)
    beside = _beside(wants, key, _side(wants, key, capacity, _antes=F.sum("_x")))
    times = F.coalesce(F.col(TIMES), F.lit(1).cast("bigint"))
    beside = ready(beside.withColumns({"_x": F.col("_x") * times, **{c: F.col(c) * times * times for c in beside.columns if c.startswith("_mas_")}}))
    carried = [c for c in beside.columns if c.startswith("_mas_") or c == _ONE]
    state = list(dict.fromkeys([group, *parts, *order, RANK, "_x", "_hay", "_que"]))
    extra = [INVALID, *keep]
    rows = beside.withColumn("_hay", F.col(CAPACITY)).withColumn("_que", F.lit(_OPEN)).select(*state, *extra, *carried)
    tables: list[DataFrame] = []
    slow = False
    while True:
        narrowed = _narrowed(rows, order, parts)
        if slow:
            narrowed = stored(narrowed.select(*state, "_antes", "_todo"))
            narrowed = narrowed.join(F.broadcast(_by_hand(narrowed.filter(F.col("_que") == _OPEN), group, key, order, head)), group, "left")
        tables.append(stored(_judged(narrowed, group, slow, state if tables else [*state, *extra])))
        undecided, watching = F.col(GRANTED).isNull(), F.col("_duda") & ~F.col("_corta")
        told = tables[-1].agg(
            F.count_if(undecided).alias("u"), F.count_if(watching).alias("w"), F.count_if((F.col("_que") == _OPEN) & ~undecided).alias("v")
        ).first()
        if not told["u"] and not told["w"]:
            break
        slow = 0 < told["u"] and told["v"] < head
        role = F.when(undecided, _OPEN).when(F.col(GRANTED), _TAKES).when(watching, _WATCHES)
        rows = tables[-1].filter(~F.col("_todo")).withColumn("_que", role).filter(F.col("_que").isNotNull()).select(*state)
        side = _side(rows, key, None, _quitado=F.sum(_taken()), _antes=F.sum(F.when(F.col("_que") == _OPEN, F.col("_x"))))
        rows = _beside(rows, key, side)
    verdicts = reduce(DataFrame.unionByName, (t.filter(F.col(GRANTED).isNotNull()).select(group, GRANTED) for t in tables))
    invalid = lambda t: F.col(INVALID) if INVALID in t.columns else F.lit(False)
    failing = reduce(DataFrame.unionByName, (t.filter("_corta").select(group, key, RANK, invalid(t).alias(INVALID)) for t in tables))
    return Admitted(tables[0].select(group, *keep), verdicts, failing)


def _taken() -> Column:
    return F.when(F.col("_que") == _TAKES, F.col("_x")).otherwise(_zero())


def _narrowed(rows: DataFrame, order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Rows without those granted; ``_hay`` is what the granted requests before them left, ``_antes`` what undecided ones may take of it.

    A row that asks for more than ``_hay`` takes nothing, so those behind it in its chunk need not wait for it. ``_todo`` marks the
    rows of keys that can give all that is asked.
    """
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_hay", F.col("_hay") - F.coalesce(F.sum(_taken()).over(inside), _zero()) - _more(rows, "_quitado"))
    wanted = F.when((F.col("_que") == _OPEN) & ~_never(), F.col("_x")).otherwise(_zero())
    rows = rows.withColumn("_antes", F.coalesce(F.sum(wanted).over(inside), _zero()) + _more(rows, "_antes"))
    whole = F.min(F.when(F.col("_que") != _TAKES, _sure())).over(Window.partitionBy(*parts))
    alone = F.coalesce(F.col(_ONE), F.lit(False)) if _ONE in rows.columns else F.lit(True)
    return rows.withColumn("_todo", whole & alone).filter(F.col("_que") != _TAKES)


def _sure() -> Column:
    return F.coalesce(F.col("_x") <= F.col("_hay") - F.col("_antes"), F.lit(False))


def _never() -> Column:
    return F.coalesce(F.col("_x") > F.col("_hay"), F.lit(True))


def _judged(narrowed: DataFrame, group: str, slow: bool, columns: Sequence[str]) -> DataFrame:
    """Rows with the verdict on their request; in a refused one ``_duda`` marks those that may be the first to fail, ``_corta``
    those that fail for certain.
    """
    whole = Window.partitionBy(group)
    invalid = F.coalesce(F.col(INVALID), F.lit(False)) if INVALID in columns else F.lit(False)
    # A key whose capacity is NULL refuses without failing, so it is no reason.
    rows = narrowed.withColumn("_mal", _never() | invalid).withColumn("_falla", F.col("_mal") & (F.col("_hay").isNotNull() | invalid))
    rows = rows.withColumn("_bien", _sure() & ~F.col("_mal"))
    verdict = F.when(F.col("_que") == _WATCHES, F.lit(False)).when(F.min("_bien").over(whole), F.lit(True)).when(F.max("_mal").over(whole), F.lit(False))
    rows = rows.withColumn(GRANTED, F.coalesce(verdict, F.col("_mano")) if slow else verdict)
    first = F.min(F.when(F.col("_falla"), F.col(RANK))).over(whole)
    doubt = (F.col(GRANTED) == F.lit(False)) & (F.col("_falla") | ~(F.col("_bien") | F.col("_mal"))) & F.coalesce(F.col(RANK) <= first, F.lit(True))
    rows = rows.withColumn("_duda", F.coalesce(doubt, F.lit(False)))
    return rows.select(*columns, GRANTED, "_todo", "_duda", (F.col("_duda") & F.col("_falla")).alias("_corta"))


def _by_hand(narrowed: DataFrame, group: str, key: str, order: Sequence[str], head: int) -> DataFrame:
    """The first ``head`` undecided requests, folded in order in one array; nothing undecided stands before them."""
    turn = F.struct(*order)
    first = narrowed.groupBy(group).agg(F.min(turn).alias("_turno")).orderBy("_turno").limit(head)
    item = F.struct(F.col(key).alias("k"), F.col("_x").alias("x"), F.col("_hay").alias("hay"))
    wants = narrowed.join(F.broadcast(first), group).groupBy("_turno", group).agg(F.collect_list(item).alias("pide"))
    lines = wants.agg(F.sort_array(F.collect_list(F.struct("_turno", group, "pide"))).alias("cola"))
    kind = narrowed.schema[key].dataType.simpleString()

    def step(acc: Column, request: Column) -> Column:
        used = acc["used"]
        fits = F.forall(request["pide"], lambda z: z["x"] <= z["hay"] - F.coalesce(F.element_at(used, z["k"]), _zero()))
        mine = F.map_from_entries(F.transform(request["pide"], lambda z: F.struct(z["k"], z["x"])))
        more = F.map_zip_with(used, mine, lambda _, a, b: F.coalesce(a, _zero()) + F.coalesce(b, _zero()))
        return F.struct(F.when(fits, more).otherwise(used).alias("used"), F.concat(acc["out"], F.array(fits)).alias("out"))

    start = F.struct(F.expr(f"cast(map() as map<{kind},bigint>)").alias("used"), F.expr("cast(array() as array<boolean>)").alias("out"))
    verdicts = F.aggregate("cola", start, step, lambda acc: acc["out"])
    zipped = lines.select(F.explode(F.arrays_zip(F.col("cola").alias("c"), verdicts.alias("v"))).alias("z"))
    return zipped.select(F.col(f"z.c.{group}").alias(group), F.col("z.v").alias("_mano"))
