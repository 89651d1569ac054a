"""Guarded decrements in order: a request is granted when it fits into what is left, and only then uses it.

A refused request changes nothing, so a running sum is no answer. Keys with few rows are folded inside
one array. For a key of any size the fold is cut by binary magnitude: while the remainder s lies in
[2^k, 2^(k+1)), requests below 2^k are all granted, requests from 2^(k+1) on are all refused, and the
first granted request in between (or the small one that takes s below 2^k) ends the phase. A phase is a
prefix sum over chunks and a minimum, and every phase lowers k: at most one round per bit of the capacity,
whatever the number of requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tianguis.plans import skew
from tianguis.session import durable

GRANTED, BEFORE, AFTER = "concedido", "antes", "despues"
_OUT = "array<struct<concedido:boolean,antes:bigint,despues:bigint>>"


def admit(
    requests: DataFrame,
    capacity: DataFrame,
    key: str,
    order: Sequence[str],
    amount: str,
    slack: int = 0,
    limits: skew.Limits = skew.DEFAULT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every request with ``concedido``, ``antes`` and ``despues`` (what was left before and after it).

    ``keep`` names columns of ``capacity`` to put beside every request, which saves a join with it later.

    ``capacity`` holds (key, ``capacidad``) as BIGINT; a key without a row there is refused with NULLs.
    Requests of 0 or less are refused, as are those without a key. Requests of equal ``order`` come in the order of their
    other columns, whatever the size of the key. With ``slack`` 1 the capacity
    includes one unit of tolerance, and a key whose remainder becomes exactly 1 by a granted request is
    closed: nothing is granted afterwards. Optional columns of ``capacity``: ``holgura``, the slack per key,
    and ``cerrada``, whether the key is closed from the start.
    """
    if slack not in (0, 1):
        raise ValueError("slack is counted in the smallest unit and is 0 or 1")
    if "holgura" not in capacity.columns:
        capacity = capacity.withColumn("holgura", F.lit(slack))
    if "cerrada" not in capacity.columns:
        capacity = capacity.withColumn("cerrada", F.lit(False))
    # Without a key there is nothing to take from: refused at once, however many such requests there are.
    nothing = F.lit(None).cast("bigint")
    keyless = requests.filter(F.col(key).isNull()).select(
        *requests.columns, F.lit(False).alias(GRANTED), nothing.alias(BEFORE), nothing.alias(AFTER),
        *[F.lit(None).cast(capacity.schema[c].dataType).alias(c) for c in keep],
    )
    requests = requests.filter(F.col(key).isNotNull())
    hot = skew.find_hot(requests, [key], limits)
    if hot is None:
        return keyless.unionByName(_fold_small(requests, capacity, key, order, amount, keep))
    cold_rows, hot_rows = skew.split_hot(requests, [key], hot, limits)
    small = _fold_small(cold_rows, capacity, key, order, amount, keep)
    large = _fold_phases(hot_rows, capacity, key, order, amount, hot, limits)
    if keep:
        beside = hot.table.join(capacity.select(key, *keep), key)
        large = large.join(_side(beside, hot, limits), key, "left")
    return keyless.unionByName(small).unionByName(large)


def _guard() -> Column:
    return F.when(F.col("cerrada"), F.lit(0).cast("bigint")).otherwise(F.col("capacidad"))


def _close(after: Column) -> Column:
    return F.when((F.col("holgura") == 1) & (after == 1), F.lit(0).cast("bigint")).otherwise(after)


def _fold_small(requests, capacity, key, order, amount, keep) -> DataFrame:
    columns = requests.columns
    # The order columns come first, so the array sorts by them.
    row = F.struct(*order, *[c for c in columns if c not in order and c != key])
    grouped = requests.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def step(acc: Column, e: Column) -> Column:
        x = e[amount].cast("bigint")
        fits = F.coalesce((x > 0) & (x <= acc["s"]), F.lit(False))
        seen = F.when(fits, acc["s"] - x).otherwise(acc["v"])
        out = F.struct(fits.alias(GRANTED), acc["v"].alias(BEFORE), seen.alias(AFTER))
        # A closed key guards with 0 but still shows its slack.
        left = F.when(fits, _close(acc["s"] - x)).otherwise(acc["s"])
        return F.struct(left.alias("s"), seen.alias("v"), F.concat(acc["out"], F.array(out)).alias("out"))

    start = F.struct(
        _guard().alias("s"), F.col("capacidad").alias("v"), F.expr(f"cast(array() as {_OUT})").alias("out")
    )
    verdicts = F.aggregate("_rows", start, step, lambda acc: acc["out"])
    # One row per key: merged, as Catalyst may take a table of millions of keys for small by the size of its files.
    return (
        grouped.join(capacity.hint("merge"), key, "left")
        .select(key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), verdicts.alias("o"))).alias("_x"), *keep)
        .select(*[F.col(c) if c == key and c not in order else F.col(f"_x.r.{c}").alias(c) for c in columns], "_x.o.*", *keep)
    )


def _lowest(s: Column) -> Column:
    """The power of two with 2^k <= s < 2^(k+1); 1 where s is below 1."""
    s = F.greatest(s, F.lit(1).cast("bigint"))
    guess = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(F.log2(s.cast("double"))).cast("int"))
    # The logarithm of a double may land on the wrong side of a power of two.
    return (
        F.when(guess > s, F.shiftright(guess, 1)).when(F.shiftleft(guess, 1) <= s, F.shiftleft(guess, 1)).otherwise(guess)
    )


def _small(x: Column, s: Column, low: Column) -> Column:
    return F.when((x > 0) & (x < low) & (s > 0), x).otherwise(F.lit(0).cast("bigint"))


def _fold_phases(requests, capacity, key, order, amount, hot, limits) -> DataFrame:
    columns = requests.columns
    x = F.greatest(F.coalesce(F.col(amount).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    # Equal order keys share a chunk, so the place in the sorted chunks is a total order.
    ties = [F.col(c) for c in columns if c not in order and c != key]
    chunks = skew.in_chunks(requests.withColumn("_x", x), [key], [F.col(c) for c in order], hot.rows, limits, place="_o", ties=ties)

    # One row per hot key and phase: what guards (s), what is shown (v), and the request that ends it.
    nowhere = F.lit(None).cast(chunks.schema["_o"].dataType)
    state = hot.table.join(capacity, key, "left").select(
        key, "holgura", _guard().alias("s"), F.col("capacidad").alias("v"), nowhere.alias("since")
    )
    phases: list[DataFrame] = []
    while not state.isEmpty():
        stop = _phase_end(chunks.select(key, skew.CHUNK, "_o", "_x"), state, key, hot, limits)
        done = durable(state.join(stop, key, "left").withColumn("n", F.lit(len(phases))))
        phases.append(done)
        left = F.col("stop.left")
        state = done.filter(F.col("stop").isNotNull()).select(
            key, "holgura", _close(left).alias("s"), left.alias("v"), F.col("stop._o").alias("since")
        )
    return _settle(chunks, reduce(DataFrame.unionByName, phases), key, columns, hot, limits)


def _phase_end(chunks: DataFrame, state: DataFrame, key: str, hot: skew.HotKeys, limits: skew.Limits) -> DataFrame:
    """(key, stop): the first request that takes the remainder out of its binary magnitude."""
    live = (
        chunks.join(_side(state, hot, limits), key)
        # A request above the remainder can no longer be granted and needs no further look.
        .filter((F.col("_x") > 0) & (F.col("_x") <= F.col("s")))
        .filter(F.col("since").isNull() | (F.col("_o") > F.col("since")))
        .withColumn("_low", _lowest(F.col("s")))
        .withColumn("_small", _small(F.col("_x"), F.col("s"), F.col("_low")))
    )
    offsets = skew.carried(live, [key], _off=F.sum("_small"))
    inside = Window.partitionBy(key, skew.CHUNK).orderBy("_o")
    left = F.col("s") - F.col("_off") - F.col("_run") + F.col("_small")
    ends = (F.col("_left") >= F.col("_low")) & (
        ((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_left")))
        | ((F.col("_small") > 0) & (F.col("_left") - F.col("_small") < F.col("_low")))
    )
    return (
        live.withColumn("_run", F.sum("_small").over(inside))
        .join(offsets, [key, skew.CHUNK])
        .withColumn("_left", left)
        .filter(ends)
        .groupBy(key)
        .agg(F.min(F.struct("_o", (F.col("_left") - F.col("_x")).alias("left"))).alias("stop"))
    )


def _settle(chunks: DataFrame, phases: DataFrame, key: str, columns, hot: skew.HotKeys, limits: skew.Limits) -> DataFrame:
    """Decide every request in one pass: find its phase, then its place in the phase's prefix sum."""
    per_key = durable(
        phases.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "s", "v", "stop"))).alias("_phases"))
    )  # at most one entry per bit of the capacity
    rows = (
        chunks.join(_side(per_key, hot, limits), key)
        .withColumn("_p", F.filter("_phases", lambda p: p["stop"].isNull() | (F.col("_o") <= p["stop"]["_o"]))[0])
        .drop("_phases")
        .withColumn("_n", F.col("_p.n"))
        .withColumn("_small", _small(F.col("_x"), F.col("_p.s"), _lowest(F.col("_p.s"))))
    )
    offsets = skew.carried(rows, [key, "_n"], _off=F.sum("_small"))
    inside = Window.partitionBy(key, skew.CHUNK, "_n").orderBy("_o")
    granted = (F.col("_small") > 0) | F.coalesce(F.col("_o") == F.col("_p.stop._o"), F.lit(False))
    return (
        rows.withColumn("_run", F.sum("_small").over(inside))
        .join(offsets, [key, "_n", skew.CHUNK])
        .withColumn(GRANTED, granted)
        .withColumn(BEFORE, F.col("_p.v") - F.col("_off") - F.col("_run") + F.col("_small"))
        .withColumn(AFTER, F.when(granted, F.col(BEFORE) - F.col("_x")).otherwise(F.col(BEFORE)))
        .select(*columns, GRANTED, BEFORE, AFTER)
    )


def _side(df: DataFrame, hot: skew.HotKeys, limits: skew.Limits) -> DataFrame:
    return F.broadcast(df) if hot.keys <= limits.broadcast_keys else df
