"""Rank-synchronous pair merging over ragged numpy arrays: every open sequence takes its lowest-rank pair in each step."""

from __future__ import annotations

import heapq

import numpy as np

#: Longer sequences are merged one by one through a heap: with very many places of one pair, steps over arrays get slow.
LONG = 128
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks and results of symbol pairs, found by open addressing so that a whole array is looked up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self._result = np.zeros(1 << bits, dtype=np.int32)
        self._steps = 1
        place = self._home(keys)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (place[todo] + step) & self._mask
            free = self._keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(todo), dtype=bool)
            won[first] = True
            won &= free
            self._keys[slot[won]] = keys[todo[won]]
            self._rank[slot[won]] = rank[todo[won]]
            self._result[slot[won]] = result[todo[won]]
            todo, step = todo[~won], step + 1
            self._steps = step
        self._rows = (keys, rank, result)
        self._dict: dict[int, tuple[int, int]] | None = None
        self._order_matters = self._find_orders(left, right, rank, result)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self._shift).astype(np.int64)

    @staticmethod
    def _find_orders(left, right, rank, result) -> np.ndarray:
        """Ranks whose result can take part in a pair that comes no later: there, one occurrence at a time is merged."""
        size = int(max(left.max(initial=0), right.max(initial=0), result.max(initial=0))) + 1
        best = np.full(size, _NONE, dtype=np.int64)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        out = np.zeros(int(rank.max(initial=0)) + 1, dtype=bool)
        out[rank[best[result] <= rank]] = True
        return out

    def as_dict(self) -> dict[int, tuple[int, int]]:
        """left << 32 | right to (rank, result)."""
        if self._dict is None:
            keys, rank, result = (c.tolist() for c in self._rows)
            self._dict = dict(zip(keys, zip(rank, result, strict=True), strict=True))
        return self._dict

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or the largest int) and result of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        home = self._home(keys)
        rank, result = np.full(len(keys), _NONE, dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        for step in range(self._steps):
            slot = (home[todo] + step) & self._mask
            held = self._keys[slot]
            hit = held == keys[todo]
            rank[todo[hit]] = self._rank[slot[hit]]
            result[todo[hit]] = self._result[slot[hit]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            if not len(todo):
                break
        return rank, result


def merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """The same for one sequence, a pair at a time: lowest rank first, leftmost among equals."""
    pairs, sym = table.as_dict(), list(symbols)
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < len(sym) and (hit := pairs.get(sym[i] << 32 | sym[j])):
            heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

    for i in range(len(sym)):
        offer(i)
    while heap:
        _, i, a, b, result = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= len(sym) or sym[j] != b:
            continue
        sym[i], sym[j] = result, -1
        after[i] = after[j]
        if after[j] < len(sym):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [x for x in sym if x >= 0]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of each sequence after all merges, flat, and their number per sequence.

    In each step every open sequence merges all places of its lowest-rank pair, from the left and without overlap; where
    a merge could make way for a pair of the same or a lower rank, only its leftmost place. The result is that of merging
    one pair at a time, lowest rank first and leftmost among equals.
    """
    n_seq = len(lengths)
    if len(lengths) and lengths.max() > LONG:
        return _with_long(symbols, lengths, table)
    seq = np.repeat(np.arange(n_seq, dtype=np.int32), lengths)
    sym = symbols.astype(np.int32)
    done_sym, done_seq = [], []
    while len(sym):
        same = seq[1:] == seq[:-1]
        rank, result = np.full(len(sym), _NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        at = np.flatnonzero(same)
        rank[at], result[at] = table.find(sym[at], sym[at + 1])
        start = np.flatnonzero(np.append(True, ~same))
        low = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(sym)))
        number = np.repeat(np.arange(len(start)), size)
        low_each = low[number]
        is_open = low_each != _NONE
        if not is_open.all():
            done_sym.append(sym[~is_open])
            done_seq.append(seq[~is_open])
        take = is_open & (rank == low_each)
        one = np.zeros(len(low), dtype=bool)
        one[low != _NONE] = table._order_matters[low[low != _NONE]]
        chosen = np.flatnonzero(take)
        if len(chosen):
            begins = np.append(True, (np.diff(chosen) != 1))
            index = np.arange(len(chosen))
            since = index - np.maximum.accumulate(np.where(begins, index, 0))
            keep = since % 2 == 0
            of = number[chosen]
            first = np.append(True, of[1:] != of[:-1])
            chosen = chosen[np.where(one[of], first, keep)]
            sym[chosen] = result[chosen]
            is_open[chosen + 1] = False
        sym, seq = sym[is_open], seq[is_open]
    if not done_sym:
        return np.empty(0, dtype=np.int32), np.zeros(n_seq, dtype=np.int64)
    all_seq = np.concatenate(done_seq)
    order = np.argsort(all_seq, kind="stable")
    return np.concatenate(done_sym)[order], np.bincount(all_seq, minlength=n_seq)


def _with_long(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    long = lengths > LONG
    flat, n = merge_all(symbols[np.repeat(~long, lengths)], np.where(long, 0, lengths), table)
    ends = np.cumsum(lengths)
    parts, at = [], 0
    for i in np.flatnonzero(long):
        before = int(n[:i].sum()) - sum(len(p) for p in parts[1::2])
        left = merge_long(symbols[ends[i] - lengths[i] : ends[i]].tolist(), table)
        parts += [flat[at:before], np.array(left, dtype=flat.dtype)]
        at, n[i] = before, len(left)
    return np.concatenate([*parts, flat[at:]]), n
