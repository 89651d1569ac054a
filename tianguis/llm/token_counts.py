"""Token counts of whole texts under a piece BPE model, by rank-synchronous merging of arrays.

A text is cut at spaces and newlines into pre-tokens. Those not met before are held as one ragged array of symbols and
merged together (:mod:`tianguis.llm.bpe`); the count of a text is a sum over its pre-tokens. Cutting there is exact: no
piece of such a model holds a space mark after another character, and the constructor refuses a model in which one does.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows give repeated rows. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tianguis.llm.bpe import PairTable, merge_all
from tianguis.llm.common import text_only

#: What such a model puts for a space; in a text it is one more space.
MARK = "▁"
_MARK_BYTES = MARK.encode()
#: Pre-tokens kept between batches; beyond it the table starts anew, which changes no count.
KEPT_WORDS = 500_000
#: Symbols of characters that are no piece and in no piece begin here.
_OTHER = 2**22


class PieceCounter:
    """Counts the tokens of UTF-8 texts with the pieces of a sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not special[i]}
        if model.encode(" a", out_type=str)[:1] != [MARK] or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model is not one whose pre-tokens begin at each space")
        if any(MARK * 2 in p and p.strip(MARK) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("the model joins spaces or newlines with other characters")
        order = sorted({-s for s in pieces.values()})
        rank_of = {-s: r for r, s in enumerate(order)}
        self._symbol = {p: i for i, p in enumerate(pieces)}
        # a single character that is no piece still takes part in merges of a known pair, so splits name it as well
        rows = []
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (a in pieces or cut == 1) and (b in pieces or cut == len(piece) - 1):
                    rows.append((self._id(a), self._id(b), rank_of[score], self._symbol[piece]))
        left, right, rank, result = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        self._pairs = PairTable(left, right, rank, result)
        self._spaces: list[int] = [0]
        self._lone: set[bytes] = set()
        self._counts: dict[bytes, int] = {}
        self._is_piece = set(pieces)

    def _id(self, piece: str) -> int:
        return self._symbol.setdefault(piece, len(self._symbol))

    def _learn(self, words: list[bytes]) -> None:
        """Counts of new pre-tokens; one that begins with a newline has no space mark, the newline is a byte of its own."""
        texts = [w[1:] if w[:1] == b"\n" else _MARK_BYTES + w for w in words]
        chars = b"\n".join(texts).decode()
        points = np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32)
        cuts = np.flatnonzero(points == 10)
        lengths = np.diff(np.concatenate([[-1], cuts, [len(points)]])) - 1
        points = points[points != 10]
        unique, back = np.unique(points, return_inverse=True)
        symbols = np.array([self._symbol.get(chr(c), _OTHER + c) for c in unique.tolist()], dtype=np.int64)
        left, n = merge_all(symbols[back], lengths, self._pairs)
        # tokens a symbol stands for: 1, or its bytes where the model knows no such piece
        single = np.array([1 if chr(c) in self._is_piece else len(chr(c).encode()) for c in unique.tolist()], dtype=np.int64)
        cost = np.ones(len(left), dtype=np.int64)
        odd = single > 1
        if odd.any():
            order = np.argsort(symbols[odd])
            names, costs = symbols[odd][order], single[odd][order]
            at = np.minimum(np.searchsorted(names, left), len(names) - 1)
            cost = np.where(names[at] == left, costs[at], 1)
        ends = np.cumsum(n)
        sums = np.concatenate([[0], np.cumsum(cost)])
        total = sums[ends] - sums[ends - n]
        is_line = np.array([w[:1] == b"\n" for w in words])
        lone = np.zeros(len(words), dtype=bool)
        lone[n > 0] = left[(ends - n)[n > 0]] == self._symbol.get(MARK, -1)
        self._counts.update(zip(words, (total + is_line).tolist(), strict=True))
        self._lone.update(w for w, x in zip(words, (lone & ~is_line).tolist(), strict=True) if x)

    def _run(self, n: int) -> int:
        """Tokens of ``n`` space marks in a row, merged from the left."""
        while len(self._spaces) <= n:
            size = len(self._spaces)
            marks = np.full(min(size, 64), self._symbol[MARK], dtype=np.int64)
            if size <= 64:
                self._spaces.append(len(merge_all(marks, np.array([size]), self._pairs)[0]))
                continue
            longest = max(len(p) for p in self._is_piece if not p.strip(MARK))
            full, tail = divmod(n, longest)
            return full + self._spaces[tail]
        return self._spaces[n]

    def count(self, batch: list[bytes | None]) -> list[int]:
        """Tokens of each text; null is empty."""
        if len(self._counts) > KEPT_WORDS:
            self._counts, self._lone = {}, set()
        split = [t.replace(_MARK_BYTES, b" ").replace(b"\n", b" \n").split(b" ") if t else [] for t in batch]
        new = set().union(*split) - self._counts.keys()
        new.discard(b"")
        if new:
            self._learn(list(new))
        get = self._counts.__getitem__
        return [self._with_spaces(words) if b"" in words else sum(map(get, words)) for words in split]

    def _with_spaces(self, words: list[bytes]) -> int:
        """Spaces in a row: the last mark belongs to the word behind it, unless that word leaves it alone."""
        total = run = 0
        for w in words:
            if not w:
                run += 1
                continue
            tokens = self._counts[w]
            if run and w in self._lone:
                total += self._run(run + 1) + tokens - 1
            else:
                total += self._run(run) + tokens
            run = 0
        return total + self._run(run)


_SHARED: dict[str, PieceCounter] = {}


def piece_counter(model_file: str) -> PieceCounter:
    """The one instance of a worker process, so that a task finds the pre-tokens of the tasks before it."""
    if model_file not in _SHARED:
        _SHARED[model_file] = PieceCounter(model_file)
    return _SHARED[model_file]


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: tokens of the whole text, no special ones.

    ``model_file`` is the path of a piece BPE model, readable on every executor. ``over_limit``: more than ``limit`` tokens.
    A null text is an empty one. No shuffle: each task keeps the counts of the pre-tokens it has met.
    """
    docs = text_only(documents, "doc_id")

    def run(batches):
        counter = piece_counter(model_file)
        for batch in batches:
            data = batch.column("text").cast(pa.binary()).to_pylist()
            tokens: list[int] = []
            step: list[bytes | None] = []
            size = 0
            for t in data:  # a few MB at a time, so that the pieces of a batch of long texts do not pile up
                step.append(t)
                size += len(t or b"")
                if size > 4_000_000:
                    tokens += counter.count(step)
                    step, size = [], 0
            tokens += counter.count(step)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(t or b"") for t in data], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
