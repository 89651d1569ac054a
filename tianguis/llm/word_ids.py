"""Token ids of whole texts under a lower-casing word BPE, a distinct word at a time."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tianguis.llm.bpe import PairTable, merge_all
from tianguis.llm.ragged import SPACES, Powers, gather, hashes, lookup, places

#: Distinct words kept between batches; beyond it the table starts anew, which changes no id.
KEPT_WORDS = 200_000
#: Words that the library gets at a time: what it answers with takes about a kilobyte a word until the ids are read off it.
LIBRARY_WORDS = 2_048
_PUNCTUATION = lookup(np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dtype=np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = lookup(np.array([*range(48, 58), *range(97, 123)]))


#: Lower-case letters of the basic and extended Latin blocks: words of them are one pre-token, the same in every normal form.
_LATIN = re.compile("[a-z%s]+" % "".join(c for c in map(chr, range(0xDF, 0x17F)) if c.isalpha() and c == c.lower()))
_SHARED: dict[str, WordIds] = {}


def word_ids(tokenizer_file: str) -> WordIds:
    """The one instance of a worker process, so that a task finds the words of the tasks before it."""
    if tokenizer_file not in _SHARED:
        _SHARED[tokenizer_file] = WordIds(tokenizer_file)
    return _SHARED[tokenizer_file]


class WordIds:
    """Ids of texts as the tokenizer file gives them, without added tokens.

    White space never takes part in a token, so words between white space have ids of their own; a tail of ASCII
    punctuation after a letter or digit is a pre-token of its own. Words of Latin letters are merged together as ragged
    arrays, all others go through the library, as do texts that hold a special token's string.
    """

    def __init__(self, tokenizer_file: str):
        # a task has one core; threads of the library would each keep memory of their own in every worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(tokenizer_file)
        spec = json.loads(self._library.to_str())
        model = spec["model"]
        self._special = [t["content"].encode() for t in spec["added_tokens"]]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, result = (np.array(c, dtype=np.int64) for c in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self._pairs = PairTable(left, right, np.arange(len(merges)), result)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        name = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._inner = np.array([vocab[name[b]] for b in range(256)])
        self._last = np.array([vocab[name[b] + model["end_of_word_suffix"]] for b in range(256)])
        self._powers = Powers()
        self._reset()

    def _reset(self) -> None:
        self._index: dict[int, int] = {}
        self._ids = np.empty(0, dtype=np.int32)
        self._starts = np.empty(0, dtype=np.int64)
        self._lengths = np.empty(0, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        lots = (texts[i : i + LIBRARY_WORDS] for i in range(0, len(texts), LIBRARY_WORDS))
        return [e.ids for lot in lots for e in self._library.encode_batch(lot, add_special_tokens=False)]

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        names = [w.decode() for w in words]
        latin = np.array([bool(_LATIN.fullmatch(w)) for w in names], dtype=bool)
        plain = [w for w, x in zip(words, latin, strict=True) if x]
        size = np.array([len(w) for w in plain], dtype=np.int64)
        data = np.frombuffer(b"".join(plain), dtype=np.uint8)
        symbols = self._inner[data]
        ends = np.cumsum(size)
        if len(ends):
            symbols[ends - 1] = self._last[data[ends - 1]]
        flat, n = merge_all(symbols, size, self._pairs)
        other = self._encode([w for w, x in zip(names, latin, strict=True) if not x])
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[latin], lengths[~latin] = n, [len(x) for x in other]
        starts = np.zeros(len(words), dtype=np.int64)
        starts[latin] = np.cumsum(n) - n
        starts[~latin] = len(flat) + np.cumsum(lengths[~latin]) - lengths[~latin]
        at = len(self._ids)
        self._ids = np.concatenate([self._ids, flat.astype(np.int32), np.array([i for x in other for i in x], dtype=np.int32)])
        self._index.update(zip(keys, range(len(self._starts), len(self._starts) + len(keys)), strict=True))
        self._starts = np.concatenate([self._starts, at + starts])
        self._lengths = np.concatenate([self._lengths, lengths])

    def ids(self, batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and their number per text; null is empty."""
        if len(self._index) > KEPT_WORDS:
            self._reset()
        special = [i for i, t in enumerate(batch) if t and any(s in t for s in self._special)]
        plain = [t or b"" for t in batch]
        for i in special:
            plain[i] = b""
        buffer = _LOWER[np.frombuffer(b"\n".join(plain), dtype=np.uint8)]
        starts, ends = places(buffer, SPACES)
        # the tail of punctuation of each word, where what stands before it is surely a letter or digit
        body = np.where(_PUNCTUATION[buffer], 0, np.arange(1, len(buffer) + 1))
        body = np.maximum.accumulate(body) if len(body) else body
        core = np.maximum(body[ends - 1], starts) if len(ends) else ends
        last = buffer[np.maximum(core - 1, 0)]
        before = buffer[np.maximum(core - 2, 0)]
        latin = (before >= 0xC3) & (before <= 0xC5) & (last >= 0x80) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        latin &= ~((before == 0xC4) & (last == 0xB0))  # its lower case ends in a mark
        latin &= core - starts >= 2
        cut = (core > starts) & (core < ends) & (_ALNUM[last] | latin)
        core = np.where(cut, core, ends)
        n_parts = 1 + cut
        first = np.cumsum(n_parts) - n_parts
        total = int(n_parts.sum())
        part_start, part_end = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
        part_start[first], part_end[first] = starts, core
        part_start[first[cut] + 1], part_end[first[cut] + 1] = core[cut], ends[cut]
        keys, where, back = np.unique(hashes(buffer, part_start, part_end, self._powers), return_index=True, return_inverse=True)
        known = [self._index.get(k, -1) for k in keys.tolist()]
        new = [i for i, k in enumerate(known) if k < 0]
        if new:
            raw = buffer.tobytes()
            self._learn(keys[new].tolist(), [raw[part_start[w] : part_end[w]] for w in where[new]])
            known = [self._index[k] for k in keys.tolist()]
        word = np.array(known, dtype=np.int64)[back]
        lengths = self._lengths[word]
        flat = gather(self._ids, self._starts[word], lengths)
        text_ends = np.cumsum([len(t) + 1 for t in plain])
        sums = np.concatenate([[0], np.cumsum(lengths)])
        upto = sums[np.searchsorted(part_start, text_ends)]
        counts = np.diff(np.concatenate([[0], upto]))
        if special:
            return self._with_special(batch, special, flat, counts)
        return flat, counts

    def _with_special(self, batch, special, flat, counts):
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i, ids in zip(special, self._encode([batch[i].decode() for i in special]), strict=True):
            parts[i] = np.array(ids, dtype=np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts])
