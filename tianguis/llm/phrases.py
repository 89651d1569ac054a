"""The best collocations of every language, found by best-first branch and bound over prefix counts.

Phrases grow to the right. All pairs of words that are frequent enough are counted; from then on a phrase is grown only if it can
matter. A longer phrase occurs at most as often as its prefix p, and every cut within p keeps its left part, so
``min over k of 2000000 f(p) / (f(p[:k]) + f(p))`` bounds the score of everything grown from p, and falls as p grows. In each round the
open phrases with the highest bounds are expanded: one pass over the texts counts the phrases one word longer, on both sides,
as those decide whether the phrase itself survives. A language is settled when no open phrase has a bound that reaches its
2000th surviving score, ties included. A pass carries at most ``BLOCK_PHRASES`` open phrases to the tasks, more take more passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tianguis.llm.common import saved

TOP = 2000
LEAST = 30
#: A phrase goes if a longer one that contains it has this percentage of its occurrences or more.
COVERED = 80
SCALE = 2_000_000
LONGEST = 4

#: Open phrases expanded in one pass over the texts, all languages together, and at first in one language.
BLOCK_PHRASES = 200_000
FIRST_BATCH = 5 * TOP
#: Bits of the filter of frequent words for each of them, and at most (16 MB); a fuller filter only lets more words through.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27
_FILTER_BLOCK = 1 << 15
#: Scores and bounds are at most 1000000; they are counted in steps of this size before any ranking.
VALUE_STEP = 1000
#: Bytes of text cut into words at once, words counted together, distinct words remembered in a task.
SPAN_BYTES = 2 << 20
BUFFER_WORDS = 2_500_000
KEPT_WORDS = 400_000
BATCH_ROWS = 100_000

_END = b"\xff"  # no byte of UTF-8
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _b in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_b] = 0xFF
_TABLE = bytes(_TABLE)
_COUNT = "key string, n long"
_COUNT_ARROW = pa.schema([("key", pa.string()), ("n", pa.int64())])


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text and marks between its pieces, a span at a time."""
    at = 0
    while at < len(text):
        end = at + SPAN_BYTES
        if end < len(text):
            space = text.find(b" ", end)
            end = len(text) if space < 0 else space
        yield text[at:end].translate(_TABLE).replace(_END, b" \xff ").split()
        at = end


def _batches(keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), BATCH_ROWS):
        part = keys.slice(at, BATCH_ROWS).cast(pa.string())
        yield pa.RecordBatch.from_arrays([part, pa.array(counts[at : at + BATCH_ROWS], pa.int64())], schema=_COUNT_ARROW)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, newline, word) and its count; the empty word stands for all words."""
    counts: dict[bytes, Counter] = {}

    def sent():
        for lang, mine in counts.items():
            mine[b""] = sum(mine.values())
            yield from _batches(pa.array([lang + b"\n" + w for w in mine], pa.binary()), np.fromiter(mine.values(), np.int64, len(mine)))
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            mine = counts.setdefault(lang, Counter())
            for words in _words(text.as_py()):
                mine.update(words)
            mine.pop(_END, None)
        if sum(map(len, counts.values())) > KEPT_WORDS:
            yield from sent()
    yield from sent()


class _Index(dict):
    """Numbers of words as they come; -1 for words that are certainly rare and for the mark between pieces."""

    def __init__(self, bits: np.ndarray):
        self._bits, self.words = bits, []
        self[_END] = -1

    def __missing__(self, word: bytes) -> int:
        at = xxhash.xxh64_intdigest(word, seed=42) & (len(self._bits) * 8 - 1)
        number = -1
        if self._bits[at >> 3] >> (at & 7) & 1:
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


class _Counts:
    """Phrases of one task: word numbers gathered by language, counted a few million at a time."""

    def __init__(self, bits: np.ndarray, count: Callable):
        self._bits, self._count = bits, count
        self._renew()

    def _renew(self) -> None:
        self.index, self._held, self._n = _Index(self._bits), {}, 0

    def add(self, lang: bytes, text: bytes) -> None:
        mine = self._held.setdefault(lang, [])
        for words in _words(text):
            mine.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            self._n += len(words)
        mine.append(np.array([-1]))

    def full(self) -> bool:
        return self._n >= BUFFER_WORDS or len(self.index) > KEPT_WORDS

    def sent(self) -> Iterator[pa.RecordBatch]:
        if any(self._held.values()):
            held, self._held, index = self._held, {}, self.index
            for lang in list(held):
                key = pa.scalar(lang + b"\n", pa.binary())
                for columns, counts in self._count(index, lang, np.concatenate(held.pop(lang))):
                    names = pa.array(index.words, pa.binary())
                    for at in range(0, len(counts), BATCH_ROWS):
                        words = (names.take(pa.array(c[at : at + BATCH_ROWS])) for c in columns)
                        phrase = reduce(lambda a, b: pc.binary_join_element_wise(a, b, b" "), words)
                        yield from _batches(pc.binary_join_element_wise(key, phrase, b""), counts[at : at + BATCH_ROWS])
        self._n = 0
        if len(self.index) > KEPT_WORDS:
            self._renew()


def _pairs(index: _Index, lang: bytes, ids: np.ndarray) -> Iterator[tuple]:
    """All neighbours of words that may be frequent."""
    left, right = ids[:-1], ids[1:]
    good = (left >= 0) & (right >= 0)
    codes, counts = np.unique(left[good] << 32 | right[good], return_counts=True)
    yield (codes >> 32, codes & 0xFFFFFFFF), counts


def _found(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each code in the sorted ``among``, -1 where it is not there."""
    if not len(among):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return np.where(among[at] == codes, at, -1)


def _unique(columns: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct rows of word numbers and their counts."""
    rows, tops = columns[0], []
    for column in columns[1:]:
        codes, rows = np.unique(rows << 32 | column, return_inverse=True)
        tops.append(codes)
    counts = np.bincount(rows, minlength=len(tops[-1]))
    out, at = [], np.arange(len(tops[-1]))
    for codes in reversed(tops):
        out.append(codes[at] & 0xFFFFFFFF)
        at = codes[at] >> 32
    return (at, *reversed(out)), counts


class _Longer:
    """Counts phrases of three words that begin or end with an open pair, and of four with an open phrase of three."""

    def __init__(self, open_phrases: dict[bytes, list[list[bytes]]]):
        self._open, self._known = open_phrases, {}

    def _tables(self, index: _Index, lang: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if lang not in self._known or self._known[lang][0] is not index:
            numbered = [[index[w] for w in phrase] for phrase in self._open.get(lang, ())]
            two = np.array([p for p in numbered if len(p) == 2], np.int64).reshape(-1, 2)
            three = np.array([p for p in numbered if len(p) == 3], np.int64).reshape(-1, 3)
            pairs = np.unique(np.concatenate([two[:, 0] << 32 | two[:, 1], three[:, 0] << 32 | three[:, 1]]))
            is_open = np.zeros(len(pairs) + 1, dtype=bool)
            is_open[_found(two[:, 0] << 32 | two[:, 1], pairs)] = True
            is_open[-1] = False
            triples = np.unique(_found(three[:, 0] << 32 | three[:, 1], pairs) << 32 | three[:, 2])
            first = np.unique(pairs >> 32)
            self._known[lang] = index, pairs, is_open, triples, first
        return self._known[lang][1:]

    def __call__(self, index: _Index, lang: bytes, ids: np.ndarray) -> Iterator[tuple]:
        pairs, is_open, triples, first = self._tables(index, lang)
        n = len(ids)
        if not len(pairs) or n < 3:
            return
        begins = np.zeros(max(len(index.words), 1) + 1, dtype=bool)
        begins[first] = True
        begins[-1] = False
        at = np.flatnonzero(begins[ids[:-1]] & (ids[1:] >= 0))
        pair = np.full(n, -1)
        pair[at] = _found(ids[at] << 32 | ids[at + 1], pairs)
        wanted = is_open[pair]
        whole = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
        at = np.flatnonzero(whole & (wanted[:-2] | wanted[1:-1]))
        if len(at):
            yield _unique((ids[at], ids[at + 1], ids[at + 2]))
        if not len(triples):
            return
        triple = np.zeros(n, dtype=bool)
        at = np.flatnonzero(whole & (pair[:-2] >= 0))
        triple[at] = _found(pair[at] << 32 | ids[at + 2], triples) >= 0
        at = np.flatnonzero(whole[:-1] & (ids[3:] >= 0) & (triple[:-3] | triple[1:-2]))
        if len(at):
            yield _unique((ids[at], ids[at + 1], ids[at + 2], ids[at + 3]))


def _counted(texts: DataFrame, run, least: int) -> DataFrame:
    """lang, phrase, a of all keys that occur often enough."""
    phrase = F.substring_index("key", "\n", -1)
    return (
        texts.mapInArrow(run, _COUNT).groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        .select(F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "a")
    )


def _grams(texts: DataFrame, bits, count: Callable, least: int, name: str) -> DataFrame:
    """A pass over the texts: counts of the phrases that ``count`` finds, as a table."""

    def run(batches):
        counts = _Counts(bits.value, count)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.add(lang, text.as_py())
                if counts.full():
                    yield from counts.sent()
        yield from counts.sent()

    return saved(_counted(texts, run, least), name)


def _filter(spark: SparkSession, words: DataFrame) -> np.ndarray:
    """A bit for the hash of every frequent word, gathered in blocks of 4 kB."""
    n = words.count()
    size = _FILTER_BLOCK
    while size < min(FILTER_BITS * n, MOST_FILTER_BITS):
        size *= 2
    place = F.pmod(F.xxhash64("phrase"), F.lit(size))
    blocks = (
        words.select(place.alias("p")).groupBy((F.col("p") / _FILTER_BLOCK).cast("int").alias("block"))
        .agg(F.collect_set((F.col("p") % _FILTER_BLOCK).cast("int")).alias("places"))
    )

    def pack(batches):
        for batch in batches:
            for block, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bits = np.zeros(_FILTER_BLOCK, dtype=np.uint8)
                bits[np.array(places.as_py(), dtype=np.int64)] = 1
                packed = np.packbits(bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

    out = np.zeros(size // 8, dtype=np.uint8)
    for row in blocks.mapInArrow(pack, "block int, bits binary").toLocalIterator():
        out[row.block * _FILTER_BLOCK // 8 :][: _FILTER_BLOCK // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """grams (lang, phrase, size, a) with the deciding cut's score, l, r and the bound of what grows from them."""
    parts = words.select("lang", "phrase", "a").unionByName(grams.where(F.col("size") < LONGEST).select("lang", "phrase", "a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = grams.select("*", cut).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right")
    )
    lefts = parts.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("left_"), F.col("a").alias("l"))
    rights = parts.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("right_"), F.col("a").alias("r"))
    beside = cuts.join(lefts, (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("left_"))).join(
        rights, (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("right_"))
    )
    a = F.col("a")
    return (
        beside.groupBy("lang", "phrase", "size", "a")
        .agg(
            F.min(F.struct(_exact(a, F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("cut"),
            F.min(_exact(a, F.col("l") + a)).alias("bound"),
        )
        .select("lang", "phrase", "size", "a", "cut.score", "cut.l", "cut.r", "bound")
    )


def _exact(a: Column, total: Column) -> Column:
    """floor(2000000 a / total); the product may pass 64 bits, so it is a decimal."""
    product = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)")
    total = total.cast("decimal(20,0)")
    return ((product - product % total) / total).cast("long")


def _prefix() -> Column:
    return F.expr("substring_index(phrase, ' ', size - 1)")


def _suffix() -> Column:
    return F.expr("substring_index(phrase, ' ', 1 - size)")


def _near_top(df: DataFrame, value: str, limit: int) -> DataFrame:
    """Rows of every language from the step of its ``limit``-th highest ``value`` on; values are counted in a thousand steps at most."""
    step = F.floor(F.col(value) / VALUE_STEP)
    sizes = df.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    last = sizes.withColumn("above", above).groupBy("lang").agg(F.max(F.when(F.col("above") >= limit, F.col("step"))).alias("last"))
    return df.join(last, "lang").where(F.col("last").isNull() | (step >= F.col("last"))).drop("last")


def _highest(df: DataFrame, value: str, limit: int, *ties: Column | str) -> DataFrame:
    """The first ``limit`` rows of every language by ``value`` (descending), then ``ties``, with their rank."""
    near = _near_top(df, value, limit)
    order = Window.partitionBy("lang").orderBy(F.desc(value), *ties)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


class _Search:
    """The state of a best-first search: counted phrases, and those whose longer neighbours are counted."""

    def __init__(self, pairs: DataFrame, words: DataFrame, top: int):
        self.words, self.top = words, top
        self.grams = {2: [pairs], 3: [], 4: []}
        self.expanded: DataFrame | None = None

    def counted(self) -> DataFrame:
        """lang, phrase, size, a; a phrase counted in several passes has the same count in each."""
        sizes = [reduce(DataFrame.unionByName, tables).withColumn("size", F.lit(size)) for size, tables in self.grams.items() if tables]
        return reduce(DataFrame.unionByName, sizes).groupBy("lang", "phrase", "size").agg(F.max("a").alias("a"))

    def judged(self) -> DataFrame:
        """Scored phrases with ``grown`` (longer neighbours are counted) and ``covered`` (by one of those)."""
        counted = saved(self.counted(), "counted")
        scored = _scored(counted, self.words)
        longer = counted.where("size > 2")
        over = longer.select("lang", _prefix().alias("phrase"), "a").unionByName(longer.select("lang", _suffix().alias("phrase"), "a"))
        most = over.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        out = scored.join(most, ["lang", "phrase"], "left")
        grown = F.col("size") == LONGEST
        if self.expanded is not None:
            out = out.join(self.expanded.withColumn("seen", F.lit(True)), ["lang", "phrase"], "left")
            grown = grown | F.col("seen").isNotNull()
        whole = (F.coalesce("most", F.lit(0)).cast("decimal(20,0)") * 100) >= (F.col("a").cast("decimal(20,0)") * COVERED)
        return saved(
            out.select("lang", "phrase", "size", "a", "score", "l", "r", "bound", grown.alias("grown"), whole.alias("covered")), "judged"
        )

    def best(self, judged: DataFrame) -> DataFrame:
        """The first ``top`` survivors of every language among the phrases that are settled, with their rank."""
        return _highest(judged.where("grown and not covered"), "score", self.top, F.desc("a"), "phrase")

    def frontier(self, judged: DataFrame, batch: int, block: int) -> list:
        """Open phrases that may still change the result, about ``batch`` a language, highest bound first, at most ``block`` in all."""
        worst = self.best(judged).where(F.col("rank") == self.top).select("lang", F.col("score").alias("last"))
        wanted = judged.where("not grown").join(worst, "lang", "left").where("last is null or bound >= last").drop("last")
        first = _near_top(wanted, "bound", batch)
        return first.orderBy(F.desc("bound"), "lang", "phrase").limit(block).select("lang", "phrase", "size").collect()

    def expand(self, spark: SparkSession, phrases: set[tuple[str, str]], counts: DataFrame) -> None:
        """Take in the counts of a pass that expanded ``phrases``."""
        grown = saved(spark.createDataFrame(sorted(phrases), "lang string, phrase string"), "expanded")
        self.expanded = grown if self.expanded is None else self.expanded.unionByName(grown).distinct()
        sized = counts.withColumn("size", F.size(F.split("phrase", " ")))
        for size in (3, 4):
            self.grams[size].append(sized.where(F.col("size") == size).drop("size"))


def collocations(
    documents: DataFrame, top: int = TOP, least: int = LEAST, batch: int = FIRST_BATCH, block: int = BLOCK_PHRASES
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``; A-Z are lower-cased. Repeated documents count each time. Equal scores go by a
    (descending), then phrase in byte order, so ties have one order and all of them are settled before the cut. A language
    without a phrase of ``least`` occurrences has no rows, nor has an empty table; columns besides text and lang play no part.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    counted = texts.mapInArrow(_count_words, _COUNT).groupBy("key").agg(F.sum("n").alias("a"))
    keys = saved(counted.where((F.col("a") >= least) | F.col("key").endswith("\n")), "words")
    phrase = F.substring_index("key", "\n", -1)
    split = keys.select(F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "a")
    words, totals = split.where("phrase <> ''"), split.where("phrase = ''").select("lang", F.col("a").alias("n"))
    bits = spark.sparkContext.broadcast(_filter(spark, words))
    search = _Search(_grams(texts, bits, _pairs, least, "pairs"), words, top)
    while True:
        judged = search.judged()
        rows = search.frontier(judged, batch, block)
        if not rows:
            break
        phrases = {(r.lang, r.phrase) for r in rows}
        # What follows the first word of an open phrase of three is a part of the phrases of four, so it is counted as well.
        phrases |= {(r.lang, r.phrase.split(" ", 1)[1]) for r in rows if r.size == 3}
        by_lang: dict[bytes, list[list[bytes]]] = {}
        for lang, p in phrases:
            by_lang.setdefault(lang.encode(), []).append(p.encode().split(b" "))
        search.expand(spark, phrases, _grams(texts, bits, _Longer(by_lang), least, "longer"))
        batch = min(2 * batch, block)
    return search.best(judged).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
