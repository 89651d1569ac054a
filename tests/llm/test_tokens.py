"""Packing and token counts against the public libraries."""

import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import packing, token_counts
from tianguis.llm.queries import op1_best_fit_packing, op7_token_counts
from tianguis.llm.ragged import text_steps
from tianguis.llm.word_ids import WordIds, word_ids

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n, seed):
    r = random.Random(seed)
    letters = " \n\t\tab'sS.ÉéßthÜ,!e the   ing漢字🙂‍̈ẞΣİ…×÷1٣½\x00\x1c \xa0ſ▁"
    out = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]
    return [*out, "", "a<|endoftext|>b", "<|STARTOFTEXT|> x", "</s> <0x0A>", "'tis don't.", " " * 300, "a" * 3000, "ab" * 900, "▁▁x"]


def test_piece_counts_of_odd_texts():
    texts = odd_texts(3000, 1)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(texts, num_threads=1)]
    assert token_counts.PieceCounter(PIECE).count([t.encode() for t in texts]) == want


def test_word_ids_of_odd_texts():
    texts = odd_texts(3000, 2)
    flat, n = WordIds(WORD).ids([t.encode() for t in texts])
    got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, texts_by_id, capacity=2048):
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for doc_id, text in texts_by_id:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(doc_id, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_op1_on_the_table(spark):
    rows = op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()])
    total = sum(r.length for r in rows)
    assert n <= 1.02 * -(-total // 2048) + 1


def test_op1_odd_and_no_documents(spark):
    df = odd_documents(spark)
    check_packing(packing.pack(df, WORD).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert packing.pack(no_rows(df), WORD).count() == 0


def test_packed_ids_are_the_texts(spark):
    rows = packing.pack(documents(spark, ["the cat sat", None]), WORD, keep_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [[*Tokenizer.from_file(WORD).encode("the cat sat", add_special_tokens=False).ids, 0], [0]]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing_of_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([16, 100, 2048])
    histogram = {r.randrange(1, capacity + 1): r.randrange(1, 60) for _ in range(r.randrange(1, 80))}
    p = packing.plan(histogram, capacity, groups=r.choice([2, 9, 200]))
    seen, used = {}, {}
    rows = list(zip(*(p[k].tolist() for k in ("length", "rank", "sequence", "offset")), strict=True))
    for (size, rank, seq, offset), nxt in zip(rows, [*rows[1:], (None,) * 4], strict=True):
        n = (nxt[1] if nxt[0] == size else histogram[size]) - rank
        seen[size] = seen.get(size, 0) + n
        for k in range(n):
            used.setdefault(seq + k, []).append((offset, size))
    assert seen == histogram
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity


def test_op7_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in table(spark, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_op7_odd_and_no_documents(spark):
    df = odd_documents(spark)
    rows = token_counts.token_counts(df, PIECE).collect()
    assert len(rows) == 10
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (0, 1)} == {(0, 0, False)}
    assert next(r for r in rows if r.doc_id == 7).over_limit
    assert token_counts.token_counts(no_rows(df), PIECE).count() == 0


def test_texts_leave_a_batch_a_step_at_a_time():
    """Beside a batch of 20 MB stand only the texts of one step, whole and in order; the library is kept from its threads."""
    texts = [None, "", "é" * 40, *("x" * 20_000 for _ in range(1000)), "y" * 300_000, None]
    column = pa.array(texts)
    tracemalloc.start()
    seen, at = 0, 0
    for a, b, part in text_steps(column, 100_000):
        assert a == at and part == [(t or "").encode() for t in texts[a:b]] and (b - a == 1 or sum(map(len, part)) <= 100_000)
        seen, at = seen + len(part), b
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert seen == at == len(texts) and peak < 2_000_000
    word_ids(WORD)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    assert list(text_steps(pa.array([], pa.string()))) == []
