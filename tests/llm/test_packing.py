import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm.packing import Encoder, complement, cut, pack, places, plan, tokenizer_paths


def exact(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_paths()[0])
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_fast_ids_equal_the_tokenizer(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "\n\n  x", "don't I'LL we've", "naïve Ünïcode  ñandú ", "a b  c", "12 345.6\r\n\t", "x" * 3000, "你好 <|endoftext|> \U0001f600"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcXYZ 019'.,!?\n\t\r  éßñÀž¡—’…€") for _ in range(200)) for _ in range(200)]
    encode = Encoder.get(*tokenizer_paths())
    assert [encode(t) for t in texts] == exact(texts)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plan_uses_each_piece_once(counts):
    got, used = plan(counts, 64), Counter()
    for lengths, times in got:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    assert sum(t for _, t in got) >= -(-sum(n * c for n, c in counts.items()) // 64)
    ranks = Counter()
    for n, first, _, _ in places(got):
        assert first == 0 or first <= counts[n]
        ranks[n] += 1


def test_complements():
    avail = np.zeros(65, dtype=np.int64)
    avail[[5, 9, 20]] = 1, 1, 2
    assert complement(20, avail) == (20,) and complement(29, avail) == (20, 9) and complement(40, avail) == (20, 20)
    assert sorted(complement(34, avail)) == [5, 9, 20] and complement(10, avail) is None


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def test_pack(spark, odd_documents):
    got = pack(odd_documents, capacity=64, rows_a_group=2).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in odd_documents.collect())
    encoded = dict(zip(texts, exact([t or "" for t in texts.values()]), strict=True))  # each text once
    for r in got:
        ids = np.array([*encoded[r.doc_id], 0], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(at) == -(-sum(r.length for r in got) // 64)


def test_empty_table(spark, odd_documents):
    assert pack(odd_documents.where("false")).count() == 0


def test_ids_beside_a_null_are_exact(spark):
    big = 2**53 + 1
    got = pack(spark.createDataFrame([(big, "a b"), (None, "a b"), (2**63 - 1, None)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {big, None, 2**63 - 1}
