import hashlib
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelstat.llm import byte_bpe, queries, simple8b, token_files
from reelstat.session import scratch_path
from tests.llm.helpers import empty, frame, rows, text_of


@pytest.mark.parametrize("high", [2, 5, 200, 50_000, 1 << 20, (1 << 32) - 1, 1 << 59, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    pick = np.random.default_rng(1)
    for n in (0, 1, 2, 59, 60, 61, 4095, 4096, 4097, 9000):
        values = pick.integers(0, high, n, dtype=np.uint64, endpoint=True)
        values[50:190] = 0
        words, blocks = simple8b.encode(values)
        assert (simple8b.decode(words) == values).all()
        parts = [simple8b.decode(words[a:b]) for a, b in zip(blocks, [*blocks[1:], len(words)])]
        assert [len(p) for p in parts[:-1]] == [4096] * (len(parts) - 1)
        assert sum(p.tolist() == values[4096 * i:4096 * (i + 1)].tolist()
                   for i, p in enumerate(parts)) == len(parts)


def test_simple8b_escapes_next_to_each_other():
    values = np.array([1 << 63, 5, (1 << 64) - 1, 1 << 61, 1 << 62, 0, 0], np.uint64)
    assert simple8b.decode(simple8b.encode(values)[0]).tolist() == values.tolist()


def expected():
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return sorted(((r[0], tokenizer.encode(text_of(r), add_special_tokens=False).ids + [2])
                   for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_documents_come_back_in_order(spark):
    path = scratch_path(spark, "test", uuid.uuid4().hex)
    token_files.write_token_files(frame(spark), path, queries.BYTE_BPE, segment_ids=100)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in expected()]
    for r, (_, ids) in zip(got, expected()):
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(bytes(r.ids))
        start += len(ids)
    segment = max(spark.read.parquet(path).collect(), key=lambda s: len(s.block_words))
    flat = simple8b.decode(np.frombuffer(bytes(segment.words), simple8b.WORD))
    last = len(segment.block_words) - 1
    assert (token_files.read_block(bytes(segment.words), segment.block_words, last)
            == flat[last * simple8b.BLOCK:]).all()


def test_empty_table(spark):
    path = scratch_path(spark, "test", uuid.uuid4().hex)
    token_files.write_token_files(empty(spark), path, queries.BYTE_BPE)
    assert token_files.read_token_files(spark, path).count() == 0
    assert byte_bpe.encode(empty(spark), queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_over_a_table(spark):
    encoded = byte_bpe.encode(frame(spark), queries.BYTE_RANKS, public_tokenizers.PATTERN,
                              with_offsets=True)
    by_ids = byte_bpe.decode(encoded, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in by_ids) == \
        sorted(hashlib.sha256(text_of(r).encode()).hexdigest() for r in rows())
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in encoded.collect())
