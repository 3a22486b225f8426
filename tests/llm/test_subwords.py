"""Encoders against the libraries themselves, on texts made to trip the cutting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from tokenizers import Tokenizer

from reelstat.llm import byte_bpe, queries, subwords
from reelstat.llm.subwords import text_slices, word_encoder
from tests.llm.helpers import rows, text_of

PARTS = ["foo.\nBar", "a\nb", "x\n\ny", "***", "|", "it's", "é.\n", "\nz", "a", "B", "é", " ", "  ",
         "\n", "\t", "'s", "'", "1", "23", ".", "!?", " ", "　", "ß", "İ", "Σ", "中", "🙂",
         "\x1c", "\x85", "é", "<|endoftext|>", "\r", "ǅ", "​", "'ll"]


def texts(n=4000):
    pick = random.Random(5)
    made = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(n)]
    return made + [text_of(r) for r in rows()]


@pytest.mark.parametrize("path, drops", [(queries.BYTE_BPE, False), (queries.WORD_BPE, True)])
def test_ids_are_the_librarys(path, drops):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = [e.ids for e in tokenizer.encode_batch(texts(), add_special_tokens=False)]
    ids, ends = word_encoder(path, drops).encode_batch(pa.array(texts()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


@pytest.mark.parametrize("path, drops", [(queries.BYTE_BPE, False), (queries.WORD_BPE, True)])
def test_added_tokens_are_matched_as_the_library_does_by_default(path, drops):
    pick = random.Random(8)
    some = [*PARTS, "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]
    made = texts(500) + ["".join(pick.choice(some) for _ in range(pick.randint(0, 14)))
                         for _ in range(4000)] + ["<|endoftext|>", "<|endoftext|>" * 3]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(made, add_special_tokens=False)]
    encoder = word_encoder(path, drops, added_tokens=True)
    ids, ends = encoder.encode_batch(pa.array(made))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert encoder.encode(made[-1]).tolist() == want[-1]


def test_registered_queries_match_added_tokens(spark, monkeypatch):
    rows_in = [(1, "one <|endoftext|> two"), (2, "three"), (3, "<|startoftext|>x<|endoftext|>")]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string")
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    for query, path in ((queries.op9_token_files, queries.BYTE_BPE),
                        (queries.op3_packing, queries.WORD_BPE)):
        ids = {i: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2]
               for i, t in rows_in}
        got = query(spark, "").collect()
        assert {r.doc_id: r.ids_crc32 for r in got} == \
            {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}


def test_ranks_give_tiktokens_ids_and_decode_back():
    bpe = byte_bpe.model(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(queries.BYTE_RANKS))
    for text in texts(1500):
        ids = bpe.encode(text)
        assert ids.tolist() == own.encode_ordinary(text)
        assert bpe.decode(ids.tolist()) == text.encode()


def test_offsets_cover_the_text_and_split_characters_come_back():
    bpe = byte_bpe.model(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    for text in ("plain words", "naïve café", "🙂🙂 中文", ""):
        ids = bpe.encode(text)
        starts, ends = bpe.offsets(text, ids)
        for i, a, b in zip(ids.tolist(), starts, ends):
            assert bpe.table[i] in text[a:b].encode()
        if text:
            assert starts[0] == 0 and ends[-1] == len(text)
            assert all(a <= b for a, b in zip(starts[1:], ends))
        assert "".join(byte_bpe.decode_text(bpe.table[i] for i in ids.tolist())) == text


def test_slices_hold_every_row_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 0, 3, 3, 9)]})
    parts = list(text_slices(batch, most=10))
    assert [len(t) for p in parts for t in p["text"].to_pylist()] == [5, 50, 0, 3, 3, 9]
    assert all(p.num_rows == 1 or sum(map(len, p["text"].to_pylist())) <= 10 for p in parts)


def test_small_tables_forget_and_stay_right():
    from reelstat.llm.subwords import WordEncoder
    small = WordEncoder(Tokenizer.from_file(queries.BYTE_BPE), max_pieces=3)
    big = word_encoder(queries.BYTE_BPE)
    for text in texts(200):
        assert small.encode(text).tolist() == big.encode(text).tolist()


def test_table_of_words_is_kept_between_slices_and_bounded(monkeypatch):
    monkeypatch.setattr(subwords, "MAX_WORDS", 50)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = subwords.WordEncoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    pick = random.Random(12)
    for turn in range(30):
        texts = [" ".join(f"w{pick.randrange(10 + 3 * turn)} naïve\n" for _ in range(40)) + "  x"
                 for _ in range(5)] + ["", " "]
        ids, ends = encoder.encode_batch(pa.array(texts, pa.large_string()))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [part.tolist() for part in np.split(ids, ends[:-1])] == want
        assert len(encoder.known.words) <= 50 + 130
        assert len(encoder.known.words) == len(set(encoder.known.words.to_pylist()))


def test_arrow_finds_all_texts_with_a_run_before_python_looks(monkeypatch):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    pick = random.Random(31)
    made = ["".join(pick.choice([*spaces, *["a", " "] * 9]) for _ in range(pick.randint(0, 8)))
            for _ in range(20000)]
    may = pc.match_substring_regex(pa.array(made), subwords._MAY_RUN).to_pylist()
    assert all(m for t, m in zip(made, may) if subwords._RUN.search(t))
    looked = []

    class Run:
        def search(self, text):
            looked.append(text)
            return run.search(text)
    run = subwords._RUN
    monkeypatch.setattr(subwords, "_RUN", Run())
    encoder = subwords.WordEncoder(Tokenizer.from_file(queries.BYTE_BPE))
    encoder.encode_batch(pa.array(["plain words\nin lines", "two  spaces", " first"]))
    assert looked == ["two  spaces", " first"]


def test_gathered():
    ids = np.array([5, 6, 7, 8, 9], "<u4")
    sizes = np.array([2, 0, 3])
    assert subwords.gathered(ids, sizes, np.array([2, 0, 1, 2])).tolist() == [7, 8, 9, 5, 6, 7, 8, 9]
    assert subwords.gathered(ids, sizes, np.array([], int)).tolist() == []
