"""Byte-level BPE: encode texts with offsets, decode ids to the exact bytes.

The vocabulary is a rank file (base64 token, rank).  The tokenizers library
gets it in its own form: tokens written in byte characters, and the merge that
makes each token, which is the last one left when the token's bytes are merged
by the ranks below its own.  Texts are cut by the given pattern and each match
is merged by itself.

Offsets count characters (code points).  A token may hold part of a character;
its span then covers that character, so neighbouring tokens overlap there.
Decoding looks ids up in the byte table, so characters split over tokens come
together again; ``decode_text`` decodes UTF-8 incrementally over any cut of the
ids and replaces what never becomes a character.

Defined results: a NULL or empty text has no ids and decodes to no bytes;
repeated rows each give a row.  Ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .subwords import WordEncoder, byte_characters

ROWS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that are left when ``token`` is merged by lower ranks."""
    limit, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= limit:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"no merge makes token {token!r}")
    return parts[0], parts[1]


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    written = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [tuple(written[p] for p in last_merge(t, ranks))
              for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({written[t]: r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoder = WordEncoder(tokenizer_from_ranks(ranks, pattern))
        self.table = {r: t for t, r in ranks.items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return self.encoder.encode(text)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return character[starts], character[ends - 1] + 1

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def decode_text(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of byte pieces cut anywhere, also within a character."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    yield decoder.decode(b"", final=True)


_models: dict[tuple, ByteBPE] = {}


def model(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBPE(path, pattern)
    return _models[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_offsets: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids; with_offsets: also starts and ends, in characters."""
    schema = "doc_id long, ids array<int>"
    schema += ", starts array<int>, ends array<int>" if with_offsets else ""

    def lists(values, ends):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                        pa.array(values.astype(np.int32)))

    def run(batches):
        bpe = model(ranks_path, pattern)
        for batch in batches:
            for part, ids, ends in bpe.encoder.encode_column(batch):
                out = [part.column("doc_id"), lists(ids, ends)]
                if with_offsets:
                    spans = [bpe.offsets(text, i) for text, i in zip(
                        part.column("text").to_pylist(), np.split(ids, ends[:-1]))]
                    out += [lists(np.concatenate(s), ends) for s in zip(*spans)]
                names = ["doc_id", "ids", "starts", "ends"]
                yield pa.RecordBatch.from_arrays(out, names[:len(out)])

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded (binary).  NULL ids decode to no bytes."""

    def run(batches):
        bpe = model(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column("ids")
                flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
                raw = [bpe.decode(flat[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), column, pa.array(raw, pa.binary())],
                    ["doc_id", "ids", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
