"""Token-id files: texts encoded, packed by Simple-8b and written in id order.

A file set is a Parquet data set of *segments*, written by Spark (so a lost
task writes its file anew and a failed one leaves nothing):

    shard          the range of ids this part of the data set holds, ascending
    offset         token ids in the shard before this segment
    doc_ids, doc_tokens   the documents of the segment, in order, and their
                   numbers of ids (the end id included)
    block_words    the word of ``words`` at which each block of 4,096 ids begins
    words          the Simple-8b words, little-endian

Documents are range-partitioned by id, so the shards follow each other and the
place of a document in the whole stream is the sum of the shards before it (one
number per shard), the segment's offset and the documents before it.  A
document never spans segments; a segment is closed at ``segment_ids`` ids, so a
task holds one segment, or one very long document.

Defined results: NULL texts are empty and yield the end id alone; NULL ids come
first; rows with equal ids are each kept, in the order of a hash of their text.
An empty table gives an empty file set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b
from .common import id_text, release_memory, slices
from .subwords import ID_TYPE, word_encoder

END_ID = 2
SEGMENT_IDS = 262_144

SEGMENTS = ("shard int, offset long, doc_ids array<long>, doc_tokens array<long>, "
            "block_words array<long>, words binary")


def _segments(tokenizer_path: str, end_id: int, segment_ids: int, added_tokens: bool):
    def encode(batches):
        release_memory()
        encoder = word_encoder(tokenizer_path, added_tokens=added_tokens)
        shard, offset = TaskContext.get().partitionId(), 0
        doc_ids, parts, held = [], [], 0
        end = np.array([end_id], ID_TYPE)

        def segment():
            ids = np.concatenate([x for p in parts for x in (p, end)])
            words, blocks = simple8b.encode(ids)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "offset": pa.array([offset], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "doc_tokens": pa.array([[len(p) + 1 for p in parts]], pa.list_(pa.int64())),
                "block_words": pa.array([blocks], pa.list_(pa.int64())),
                "words": pa.array([words.tobytes()], pa.binary())})

        for batch in batches:
            for rows, ids, ends in encoder.encode_column(batch):
                start = 0
                for doc_id, stop in zip(rows.column("doc_id").to_pylist(), ends.tolist()):
                    doc_ids.append(doc_id)
                    parts.append(ids[start:stop])
                    held += stop - start + 1
                    start = stop
                    if held >= segment_ids:
                        yield segment()
                        offset += held
                        doc_ids, parts, held = [], [], 0
        if parts:
            yield segment()

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text",
                      segment_ids: int = SEGMENT_IDS, added_tokens: bool = False) -> None:
    """``added_tokens``: as for ``subwords.WordEncoder``."""
    base = id_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (base.repartitionByRange(slices(docs.sparkSession), *order)
         .sortWithinPartitions(*order)
         .mapInArrow(_segments(tokenizer_path, end_id, segment_ids, added_tokens), SEGMENTS)
         .write.parquet(path))


def _documents(batches):
    """Decode whole segments, vectorised, and cut them into documents."""
    release_memory()  # of the tables that encoding used
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(np.frombuffer(row["words"], simple8b.WORD)).astype(ID_TYPE)
            tokens = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(tokens)
            starts = ends - tokens
            raw = ids.tobytes()
            size = ID_TYPE.itemsize
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(starts + row["before"] + row["offset"], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "ids": pa.array([raw[a * size:b * size] for a, b in zip(starts, ends)],
                                pa.binary())})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    shards = (files.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"),
                                                lambda a, b: a + b).alias("n"))
                   .groupBy("shard").agg(F.sum("n").alias("n")))
    # one row per shard: as many as the writer had partitions
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n"))
                           .alias("before"))
    return (files.join(F.broadcast(before), "shard")
                 .select("offset", "doc_ids", "doc_tokens", "words", "before")
                 .mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary"))


def read_block(words: bytes, block_words: list[int], block: int) -> np.ndarray:
    """One block of a segment alone: ids ``block * 4096`` and following."""
    ends = [*block_words[1:], len(words) // simple8b.WORD.itemsize]
    return simple8b.decode(np.frombuffer(words, simple8b.WORD)
                           [block_words[block]:ends[block]]).astype(ID_TYPE)
