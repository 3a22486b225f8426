"""The pipeline against brute-force versions of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reelstat.llm import simhash, toxicity
from reelstat.llm.common import id_text
from tests.llm.helpers import SCHEMA, rows
from tests.llm.test_toxicity import LABELS, corpus


def near_copy(text, pick):
    words = text.split()
    words[pick.randrange(len(words))] = "changed"
    return " ".join(words)


def data():
    """Toxic and ordinary texts, copies, near copies, a repeated row, the awkward rows."""
    pick = random.Random(21)
    docs, labels = corpus(200)
    long = [" ".join(f"w{pick.randrange(4000)}" for _ in range(400)) for _ in range(6)]
    more = [(1000 + i, t, "", "", 0) for i, t in enumerate(long)]
    more += [(1100 + i, near_copy(t, pick), "", "", 0) for i, t in enumerate(long)]
    more += [(1200 + i, docs[i][1], "", "", 0) for i in range(1, 8)]
    awkward = [(None if r[0] is None else r[0] + 2000, *r[1:]) for r in rows()]
    return docs + more + [more[0]] + awkward, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = data()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).withColumns(
        {c: F.concat(F.lit(c), "lang") for c in ("file", "row", "fp", "key", "score")}) \
        .repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at


def brute_exact(docs):
    """Of equal texts a row with the largest id (NULL is the least)."""
    last = {}
    for doc in docs:
        text = doc[1] or ""
        if text not in last or (doc[0] is not None, doc[0] or 0) > (
                last[text][0] is not None, last[text][0] or 0):
            last[text] = doc
    return list(last.values())


def brute_near(docs):
    """Of each component of fingerprints at most 3 bits apart the smallest id."""
    bits = [simhash.fingerprint(d[1] or "") & (1 << 64) - 1 for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, doc in enumerate(docs):
        groups[find(i)].append(doc)
    return [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]


def test_rows_of_the_pipeline(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # decisions of the classifier by themselves: the score of every text
    model = toxicity.learn(id_text(table), labels)
    all_docs = [(r.doc_id, r.text) for r in table.collect()]
    texts = [t or "" for _, t in all_docs]
    scores = model.probability(model.features(texts))
    clean = [d for d, s in zip(all_docs, scores) if s < 0.7]
    assert 0 < len(all_docs) - len(clean) < 80
    kept = brute_near(brute_exact(clean))
    assert len(kept) < len(clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d[0]: np.array([*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4")
           for d in kept}
    got = corpus_pipeline.run(spark, folder).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc_id, own in ids.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(own[at:at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(map(len, ids.values())) // 4096)  # no window wasted


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
