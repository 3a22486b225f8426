import random
import zlib

import numpy as np
import pytest

from reelstat.llm import toxicity
from tests.llm.helpers import empty, frame, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    """Made-up words; toxic texts hold some with one of two stems."""
    pick = random.Random(8)
    parts = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti"]
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(pick.randint(8, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * pick.randint(2, 4)):
            words.insert(pick.randint(0, len(words)), pick.choice(["grom", "vexu"]) + word())
        docs.append((i, " ".join(words), "", "", 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    out = toxicity.score_held_out(frame(spark, docs),
                                  spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out]
    assert len(held) > 50
    assert np.mean([p == t for p, t in held]) > 0.95


def test_reject_drops_toxic_rows_only(spark):
    docs, labels = corpus()
    df = frame(spark, docs + rows()[12:])
    kept = toxicity.reject(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(ids & toxic) <= 0.1 * len(toxic)
    assert len(ids - toxic - {None, 8}) >= 0.97 * (len(docs) - len(toxic) - 1)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, None)]])
def test_without_both_classes_every_score_is_the_share(spark, labels):
    table = spark.createDataFrame(labels, LABELS)
    out = toxicity.score_held_out(frame(spark), table).collect()
    assert len(out) == len(rows()) and {r.score for r in out} == {0.0}
    assert toxicity.reject(frame(spark), table).count() == len(rows())
    assert toxicity.score_held_out(empty(spark), table).count() == 0


def test_grams_and_logistic():
    assert toxicity.grams("ab", 3) == ["\x02a", "\x02ab", "ab\x03"]
    x = np.column_stack([np.r_[np.zeros(50), np.ones(50)], np.ones(100)])
    w = toxicity.fit_logistic(x, np.r_[np.zeros(50), np.ones(50)])
    assert np.isfinite(w).all() and w[0] > 0
