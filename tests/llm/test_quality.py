import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelstat.llm import quality
from tests.llm.helpers import empty, frame, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=4):
    """Prose, and junk of three kinds: repeated words, shouting, marks."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice(["ba", "ke", "li", "mo", "nu", "ra"])
                           for _ in range(pick.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(pick.randint(20, 150))]
        bad = i % 4 == 0
        if bad and i % 12 == 0:
            words = [w for w in words[:10] for _ in range(10)]
        elif bad and i % 12 == 4:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [w + pick.choice(["***", "###", " |"]) for w in words]
        docs.append((i, " ".join(words) + ".", "", "", 0))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    out = quality.score_held_out(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    out = out.collect()
    truth = {i: q for i, q, _ in labels}
    assert sorted(r.doc_id for r in out) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) > 0.95


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = corpus(240)
    label = spark.createDataFrame(labels, LABELS)
    a = quality.score_held_out(frame(spark, docs), label).collect()
    b = quality.score_held_out(frame(spark, docs[::-1]).repartition(7), label).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark):
    docs, labels = corpus(240)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1) for i, q, _ in labels]
    a = quality.score_held_out(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    b = quality.score_held_out(frame(spark, docs).withColumn("lang", F.lit("zz")),
                               spark.createDataFrame(turned, LABELS)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


@pytest.mark.parametrize("labels,score", [
    ([], 0.5), ([(None, 1, 0), (1, None, 0), (2, 7, 0)], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0)])
def test_without_both_classes(spark, labels, score):
    table = spark.createDataFrame(labels, LABELS)
    out = quality.score_held_out(frame(spark), table).collect()
    assert len(out) == len(rows()) and {r.score for r in out} == {score}
    assert quality.score_held_out(empty(spark), table).count() == 0


def test_awkward_rows_are_scored(spark):
    docs, labels = corpus(300)
    long = (9000, "word " * 700_000, "", "", 0)
    out = quality.score_held_out(frame(spark, docs + rows()[8:] + [long, docs[0], docs[0]]),
                                 spark.createDataFrame(labels + [(3, 0, 0)], LABELS)).collect()
    assert len(out) == len(docs) + len(rows()) - 8 + 3
    assert all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id == 9000} == {0}


def test_normal_equations_equal_plain_sums(spark):
    docs, labels = corpus(60)
    x = np.array([quality.statistics(t) for _, t, *_ in docs], float)
    y = np.array([q for _, q, _ in labels], float)
    model = quality.Model(x.mean(0), np.maximum(x.std(0), 1.0))
    table = spark.createDataFrame([(quality.statistics(t), q) for (_, t, *_), (_, q, _)
                                   in zip(docs, labels)], "x array<long>, label int")
    matrix, right = quality._normal_equations(table.repartition(5), model)
    z = model.cosines(x) / quality.STEP
    assert np.allclose(matrix, z.T @ z, atol=1e-9) and np.allclose(right, z.T @ y, atol=1e-9)


def test_cosines_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    k = len(quality.FEATURES)
    x = rng.normal(0, 1, (40, k)) * 0.3
    model = quality.Model(np.zeros(k), np.ones(k))
    z = model.cosines(x)[:, :-1] / quality.STEP * np.sqrt(2 / quality.FOURIER)
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    kernel = np.exp(-gap / (2 * k * quality.WIDTH ** 2))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def brute_isotonic(y, n):
    """The weighted least-squares non-decreasing fit, by the min-max formula."""
    k = len(y)
    mean = lambda a, b: sum(y[a:b + 1]) / sum(n[a:b + 1])
    return [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


def test_isotonic_equals_the_min_max_formula():
    pick = random.Random(1)
    for _ in range(30):
        n = [pick.randint(1, 5) for _ in range(12)]
        ones = [pick.randint(0, k) for k in n]
        place = np.arange(12.0)
        at, share = quality.isotonic(place, np.array(ones, float), np.array(n, float))
        assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
        want = brute_isotonic(ones, n)
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(share, 9))


def test_statistics_do_not_depend_on_the_pieces():
    text = "Some words words here!! and | more.\nSome words\nSome words\n" * 40
    whole = quality.statistics(text)
    assert len(whole) == len(quality.FEATURES)
    assert "".join(quality.pieces(text, 50)) == text
    counts = quality._Counts()
    for piece in quality.pieces(text, 50):
        counts.add(piece)
    assert [round(float(x) * quality.UNIT) for x in counts.statistics()] == whole
