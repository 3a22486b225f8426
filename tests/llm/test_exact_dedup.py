import collections
import hashlib

from reelstat.llm import exact_dedup
from tests.llm.helpers import empty, frame, rows, text_of


def expected(data):
    groups = collections.defaultdict(list)
    for r in data:
        groups[text_of(r)].append(r[0])
    return groups


def test_marks_every_row(spark):
    groups = expected(rows())
    got = exact_dedup.mark(frame(spark)).collect()
    assert len(got) == len(rows())
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())
                 for i in ids]
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
                              for r in got)), key=key) == sorted(want, key=key)


def test_short_prefix_still_compares_whole_texts(spark):
    data = [(1, "a" * 50 + "x", "", "", 0), (2, "a" * 50 + "y", "", "", 0),
            (3, "a" * 50 + "x", "", "", 0)]
    got = {r.doc_id: r.keep_id for r in exact_dedup.mark(frame(spark, data), prefix_chars=5).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_keeps_one_row_of_each_text_with_all_columns(spark):
    df = frame(spark)
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(t or "" for _, t in kept) == sorted(expected(rows()))
    assert (2, rows()[1][1]) in kept and (1, rows()[0][1]) not in kept


def test_empty_table(spark):
    assert exact_dedup.mark(empty(spark)).count() == 0
    assert exact_dedup.deduplicate(empty(spark)).count() == 0
