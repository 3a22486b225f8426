import re

from reelstat.llm import license_scan
from tests.llm.helpers import empty, frame, rows, text_of

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2",
           "cc-by-nc": "cc by nc"}


def slow(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(words))
                    if words[i:i + len(p.split())] == p.split())
    return len(words), places


def data():
    passage = " ".join(license_scan.PASSAGES[2].words)
    changed = passage.split()
    del changed[9]
    changed.insert(4, "extra")
    return rows() + [
        (30, "x " + passage.title() + ".", "", "", 0), (31, " ".join(changed), "", "", 0),
        (32, " ".join(passage.split()[:6]), "", "", 0),
        (33, "under the\nMIT\tlicense, under the mit license", "", "", 0),
        (34, "under the mit under the mit license", "", "", 0)]


def test_phrases_and_passages(spark):
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(frame(spark, data())).collect()}
    for r in data():
        n, places = slow(text_of(r))
        row = got[r[0], n]
        assert row.n_base == len(places)
        assert row.first_word == (places[0][0] if places else None)
        assert row.last_word == (places[-1][0] if places else None)
        base = sorted({label for _, label in places})
        assert row.base_labels == ",".join(base)
        assert set(base) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1 and (row.score == 1 or not base)
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[30].labels == "bsd" and by_id[30].score == 1
    assert by_id[31].labels == "bsd" and 0.6 <= by_id[31].score < 1  # neighbouring diagonals
    assert by_id[32].labels == ""


def test_every_row_once_and_empty_table(spark):
    assert license_scan.scan(frame(spark)).count() == len(rows())
    assert license_scan.scan(empty(spark)).count() == 0


def test_copies_with_words_put_in_or_left_out(spark):
    rows_in, want = [], {}

    def add(words, label):
        want[len(rows_in)] = label
        rows_in.append((len(rows_in), "before it " + " ".join(words) + " and after", "", "", 0))

    for t in license_scan.PASSAGES:
        half = len(t.words) // 2
        for n in range(4, 11):
            extra = [f"extra{i}" for i in range(n)]
            add([*t.words[:half], *extra, *t.words[half:]], t.label)
        if len(t.words) > 25:
            add([*t.words[:half - 2], *t.words[half + 2:]], t.label)
            third = len(t.words) // 3
            add([*t.words[:third], *extra, *t.words[third:2 * third], *extra, *t.words[2 * third:]],
                t.label)
        add([*t.words[half:], *extra, *t.words[:half]], "")  # not in the template's order
        add([*t.words[:half], *(["other"] * 200), *t.words[half:]], "")  # too far apart
    mit = license_scan.PASSAGES[0].words
    at = mit.index("software") + 1
    add([*mit[:at], *"which we give to you today".split(), *mit[at:]], "mit")
    six = len(rows_in) - 1
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows_in)).collect()}
    assert {i: r.labels for i, r in got.items()} == want
    assert got[six].score == 25 / 27


def test_each_copy_is_a_span():
    one = [(i, i) for i in range(20)]
    copies = [(p + 30 * c, at) for c in range(500) for p, at in one]
    assert license_scan.chains(copies, 36, 12) == [(30 * c, 20) for c in range(500)]
    assert license_scan.chains(one[:8] + [(p + 9, at) for p, at in one[8:]], 36, 12) == [(0, 20)]
    assert license_scan.chains(one[:8] + [(p + 50, at) for p, at in one[8:]], 36, 12) == [(58, 12)]


def test_a_very_long_text(spark):
    words = [f"w{i % 5000}" for i in range(200_000)]
    for at in (0, 100_000, 199_990):
        words[at:at + 4] = "under the mit license".split()
    words[150_000:150_004] = "apache license version 2".split()
    row, = license_scan.scan(frame(spark, [(1, " ".join(words), "", "", 0)])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (200_000, 4, 0, 199_990)
    assert row.base_labels == "apache-2,mit"
