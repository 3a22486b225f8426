"""Packing token streams into fixed windows by minimum bin slack.

A document is cut only where it must be: into whole windows and one remainder.
Whole windows fill a sequence each.  The remainders are counted by length (a
histogram of at most ``capacity - 1`` numbers, however large the corpus), and
the windows are planned on the histogram alone:

* the longest remaining length opens the window; subset-sum dynamic
  programming over the other lengths, each as often as it remains, finds the
  multiset that fills the rest closest to capacity.  A set of reachable sums is
  one big integer, adding a length is a shift, and the counts are read off
  backwards from the best sum;
* the same filling is used as often as the histogram allows, so each step uses
  up a length and the number of steps does not grow with the corpus;
* a window that no subset fills is completed, where allowed, by the beginning
  of a remainder too long for it; what is left of that goes on as a length of
  its own.

The plan names, for each length, which ranks go to which sequence and offset.
Pieces are ranked within their length by slices (counted per length and slice,
then numbered within them), so a length shared by a third of all documents is
no one task's work, and each piece finds its place in the plan by its rank.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import positions
from .common import id_text_columns, release_memory, ship_package, slices, written
from .subwords import ID_TYPE, word_encoder

#: What names a row of the documents.
PLACE = [positions.FILE, positions.ROW]
CAPACITY = 4096
END_ID = 2


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to ``room`` from below.

    ``lengths`` ascend.  They are taken from the longest down, and the search
    stops as soon as ``room`` itself is reached."""
    mask = (1 << (room + 1)) - 1
    reach, history = 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, step = min(counts[length], room // length), 1
        history.append((length, left, reach))
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(history):
        # the fewest of this length that leave a sum the others reach
        used = next(k for k in range(most + 1)
                    if best >= k * length and before >> (best - k * length) & 1)
        if used:
            chosen[length] = used
            best -= used * length
    return chosen


@dataclass
class Run:
    """Remainders of one length by rank: ``count`` from ``first`` on, of which
    the first ``cut`` ids are already placed, in ``depth`` parts."""
    source: int
    first: int
    count: int
    cut: int = 0
    depth: int = 0


#: What a row of a plan holds: the length and ranks it is about, which part of
#: those pieces (number, ids before, ids), and where the part goes.
PLAN = ("source", "first", "stop", "depth", "cut", "placed", "sequence", "each", "offset")


class Planner:
    """Fills windows from a histogram (length -> count) until it is empty."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.runs: dict[int, deque[Run]] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.rows: list[tuple] = []
        for length, n in histogram.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} does not fit into {capacity}")
            if n > 0:
                self.add(length, Run(length, 0, n))

    def add(self, length: int, run: Run) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + run.count
        self.runs[length].append(run)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def place(self, length: int, each: int, windows: int, sequence: int, offset: int,
              part: int | None = None) -> None:
        """Put ``each`` pieces of ``length`` into every one of ``windows``, or
        only their first ``part`` ids."""
        need, at, ids = each * windows, 0, part or length
        self.take(length, need)
        while at < need:
            run, phase = self.runs[length][0], at % each
            n = min(run.count, need - at)
            n = min(n, each - phase) if phase or n < each else n - n % each
            self.rows.append((run.source, run.first, run.first + n, run.depth, run.cut, ids,
                              sequence + at // each, each, offset + phase * ids))
            if part:
                self.add(length - part,
                         Run(run.source, run.first, n, run.cut + part, run.depth + 1))
            run.first += n
            run.count -= n
            if not run.count:
                self.runs[length].popleft()
            at += n

    def run(self, may_cut: bool) -> list[tuple]:
        sequence = 0
        while self.lengths:
            longest = self.lengths[-1]
            room = self.capacity - longest
            self.counts[longest] -= 1
            chosen = fill(self.lengths, self.counts, room)
            self.counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            windows = min(self.counts[n] // k for n, k in chosen.items())
            if may_cut and sum(n * k for n, k in chosen.items()) < self.capacity:
                windows = max(1, windows // 2)  # leaves pieces that can be cut
            offset = 0
            for length in sorted(chosen, reverse=True):
                self.place(length, chosen[length], windows, sequence, offset)
                offset += chosen[length] * length
            slack, done = self.capacity - offset, 0
            while may_cut and slack and done < windows and self.lengths \
                    and self.lengths[-1] > slack:
                n = min(self.counts[self.lengths[-1]], windows - done)
                self.place(self.lengths[-1], 1, n, sequence + done, offset, slack)
                done += n
            sequence += windows
        return self.rows


def plan(histogram: dict[int, int], capacity: int = CAPACITY, may_cut: bool = True) -> list[tuple]:
    """Rows of PLAN that place every piece of the histogram."""
    return Planner(histogram, capacity).run(may_cut)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text",
           added_tokens: bool = False) -> DataFrame:
    """Whole windows and remainders of every document of located ``docs``: doc_id,
    file, row, start, length, doc_tokens, ids (binary, little-endian unsigned
    32-bit)."""
    def run(batches):
        release_memory()
        encoder = word_encoder(tokenizer_path, drops_space=True, added_tokens=added_tokens)
        end = np.array([end_id], ID_TYPE)
        for batch in batches:
            for rows, ids, ends in encoder.encode_column(batch):
                texts, starts, sizes, parts = [], [], [], []
                for at, text in enumerate(np.split(ids, ends[:-1])):
                    text = np.concatenate([text, end])
                    for start in range(0, len(text), capacity):
                        texts.append(at)
                        starts.append(start)
                        sizes.append(len(text))
                        parts.append(text[start:start + capacity].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*[rows[c].take(pa.array(texts)) for c in ("doc_id", *PLACE)],
                     pa.array(starts, pa.int64()),
                     pa.array([len(p) // ID_TYPE.itemsize for p in parts], pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", *PLACE, "start", "length", "doc_tokens", "ids"])

    ship_package(docs.sparkSession)
    return positions.with_place(docs, *id_text_columns(id_col, text_col)).mapInArrow(
        run, "doc_id long, file string, row long, start long, length long, doc_tokens long, "
             "ids binary")


def ranked(table: DataFrame, order: list[str]) -> DataFrame:
    """``table`` with ``rank``: 0, 1, ... within each ``length``, by slices."""
    table = table.withColumn(
        "slice", F.pmod(F.xxhash64(*order), F.lit(slices(table.sparkSession))))
    before = (table.groupBy("length", "slice").agg(F.count("*").alias("n"))
                   .withColumn("before", F.sum("n").over(
                       W.partitionBy("length").orderBy("slice")
                        .rowsBetween(W.unboundedPreceding, -1)))
                   .select("length", "slice", F.coalesce("before", F.lit(0)).alias("before")))
    within = F.row_number().over(W.partitionBy("length", "slice").orderBy(*order)) - 1
    return (table.withColumn("within", within).join(before, ["length", "slice"])
                 .withColumn("rank", F.col("before") + F.col("within"))
                 .drop("slice", "within", "before"))


def pack(table: DataFrame, order: list[str], capacity: int = CAPACITY,
         may_cut: bool = True) -> DataFrame:
    """Place the rows of ``table`` (it has ``length``, between 1 and
    ``capacity``; ``order`` names columns that tell its rows apart).

    Adds sequence_id, offset, cut (ids of the piece before this part) and
    placed (ids of this part); a piece that was cut gives a row for each part.
    """
    # at most ``capacity`` rows, whatever the size of the table
    histogram = {r["length"]: r["n"] for r in
                 table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    depths: dict[int, list[tuple]] = defaultdict(list)
    for row in plan(histogram, capacity, may_cut):
        depths[row[PLAN.index("depth")]].append(row)
    # at one depth a rank is in one run at most, so runs can be found by search
    layers = [np.array(sorted(rows), np.int64).T for _, rows in sorted(depths.items())]
    shared = table.sparkSession.sparkContext.broadcast(layers)

    def run(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for layer in shared.value:
                source, first, stop, _, cut, placed, sequence, each, offset = layer
                key = np.rec.fromarrays([source, first])
                run = np.searchsorted(key, np.rec.fromarrays([length, rank]), "right") - 1
                here = np.flatnonzero((run >= 0) & (source[run] == length) & (rank < stop[run]))
                run = run[here]
                nth = rank[here] - first[run]
                values = [sequence[run] + nth // each[run],
                          offset[run] + nth % each[run] * placed[run], cut[run], placed[run]]
                out = batch.take(pa.array(here))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *[pa.array(v, pa.int64()) for v in values]],
                    [*out.schema.names, "sequence_id", "offset", "cut", "placed"])

    rows = ranked(table, order)
    schema = T.StructType([*rows.schema.fields, *[
        T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "cut", "placed")]])
    return rows.mapInArrow(run, schema).drop("rank")


PLACED = ["doc_id", *PLACE, "start", "length", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Where every id of every document goes: a row for each piece, with
    doc_id, file, row, start, length, doc_tokens, sequence_id, offset and
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit).

    Texts are encoded once, and what is kept of a piece is a narrow row.  The
    few pieces that the plan cuts are encoded again (see ``with_ids``).
    ``added_tokens``: as for ``subwords.WordEncoder``.

    Defined results: NULL and empty texts are the end id alone; repeated rows
    are packed each; an empty table gives an empty result.
    """
    docs = positions.located(docs)
    table = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, added_tokens)
                    .withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    placed = written(pack(table, ["doc_id", *PLACE, "start"], capacity), "placed")
    whole = placed.filter("placed = length")
    parts = (placed.filter("placed < length")
                   .withColumn("start", F.col("start") + F.col("cut"))
                   .withColumn("length", F.col("placed")))
    parts = with_ids(parts.select(PLACED), docs, tokenizer_path, end_id, id_col, text_col,
                     added_tokens)
    return (whole.select(*PLACED, "ids_crc32")
                 .unionByName(parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def with_ids(placed: DataFrame, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID,
             id_col: str = "doc_id", text_col: str = "text",
             added_tokens: bool = False) -> DataFrame:
    """Placed pieces of located ``docs`` with their ids (binary, little-endian
    unsigned 32-bit).

    Only the rows that the pieces are of are read again, by their places; a row's
    own pieces are gathered and met with it."""
    wanted = placed.select(*PLACE, F.struct(*PLACED).alias("piece"))
    schema = T.StructType([T.StructField("piece", wanted.schema["piece"].dataType),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        release_memory()
        encoder = word_encoder(tokenizer_path, drops_space=True, added_tokens=added_tokens)
        end = np.array([end_id], ID_TYPE)
        for batch in batches:
            for at in range(batch.num_rows):
                ids = np.concatenate([encoder.encode(batch["text"][at].as_py()), end])
                found = batch["found"][at].values
                spans = [(p["start"], p["start"] + p["length"]) for p in found.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [found, pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary())],
                    ["piece", "ids"])

    gathered = written(wanted.groupBy(*PLACE).agg(F.collect_list("piece").alias("found")), "cut")
    texts = positions.chosen(docs, gathered.select(*PLACE), keep=True,
                             columns=id_text_columns(id_col, text_col))
    return texts.join(gathered, PLACE).select("text", "found").mapInArrow(run, schema) \
        .select("piece.*", "ids")
