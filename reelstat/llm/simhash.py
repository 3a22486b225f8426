"""SimHash near-dedup: 64-bit fingerprints linked by BK-trees over shards.

Fingerprint: words are runs of characters that are not ASCII white space, A-Z
in lower case; every 3-word shingle (repeats included; the whole sequence if
shorter) is hashed by XXH64 with seed 42; a bit is set if more than half of the
hashes have it set.  A text without words has fingerprint zero.

Links: two fingerprints at ``radius`` bits or fewer, cut into radius + 1 blocks,
agree on a whole block, and of the remaining bits, cut the same way, on a whole
sub-block.  (block, its value, sub-block, its value) therefore names a shard
that holds both, and the shards of all places together lose no link.  Equal
fingerprints are one node, so copies cost nothing here.  Each shard builds a
BK-tree (children keyed by their Hamming distance to the parent) and each of
its members follows only the edges within the radius of its own distance.  A
member is then tied to the first of the shard's members that it reaches through
links, which keeps a shard's output as long as its members, and the components
of these links are those of all links.

A hot shard (a family of near copies) is dealt into pieces of ``SHARD`` members
by hash, and each pair of pieces is a task's work: a tree of both pieces.  Trees
are built where their shard is shuffled to, not broadcast: the trees of all
shards together grow with the corpus, and no shard needs another one's tree.

Defined results: NULL and empty texts have fingerprint zero and link like any
other; a component is named by its smallest id; a NULL id is no name while there
is another one; repeated rows each give a row.  An empty table gives an empty
result.  Columns of any name pass ``deduplicate`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import positions
from .common import id_text, id_text_columns, release_memory, ship_package, written
from .components import smallest_reachable

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
SHARD = 2048
HASHES = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES):  # a very long text takes several turns
        some = words[at:min(at + HASHES, n) + shingle - 1]
        grams = some if shingle == 1 else map(b" ".join, zip(
            *[some[i:] for i in range(min(shingle, len(some)))]))
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


class BKTree:
    """Nodes are numbered in the order they are added; the first is the root."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            self._add(i)

    def _add(self, i: int) -> None:
        value, at = self.values[i], 0
        while True:
            distance = (value ^ self.values[at]).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = i
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at ``radius`` bits or fewer from ``value``."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            low, high = distance - radius, distance + radius
            todo += [c for d, c in self.children[at].items() if low <= d <= high]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, first member that it reaches) for the members that reach one.

    Values are signed; without the sign the difference of two has the right bits."""
    bits = [v & (1 << BITS) - 1 for v in values]
    tree = BKTree(bits)
    reached = [-1] * len(values)
    for first in range(len(values)):
        if reached[first] >= 0:
            continue
        reached[first], todo = first, [first]
        while todo:
            for other in tree.within(bits[todo.pop()], radius):
                if reached[other] < 0:
                    reached[other] = first
                    todo.append(other)
    return [(values[i], values[r]) for i, r in enumerate(reached) if i != r]


def block_bounds(n: int, blocks: int) -> list[tuple[int, int]]:
    """Bounds of ``blocks`` blocks that share ``n`` bits as evenly as can be."""
    cuts = [n * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def shard_keys(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (rows) the keys of its shards (columns)."""
    values = values.astype(np.uint64)
    keys = []
    for number, (a, b) in enumerate(block_bounds(BITS, radius + 1)):
        block = values >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
        rest = values & np.uint64((1 << a) - 1)
        if b < BITS:
            rest |= values >> np.uint64(b) << np.uint64(a)
        for sub, (c, d) in enumerate(block_bounds(BITS - (b - a), radius + 1)):
            inner = rest >> np.uint64(c) & np.uint64((1 << (d - c)) - 1)
            place = np.uint64(number * (radius + 1) + sub)
            keys.append((block << np.uint64(d - c) | inner) << np.uint64(8) | place)
    return np.stack(keys, axis=1).astype(np.int64)


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with fp (signed 64-bit integer) in place of their text."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        release_memory()
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in others], pa.array(values, pa.int64())], [*others, "fp"])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType(
        [*[rows.schema[c] for c in others], T.StructField("fp", T.LongType())]))


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all pairs
    at ``radius`` bits or fewer would."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be between 0 and 7")

    def keyed(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            keys = shard_keys(fp, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(fp, keys.shape[1]))],
                ["key", "fp"])

    def linked(batches):
        for batch in batches:
            for members in batch["members"]:
                found = shard_links(sorted(members.as_py()), radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()),
                     pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    members = written(values.mapInArrow(keyed, "key long, fp long"), "shards")
    # how many pieces a shard is dealt into; shards of one member go
    sizes = (members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
                    .select("key", F.ceil(F.col("n") / shard).alias("pieces")))
    dealt = members.join(written(sizes, "sizes"), "key")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    # a member of piece p goes to every pair of pieces that p is one of
    pairs = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                        lambda other: F.struct(F.least(other, F.col("piece")).alias("low"),
                                               F.greatest(other, F.col("piece")).alias("high")))
    shards = (dealt.withColumn("piece", piece)
                   .select("key", F.explode(pairs).alias("pair"), "fp")
                   .groupBy("key", "pair").agg(F.collect_list("fp").alias("members"))
                   .filter(F.size("members") > 1).select("members"))
    return shards.mapInArrow(linked, "a long, b long")


def _grouped(rows: DataFrame, name: list[str], radius: int) -> tuple[DataFrame, DataFrame]:
    """Roots (fp, root) of the fingerprints of ``rows``, and of each root the
    first row by ``name``: the smallest id, NULL last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *name)).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct")
    reached = smallest_reachable(links(distinct.select("fp"), radius)) \
        .withColumnRenamed("node", "fp")
    roots = written(distinct.join(reached, "fp", "left")
                            .select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")
    names = written(roots.groupBy("root").agg(F.min("first").alias("first")), "names")
    return roots.select("fp", "root"), names


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, fp, component_id (smallest id reachable)."""
    rows = written(fingerprints(id_text(docs, id_col, text_col), shingle), "fingerprints")
    roots, names = _grouped(rows, ["doc_id"], radius)
    by_fp = written(roots.join(names, "root")
                         .select("fp", F.col("first.doc_id").alias("component_id")), "components")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the
    smallest id (of rows that share it, the one that stands first).  Texts are
    not moved: the places of the rows that stay are looked up where the texts are
    read (``positions``)."""
    docs = positions.located(docs)
    rows = written(fingerprints(positions.with_place(
        docs, *id_text_columns(id_col, text_col)), shingle), "fingerprints")
    _, names = _grouped(rows, ["doc_id", positions.FILE, positions.ROW], radius)
    return positions.chosen(docs, names.select("first.*"), keep=True)
