"""Rows named by where they stand: a file and a row number in it.

To drop or pick some rows of a table of texts, a join would shuffle every text.
Here a row's place goes into the narrow tables of an operator instead (Spark
gives each row of a Parquet scan its file and number), and in the end the places
to drop or pick go back to the texts: as bitmaps, one of 4 KB for each block of
32,768 rows of a file that has any, which the scan's tasks look a row up in.

The bitmaps are broadcast, ``BLOCKS`` of them (32 MB) at most; where there are
more, the files are dealt into parts by a hash of their names, and each part is
a scan of its own files with its own bitmaps.  So texts are read where they are
and never shuffled, at any size.

A table that is not read from Parquet row by row (built in memory, exploded,
joined) has no such places: it is written once and its copy used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a block (what a bitmap of Spark's holds); bitmaps of one broadcast.
BLOCK, BLOCKS = 32768, 8192
FILE, ROW = "file", "row"


def _place(docs: DataFrame) -> tuple[Column, Column]:
    meta = docs.metadataColumn("_metadata")
    return meta["file_path"], meta["row_index"]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` if each of its rows has a place of its own, else a written copy."""
    try:
        file, row = _place(docs)
        places = docs.select(F.xxhash64(file).alias(FILE), row.alias(ROW))
        twice = places.groupBy(FILE, ROW).count().filter("count > 1")
        if places.filter(F.col(ROW).isNull()).isEmpty() and twice.isEmpty():
            return docs
    except AnalysisException:
        pass
    return written(docs, "located")


def with_place(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of located ``docs``, and file and row."""
    file, row = _place(docs)
    return docs.select(*columns, file.alias(FILE), row.alias(ROW))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``columns`` has (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chosen(docs: DataFrame, marks: DataFrame, keep: bool, columns: list[Column] | None = None,
           blocks: int = BLOCKS) -> DataFrame:
    """The rows of located ``docs`` that ``marks`` (file, row) name, or the others
    if not ``keep``: all columns, or ``columns`` and file and row."""
    bits = written(marks.groupBy(FILE, F.floor(F.col(ROW) / BLOCK).alias("block")).agg(
        F.bitmap_construct_agg(F.pmod(F.col(ROW), F.lit(BLOCK))).alias("bits")), "marks")
    number = bits.count()
    if not number:
        parts = [(F.lit(True), bits)]
    else:
        parts = list(_parts(docs, bits, number, blocks))
    file, row = _place(docs)
    f, b, w, m, r = fresh(docs.columns, "mark_file", "mark_block", "mark_bits", "_meta_file",
                          "_meta_row")
    out = None
    for where, some in parts:
        some = some.select(F.col(FILE).alias(f), F.col("block").alias(b), F.col("bits").alias(w))
        rows = docs.filter(where).select("*", file.alias(m), row.alias(r))
        # at most ``blocks`` bitmaps, unless one file alone has more
        met = rows.join(F.broadcast(some), (F.col(m) == F.col(f))
                        & (F.floor(F.col(r) / BLOCK) == F.col(b)), "left")
        at = F.pmod(F.col(r), F.lit(BLOCK))
        byte = F.substring(F.col(w), (at / 8).cast("int") + 1, F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int"))
        hit = F.coalesce(bit == 1, F.lit(False))
        part = met.filter(hit if keep else ~hit).select(
            *[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns] if columns is None
            else [*columns, F.col(m).alias(FILE), F.col(r).alias(ROW)])
        out = part if out is None else out.unionAll(part)
    return out


def _parts(docs: DataFrame, bits: DataFrame, number: int, blocks: int):
    """(which rows of ``docs``, their bitmaps) of each part."""
    if number <= blocks:
        yield F.lit(True), bits
        return
    file, _ = _place(docs)
    count = -(-2 * number // blocks)

    def part(name):
        return F.pmod(F.xxhash64(name), F.lit(count))

    for i in range(count):
        yield part(file) == i, bits.filter(part(F.col(FILE)) == i)
