"""Counts by 64-bit key, counted on the cluster and kept as sorted hash arrays.

Tasks count the keys of their rows in sorted arrays and hand them on in blobs,
one for each bucket of keys, so a row of the shuffle carries thousands of keys
in a few bytes each.  A bucket is a range of keys; keys are hashes (or made
uniform by a bijection), so buckets are even whatever the data, and the number
of buckets follows the session's shuffle partitions.  Each bucket's task merges
its blobs and writes the sorted keys and their counts as plain arrays into the
shared folder, from where workers map them into memory.

The shared folder must be a mounted one (``file:``), as memory maps need files.
A file is written under a name of its own and named in the task's result only
when it is complete, so a repeated or lost task does no harm.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, written

KEY = np.dtype("<u8")
COUNT = np.dtype("<u4")
RANGE = 500_000  # counts that are merged at once
MANY = 255  # counts from here on are written twice
BLOBS = "bucket int, keys binary, counts binary"
FILES = "bucket int, path string, n long, kind string, note binary"

#: An odd factor, so multiplying by it is a bijection of 64-bit integers.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def mix(keys: np.ndarray) -> np.ndarray:
    return keys.astype(KEY) * np.uint64(_FACTOR)


def unmix(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(_INVERSE)


def mounted(path: str) -> str:
    """The place of a shared folder in the file system."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"sorted arrays are memory-mapped: {path} is not a mounted folder")
    return "/" + rest.lstrip("/")


def _planes(values: np.ndarray) -> bytes:
    """How many bytes a value takes, then the values' bytes by significance, so that
    the zero ones compress away; those above the highest of all values are left out."""
    size = values.dtype.itemsize
    raw, out = values.view(np.uint8).reshape(-1, size), np.empty((size, len(values)), np.uint8)
    for i in range(size):  # several times faster than a transposed copy
        out[i] = raw[:, i]
    while size > 1 and not out[size - 1].any():
        size -= 1
    return bytes([size]) + out[:size].tobytes()


def _unplanes(raw, kind: np.dtype) -> np.ndarray:
    held = np.frombuffer(raw, np.uint8)
    planes = held[1:].reshape(held[0], -1)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view(kind).reshape(-1)


def blobs(keys: np.ndarray, counts: np.ndarray, buckets: int, below: int = 1 << 64) -> pa.RecordBatch:
    """Rows of BLOBS for sorted distinct ``keys``, all less than ``below``; ``counts``: a
    row for each key."""
    counts = counts.reshape(len(keys), -1 if len(keys) else 1).astype(COUNT)
    # the bucket of a key is its share of the whole range
    edges = np.array([b * below // buckets for b in range(1, buckets)], KEY)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(b, _planes(np.diff(keys[i:j], prepend=KEY.type(0))), _planes(counts[i:j].reshape(-1)))
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    bucket, key, count = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(key, pa.binary()), pa.array(count, pa.binary())],
        ["bucket", "keys", "counts"])


def ascending(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys (``np.unique`` hashes them, which takes many times longer)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts (rows)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(keys) else counts


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of sorted runs of keys and their counts, a range of keys at a time."""
    longest = max((k for k, _ in runs), key=len)
    ranges = max(1, sum(c.size for _, c in runs) // RANGE)
    edges = longest[[len(longest) * i // ranges for i in range(1, ranges)]]
    cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k, _ in runs]
    done = [distinct(np.concatenate([k[at[i]:at[i + 1]] for (k, _), at in zip(runs, cuts)]),
                     np.concatenate([c[at[i]:at[i + 1]] for (_, c), at in zip(runs, cuts)])
                       .astype(np.int64)) for i in range(ranges)]
    return np.concatenate([k for k, _ in done]), np.concatenate([c for _, c in done])


def _store(place: str, bucket: int, keys: np.ndarray, values: np.ndarray, note: bytes,
           dense: bool = False) -> pa.Table:
    """Write one bucket's arrays; its row of FILES.

    Counts are written as bytes, those that no byte holds (the byte is ``MANY``) once
    more in full beside their places.  ``dense``: the keys follow each other, so the
    first of them is enough."""
    os.makedirs(place, exist_ok=True)
    path = f"{place}/{uuid.uuid4().hex}"
    (keys[:1] if dense else keys).tofile(path + ".keys")
    if values.dtype.kind != "f":
        flat = values.reshape(-1)
        at = np.flatnonzero(flat >= MANY)
        at.astype(np.int64).tofile(path + ".at")
        flat[at].astype(np.int64).tofile(path + ".many")
        values = np.minimum(flat, MANY).astype(np.uint8)
    values.tofile(path + ".values")
    return pa.table({
        "bucket": pa.array([bucket], pa.int32()), "path": [path],
        "n": pa.array([len(keys)], pa.int64()), "kind": [values.dtype.str],
        "note": pa.array([note], pa.binary())})


def merged(table: DataFrame, folder: str, columns: int, then=None,
           dense: bool = False) -> DataFrame:
    """Merge BLOBS by bucket and write each bucket's arrays: FILES.

    ``then(keys, counts)`` gives the note of a bucket (bytes).  ``dense``: the keys of
    all buckets are the numbers from 0 on, none left out."""
    place = mounted(folder)

    def merge(key, rows):
        release_memory()
        keys, counts = _summed([
            (np.cumsum(_unplanes(k.as_buffer(), KEY), dtype=KEY),
             _unplanes(c.as_buffer(), COUNT).reshape(-1, columns))
            for k, c in zip(rows["keys"], rows["counts"])])
        if dense and len(keys) != int(keys[-1]) - int(keys[0]) + 1:
            raise RuntimeError("a number is missing")
        return _store(place, key[0].as_py(), keys, counts, then(keys, counts) if then else b"",
                      dense)

    return written(table.groupBy("bucket").applyInArrow(merge, FILES), "files")


def stored(table: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write (key long, uniform; value double) as sorted arrays: FILES."""
    place = mounted(folder)

    def store(key, rows):
        keys = rows["key"].to_numpy().view(KEY)
        order = np.argsort(keys)
        return _store(place, key[0].as_py(), keys[order], rows["value"].to_numpy()[order], b"")

    # a long is signed: those below zero are the upper half of the keys
    share = F.col("key") / F.lit(2.0 ** 64)
    bucket = F.floor(F.when(share < 0, share + 1).otherwise(share) * buckets)
    return written(table.withColumn("bucket", F.least(bucket, F.lit(buckets - 1)).cast("int"))
                        .groupBy("bucket").applyInArrow(store, FILES), "files")


class Values:
    """The values of one file, a row for each key, mapped into memory."""

    def __init__(self, path: str, n: int, kind: str, columns: int):
        self.dtype = np.dtype(kind)
        self.values = np.asarray(np.memmap(path + ".values", kind, "r", shape=(n, columns)))
        self.places = self.many = None
        if self.dtype.kind != "f":
            self.dtype = np.dtype(np.int64)
            self.places = np.fromfile(path + ".at", np.int64)
            if len(self.places):
                self.places = np.memmap(path + ".at", np.int64, "r")
                self.many = np.memmap(path + ".many", np.int64, "r")

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        found = self.values.take(rows, axis=0)
        if self.places is None:
            return found
        many, width = np.flatnonzero(found.reshape(-1) == MANY), found.shape[1]
        found = found.astype(np.int64)
        if len(many):
            at = rows[many // width] * width + many % width
            found.reshape(-1)[many] = self.many[np.searchsorted(self.places, at)]
        return found


def file_values(path: str, n: int, kind: str, columns: int = 1) -> np.ndarray:
    """All values of a file."""
    return Values(path, n, kind, columns)[np.arange(n)]


@dataclass
class SortedArrays:
    """Handle of a written table; what it holds is mapped on first use."""
    files: list[tuple[str, int, str]]
    columns: int = 1

    @classmethod
    def of(cls, files: DataFrame, columns: int = 1) -> SortedArrays:
        # one row per bucket
        rows = files.select("path", "n", "kind", "bucket").collect()
        arrays = cls([(r["path"], r["n"], r["kind"]) for r in rows if r["n"]], columns)
        # buckets may share an edge only through rounding: the keys decide
        arrays.files.sort(key=lambda f: int(np.fromfile(f[0] + ".keys", KEY, 1)[0]))
        return arrays

    def __len__(self) -> int:
        return sum(n for _, n, _ in self.files)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def maps(self):
        if not hasattr(self, "_maps"):
            self._maps = [(np.memmap(path + ".keys", KEY, "r"), Values(path, n, kind, self.columns))
                          for path, n, kind in self.files]
            self._first = np.array([k[0] for k, _ in self._maps], KEY)
            self._offset = np.cumsum([0, *[n for _, n, _ in self.files]])
        return self._maps

    def offset(self, path: str) -> int:
        """The place of the first key of a file."""
        self.maps()
        return int(self._offset[[f[0] for f in self.files].index(path)])

    def _at(self, places: np.ndarray, out: np.ndarray, part: int) -> np.ndarray:
        maps = self.maps()
        file = np.searchsorted(self._offset, places, "right") - 1
        # the places by file, each file's in a row
        order = np.argsort(file.astype(np.uint16) if len(maps) < 1 << 16 else file, kind="stable")
        cuts = np.searchsorted(file[order], np.arange(len(maps) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            here = order[cuts[i]:cuts[i + 1]]
            out[here] = maps[i][part][places[here] - self._offset[i]]
        return out

    def keys_at(self, places: np.ndarray) -> np.ndarray:
        """The keys at these places."""
        return self._at(places, np.empty(len(places), KEY), 0)

    def values_at(self, places: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return self._at(places, np.empty((len(places), self.columns), np.int64), 1)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``find`` for keys in any order."""
        some, back = np.unique(keys, return_inverse=True)
        place, values = self.find(some)
        return place[back], values[back]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted ``keys``: the place of each among all (-1: not there), and
        its values (zeros)."""
        maps = self.maps()
        kind = np.result_type(np.int64, *[v.dtype for _, v in maps])
        place = np.full(len(keys), -1, np.int64)
        values = np.zeros((len(keys), self.columns), kind)
        cuts = [*np.searchsorted(keys, self._first).tolist(), len(keys)]
        for (held, rows), offset, i, j in zip(maps, self._offset, cuts, cuts[1:]):
            if i < j:
                at = np.searchsorted(held, keys[i:j])
                at[at == len(held)] = 0
                there = held[at] == keys[i:j]
                place[i:j][there] = at[there] + offset
                values[i:j][there] = rows[at[there]]
        return place, values
