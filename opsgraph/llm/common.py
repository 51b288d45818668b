"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.functions.folds import chunks, let, running
from opsgraph.plans.lineage import cut as saved
from opsgraph.plans.lineage import forget

__all__ = ["chunks", "forget", "let", "running", "saved"]

#: Keys that hold more than one in HEAVY of the rows, and more than LIGHT rows, are met by broadcast.
HEAVY, LIGHT = 1000, 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(rows: DataFrame, dims: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """rows joined with dims (one row a key) by a null-free key, no key's rows in one task.

    counts (key, n) says how many of the `total` rows have each key. Keys with over one in HEAVY of all
    rows are at most HEAVY; they are met by a broadcast, so their rows stay where they are, and only the
    others are shuffled.
    """
    limit = max(LIGHT, total // HEAVY)
    hot = counts.where(F.col("n") > limit).select(key).collect() if total > limit else []
    if not hot:
        return rows.join(dims, key)
    hot = F.broadcast(dims.sparkSession.createDataFrame(hot, counts.select(key).schema))
    many = F.broadcast(dims.join(hot, key, "left_semi"))
    return rows.join(many, key).unionByName(rows.join(hot, key, "left_anti").join(dims, key))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to at most limit, or single larger rows: bounds the memory a worker needs at once."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and the bounds (one more than texts). Lone surrogates pass through."""
    parts = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint32), bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), in new memory."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers, by place.
FACTORS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


@lru_cache(1)
def _in_words() -> np.ndarray:
    """Of each code point: whether it is a letter or digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def runs_hashed(codes: np.ndarray, within: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of codes that are within, of texts that begin and end at `at`, and the bounds of each text's."""
    word = np.append(within, False)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[at[:-1]] |= word[at[:-1]]
    stops = np.append(begins[1:], False) | ~np.append(word[1:], False)
    starts, ends = np.flatnonzero(begins), np.flatnonzero(word & stops) + 1
    own, sizes = codes[within].astype(np.uint64), ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(own)) - np.repeat(first, sizes)
    values = np.add.reduceat(mix(own + np.uint64(1)) * FACTORS[place & 4095], first) if len(first) else np.zeros(0, np.uint64)
    return mix(values + sizes.astype(np.uint64)), np.searchsorted(starts, at)


def tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters and digits, lower case) of all texts in a row, and the bounds (one more than texts)."""
    points, at = code_points([t.lower() for t in texts])
    return runs_hashed(points, _in_words()[points], at)


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """Each row of docs as one column `_row`, and the columns named: working names can't clash with the caller's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in own.items()))


def unpacked(work: DataFrame, docs: DataFrame, **results: Column | str) -> DataFrame:
    """The columns of docs, and the results; a result replaces a column of the same name (in any case)."""
    names = {n.lower() for n in results}
    return work.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in names), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in results.items()))
