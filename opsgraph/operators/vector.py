"""Vectors: normalising, exact nearest neighbours, a hashing embedder, and checks that a cache still fits its texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.operators.best import Best
from opsgraph.operators.lexical import best
from opsgraph.plans.lineage import cut

TOP, QUERY_BLOCK = 40, 2048


def normalised(vector: str | Column) -> Column:
    """Divided by the length, which is taken as at least 1e-9."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(question_id, id, score, place): the `top` greatest dot products; equal scores: the greater id.

    vectors (id, embedding), queries (question_id, embedding), ids long. The queries are the stated set:
    the driver takes them block by block, QUERY_BLOCK at a time; each block is sent to the vectors, every
    task keeps its own best `top` of each query by matrix products of few rows at a time (`best.Best`), so that
    its memory is that of the block's results, and only those are written down and compared in the end,
    before the next block is taken. Null vectors are skipped.
    """
    found, rows = None, []
    left = iter(queries.where("embedding is not null").select("question_id", "embedding").toLocalIterator())
    more = True
    while more:
        rows = [(r.question_id, r.embedding) for r in islice(left, QUERY_BLOCK)]
        more = len(rows) == QUERY_BLOCK
        if rows:
            part, sent = _local_best(vectors, rows, top)
            if found is not None or more:  # a single block needs no writing down
                part = cut(best(part, top))
                sent.destroy()
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "question_id long, id long, score double")
    return best(found.select("question_id", "id", "score"), top)


def _local_best(vectors: DataFrame, rows: list, top: int) -> tuple[DataFrame, Broadcast]:
    ids = np.array([i for i, _ in rows], np.int64)
    matrix = vectors.sparkSession.sparkContext.broadcast(np.array([v for _, v in rows], np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kept = matrix.value, Best(len(ids), top)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, own = batch.column(1), batch.column(0).to_numpy()
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
            for part in kept.blocks(len(own)):
                kept.add(own[part], v[part].astype(np.float64) @ q.T)
        if (found := kept.rows()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[1]]), pa.array(found[0]), pa.array(found[2])], names=["question_id", "id", "score"])

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null").mapInArrow(scan, "question_id long, id long, score double"), matrix


def hashed_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder that needs no model: signed hashes of tokens, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall("[a-z0-9_]+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embedded(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", prefix: str = "", longest: int = 8000, attempts: int = 4) -> DataFrame:
    """docs with embedding, by any function of texts; a failing call is tried again. Texts are cut at `longest` characters, as the model's input is bounded."""

    @F.pandas_udf("array<float>")
    def of(texts):
        values = [prefix + (t or "")[:longest] for t in texts]
        for left in reversed(range(attempts)):
            try:
                found = embed(values)
                break
            except (OSError, RuntimeError):
                if not left:
                    raise
        norm = np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
        import pandas as pd

        return pd.Series(list((found / norm).astype(np.float32)))

    return docs.withColumn("embedding", of(text))


def checked(vectors: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """vectors, if their ids are just those of docs; else an error, for ranks over another corpus are wrong without a sign."""
    missing, spare = docs.join(vectors, key, "left_anti").count(), vectors.join(docs, key, "left_anti").count()
    if missing or spare:
        raise ValueError(f"the vectors are of another corpus: {missing} documents without one, {spare} without a document")
    return vectors


def cells(vectors: DataFrame, count: int = 64, sample: int = 4096, rounds: int = 10) -> np.ndarray:
    """Centres of an index's cells, by k-means on a bounded sample: the rows of least hash in each of `sample` buckets."""
    h = F.xxhash64("id")
    rows = vectors.where("embedding is not null").groupBy(F.pmod(h, F.lit(sample))).agg(F.min_by("embedding", h).alias("e")).select("e").collect()
    x = np.array([r.e for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, 1)
        for k in range(len(centres)):
            if (near == k).any():
                mean = x[near == k].mean(0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
    return centres


def indexed(vectors: DataFrame, centres: np.ndarray, copies: int = 2) -> DataFrame:
    """vectors (cell, id, embedding): every row in its `copies` nearest cells. Write it partitioned by cell."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(v):
        import pandas as pd

        return pd.Series(np.argsort(-(np.stack(v.to_numpy()) @ sent.value.T), axis=1, kind="stable")[:, :copies].astype(np.int32).tolist())

    return vectors.where("embedding is not null").select(F.explode(near("embedding")).alias("cell"), "id", "embedding")


def nearest_in_cells(index: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int = 16, top: int = TOP) -> DataFrame:
    """nearest(), but over the queries' `probes` nearest cells only; recall is to be measured against nearest()."""
    asked = cut(indexed(queries.select(F.col("question_id").alias("id"), "embedding"), centres, probes).select("cell", F.col("id").alias("question_id"), F.col("embedding").alias("_q")))
    pairs = index.join(asked, "cell")  # by a broadcast only where the written size of the queries allows
    scored = pairs.select("question_id", "id", F.round(dot("embedding", "_q"), 9).alias("score")).distinct()
    return best(scored, top)


def cached(path: str, docs: DataFrame, make: Callable[[DataFrame], DataFrame], seal: str) -> DataFrame:
    """Vectors from a folder named by the texts' fingerprint; made and written if there are none, so vectors of other texts are never taken."""
    from pyspark.errors import AnalysisException

    place = f"{path}/{seal}"
    try:
        return docs.sparkSession.read.parquet(place)
    except AnalysisException:
        make(docs).write.parquet(place)
        return docs.sparkSession.read.parquet(place)
