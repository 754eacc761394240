"""Text embeddings without a trained encoder: TF-IDF of character n-grams, projected on its leading singular vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored

NOT_BLANK = re.compile(r"\S+")


@dataclass(frozen=True)
class EmbeddingParams:
    #: Lengths of n-grams inside words (with a blank on either side), and buckets that they are hashed to.
    least: int = 3
    most: int = 5
    buckets: int = 1 << 14
    #: Dimensions at most (one less than the texts), and how many more directions are carried along.
    dimensions: int = 128
    spare: int = 64
    #: Passes over the rows.
    passes: int = 5
    #: Texts whose rows are multiplied together, and characters of a text that are hashed together.
    block: int = 256
    most_chars: int = 1 << 20
    seed: int = 42


def gram_counts(text: str, params: EmbeddingParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, in order, and how often each occurs. Each word stands between two blanks; no n-gram spans two words."""
    total = np.zeros(params.buckets, np.int64)
    words = NOT_BLANK.findall(text.lower())
    size, some = 0, []
    for k, w in enumerate(words):
        some.append(w)
        size += len(w) + 2
        if size < params.most_chars and k < len(words) - 1:
            continue
        points = np.frombuffer("".join(f" {x} " for x in some).encode("utf-32-le", "replace"), "<u4")
        length = np.array([len(x) + 2 for x in some])
        room = np.repeat(np.cumsum(length), length) - np.arange(len(points))  # characters left in the word
        h = np.zeros(len(points), np.uint32)
        for n in range(1, min(params.most, len(points)) + 1):
            count = len(points) - n + 1
            h = h[:count] * np.uint32(0x01000193) ^ (points[n - 1 :].astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(n))
            if n >= params.least:
                mixed = h[room[:count] >= n]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount((mixed ^ (mixed >> np.uint32(12))) % np.uint32(params.buckets), minlength=params.buckets)
        size, some = 0, []
    at = np.flatnonzero(total)
    return at, total[at]


ROWS = "at array<int>, times array<int>"


def counted(texts: DataFrame, text: str, params: EmbeddingParams) -> DataFrame:
    """texts with `at` and `times`: the buckets of each text and their counts; empty for a null or blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [gram_counts(t or "", params) for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(at) for at, _ in rows)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows] or [np.zeros(0)]).astype(np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "at", "times"])

    kept = texts.drop("at", "times")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + ROWS)


def dense(batch: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF rows of a batch, each of length 1 (or 0)."""
    at, times = (batch.column(c) for c in ("at", "times"))
    many = np.diff(at.offsets.to_numpy())
    out = np.zeros((batch.num_rows, len(idf)), np.float32)
    bucket = at.flatten().to_numpy()
    out[np.repeat(np.arange(batch.num_rows), many), bucket] = times.flatten().to_numpy() * idf[bucket]
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def summed_products(rows: DataFrame, idf, right, params: EmbeddingParams, gram: bool) -> np.ndarray:
    """A'A R (or, with gram, R'A'A R) for the rows A and a matrix R, added up from the products of blocks of rows.

    A task sends one matrix, cut into strips of its rows; Spark adds the strips.
    Their sum has a fixed size, whatever the number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = right.value.astype(np.float32)
        total = np.zeros((r.shape[1] if gram else r.shape[0], r.shape[1]))
        for batch in batches:
            for k in range(0, batch.num_rows, params.block):
                a = dense(batch.slice(k, params.block), idf.value)
                b = a @ r
                total += b.T @ b if gram else a.T @ b
        strip = 1024
        strips = [total[k : k + strip].tobytes() for k in range(0, len(total), strip)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(strips)), pa.int32()), pa.array(strips, pa.binary())], names=["strip", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in group.column("part").to_pylist())
        return pa.table({"strip": group.column("strip").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    # two steps, so that no task adds up what very many tasks sent
    parts = rows.mapInArrow(run, "strip int, part binary").withColumn("some", F.spark_partition_id() % 64)
    some = parts.groupBy("strip", "some").applyInArrow(add, "strip int, part binary")
    done = some.groupBy("strip").applyInArrow(add, "strip int, part binary").collect()
    flat = b"".join(r.part for r in sorted(done, key=lambda r: r.strip)) if done else b""
    shape = (right.value.shape[1] if gram else right.value.shape[0], right.value.shape[1])
    return np.frombuffer(flat, np.float64).reshape(shape) if flat else np.zeros(shape)


@dataclass
class EmbeddingModel:
    idf: np.ndarray
    #: Singular values, and a column for each with the loadings of the buckets; the largest loading of each is positive.
    values: np.ndarray
    loadings: np.ndarray


def fitted(rows: DataFrame, params: EmbeddingParams) -> EmbeddingModel:
    """The model of all rows of counted(): document frequencies, then randomised subspace iteration.

    Each pass multiplies all rows with a matrix of a fixed size, in tasks; the
    driver orthogonalises that matrix (buckets x directions) between passes.
    """
    context = rows.sparkSession.sparkContext
    used = rows.where(F.size("at") > 0)
    n = used.count()
    frequency = np.zeros(params.buckets)
    for r in used.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():  # a row for each bucket at most
        frequency[r["at"]] = r["n"]
    idf = np.log((1 + n) / (1 + frequency)) + 1
    dimensions = max(0, min(params.dimensions, n - 1))
    if not dimensions:
        return EmbeddingModel(idf, np.zeros(0), np.zeros((params.buckets, 0)))
    wide = min(dimensions + params.spare, n, params.buckets)
    shared_idf = context.broadcast(idf)
    basis = np.linalg.qr(np.random.default_rng(params.seed).normal(size=(params.buckets, wide)))[0]
    for _ in range(params.passes):
        right = context.broadcast(basis)
        basis = np.linalg.qr(summed_products(used, shared_idf, right, params, gram=False))[0]
        right.unpersist()
    square = summed_products(used, shared_idf, context.broadcast(basis), params, gram=True)
    values, turn = np.linalg.eigh((square + square.T) / 2)
    values, turn = values[::-1][:dimensions], turn[:, ::-1][:, :dimensions]
    loadings = basis @ turn
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(dimensions)])
    return EmbeddingModel(idf, np.sqrt(np.maximum(values, 0)), loadings * sign)


def projected(rows: DataFrame, model: EmbeddingModel, params: EmbeddingParams, column: str = "embedding") -> DataFrame:
    """rows of counted() with the unit vector of each; a text without n-grams has zeros."""
    shared = rows.sparkSession.sparkContext.broadcast((model.idf, model.loadings.astype(np.float32)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, loadings = shared.value
        for batch in batches:
            vectors = np.concatenate([dense(batch.slice(k, params.block), idf) @ loadings for k in range(0, batch.num_rows, params.block)] or [np.zeros((0, loadings.shape[1]), np.float32)])
            vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel().astype(np.float32)))
            rest = batch.drop_columns(["at", "times"])
            yield pa.RecordBatch.from_arrays([*rest.columns, lists], names=[*rest.schema.names, column])

    kept = rows.drop("at", "times", column)
    return rows.drop(column).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", {column} array<float>")


def embedded(texts: DataFrame, key: str, text: str = "text", params: EmbeddingParams = EmbeddingParams(), model: EmbeddingModel | None = None) -> DataFrame:
    """(key, embedding) of every row, of length 1, by a model of these texts or a given one.

    A null or blank text has a zero vector and no part in the model; repeated
    keys give one row each; with fewer than two texts vectors have no component.
    """
    with Scratch(texts.sparkSession) as t:
        rows = t.stored(counted(texts.select(key, text), text, params).drop(text), "grams")
        return stored(projected(rows, model or fitted(rows, params), params), "embedded")
