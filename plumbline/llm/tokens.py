"""Token ids in ORC: run-length encoded stripes, row indexes, Bloom filters on ids (operator 1)."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Units, Vocabulary, grouped
from .common import arrow_rows


@dataclass(frozen=True)
class TokenFileParams:
    tokenizer: str
    #: Appended to every document.
    end_id: int = 2
    stripe_bytes: int = 64 << 20
    #: Rows of one entry of the row index, and of one Bloom filter.
    index_rows: int = 1000
    bloom_fpp: float = 0.01


#: Units kept by a worker in each of two generations, and bytes of text that it encodes at a time. Arrow
#: and numpy take several times the text for a while, beside the JVM and a second worker of the executor.
UNITS_KEPT, GROUP_BYTES = 200_000, 4 << 20


class LibraryEncoder:
    """The tokenizers library, called once for many units of text instead of once for each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # merges and pairs are not needed here, so the vocabulary goes
        v = Vocabulary(path)
        self.size, self.special = v.pool_size, tuple(v.special)
        self.units = Units(self.many, lambda t: self.each([t])[0], UNITS_KEPT)

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, units: list[str]) -> list[bytes]:
        """Units that begin with a space and end without are encoded as one text, whose ids are cut at their bytes."""
        joined = [k for k, u in enumerate(units) if len(u) > 1 and u[0] == " "]
        out: list[bytes] = [b""] * len(units)
        for at in range(0, len(joined), 4096):
            some = joined[at : at + 4096]
            own = [units[k] for k in some]
            packed = self.each(["".join(own)])[0]
            ends = np.cumsum(pc.binary_length(pa.array(own, pa.large_string())).to_numpy())
            cut = (4 * np.searchsorted(np.cumsum(self.size[np.frombuffer(packed, "<u4").astype(np.int64)]), ends, "right")).tolist()
            for k, a, b in zip(some, [0, *cut[:-1]], cut, strict=True):
                out[k] = packed[a:b]
        rest = [k for k, u in enumerate(units) if u and not (len(u) > 1 and u[0] == " ")]
        for k, packed in zip(rest, self.each([units[k] for k in rest]), strict=True):
            out[k] = packed
        return out

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        return self.units.ids(texts, self.special)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for a worker process, so its cache serves all tasks that the worker runs."""
    return LibraryEncoder(path)


FILES = "shard int, first long, doc_id long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, params: TokenFileParams) -> None:
    """Encodes every text and writes (shard, first, doc_id, n_tokens, ids) as ORC in ascending doc_id order.

    `first` counts the ids of the shard's documents before this one, so the place
    of a document in its file does not depend on how a reader sorts what repeats an id.

    Documents are range-partitioned by id (and by a hash of the text, so that an
    id that repeats very often is still dealt to several tasks); a task writes
    one file, sorted, so files and stripes hold disjoint ranges of ids, and a
    reader's filter on doc_id skips files, stripes and index entries by their
    statistics and Bloom filters. A null or empty text has the end id only; null
    ids come first.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    end, tokenizer = params.end_id, params.tokenizer

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = library_encoder(tokenizer), 0
        for batch in grouped(batches, GROUP_BYTES):
            plain, size = encoder.batch([t or "" for t in batch.column("text").to_pylist()])
            flat = np.insert(plain.astype(np.int32), np.cumsum(size), end)
            size = size + 1
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat, pa.int32()))
            before = first + np.cumsum(size) - size
            first += int(size.sum())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(before), batch.column("doc_id"), pa.array(size), ids], names=["shard", "first", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    placed = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    (
        placed.mapInArrow(encode, FILES)
        .write.option("orc.compress", "LZ4")
        .option("orc.stripe.size", params.stripe_bytes)
        .option("orc.row.index.stride", params.index_rows)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", params.bloom_fpp)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, a null id's first in them; no rows if no document was written. Filters on doc_id skip files, stripes and index entries."""
    return spark.read.schema(FILES).orc(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in the order of the files:
    one sum a shard (a row for each file), accumulated, and the shard's own count.
    Of documents that share an id, or have none, each has its own place.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "first", "doc_id", "n_tokens")), pa.array(crc, pa.int64())], names=["shard", "first", "doc_id", "n_tokens", "ids_crc32"])

    arrow_rows(spark)
    rows = read_token_files(spark, path).mapInArrow(digest, "shard int, first long, doc_id long, n_tokens long, ids_crc32 long")
    sums = read_token_files(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = sums.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
