"""Two tokenizers' tokens of the same text, aligned at shared byte offsets (operator 11)."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLANKS, ENDS, Known
from .common import Tables, arrow_rows, gathered, stored
from .tokens import LibraryEncoder

#: A single space between two other characters than blanks: no token of either kind crosses it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a unit that is kept with its ids for later texts.
LONG = 64
#: Units that a worker keeps, in each of two generations.
KEPT = 120_000
#: Marks the ids of B where both kinds lie together.
OF_B = 1 << 31
#: A letter or digit and a closing mark behind it.
MARKED = re.compile(r"[^\W_][" + re.escape(ENDS) + "]")
#: A space behind another character, inside a piece.
INNER_SPACE = re.compile("[^▁]▁")


@dataclass(frozen=True)
class AlignmentParams:
    #: File of byte-level BPE for the tokenizers library (A), and a sentencepiece model (B).
    a: str
    b: str
    #: Characters of texts that are aligned together; longer texts go in parts.
    block_chars: int = 2 << 20


@dataclass
class Units:
    """Distinct units of some texts, aligned: unit k has links[at[k]:at[k + 1]] (places in pairs) and a string of groups."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    bad: np.ndarray
    at: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    said: pa.Array


class Aligner:
    """Both tokenizers in one worker.

    A text with a space before it is cut where a single space stands between
    two other characters than blanks, and before the closing marks of the pieces.
    Tokens of both kinds end there, so what a unit holds is aligned once for all
    its occurrences.
    """

    def __init__(self, params: AlignmentParams):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = LibraryEncoder(params.a)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=params.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if any(INNER_SPACE.search(p) for p in pieces):
            raise ValueError(f"{params.b} has pieces with a space behind other characters; its texts can't be cut at spaces")
        self.cut_marks = not any(MARKED.search(p) for p in pieces)
        self.a_names = pa.array([str(i) for i in range(len(self.a.size))])
        self.b_names = pa.array([str(i) for i in range(len(pieces))])
        self.b_pool = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.b_start = np.cumsum(self.b_size) - self.b_size
        self.known = Known(self.encode, KEPT)

    def encode_a(self, stems: list[str]) -> list[bytes]:
        """Packed ids of a space and each stem."""
        plain = [k for k, s in enumerate(stems) if not s[0].isspace() and not s[-1].isspace()]
        out: list[bytes] = [b""] * len(stems)
        for k, ids in zip(plain, self.a.many([" " + stems[k] for k in plain]), strict=True):
            out[k] = ids
        rest = sorted(set(range(len(stems))).difference(plain))
        for k, ids in zip(rest, self.a.each([" " + stems[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def packed_b(self, ids: list[list[int]], want: list[bytes]) -> list[bytes]:
        """Packed ids, each marked as B's; none where their bytes are not what is wanted."""
        if not ids:
            return []
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(many.sum()))
        ends = np.concatenate([[0], np.cumsum(many)])
        size = self.b_size[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        byte = total[ends]
        wanted = np.fromiter(map(len, want), np.int64, len(want))
        good = np.diff(byte) == wanted
        said = self.b_pool[np.repeat(self.b_start[flat] - total[:-1], size) + np.arange(total[-1])]
        there = said[np.repeat(good, np.diff(byte))] == np.frombuffer(b"".join(compress(want, good.tolist())), np.uint8)
        right = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(wanted[good])])]
        good[good] = np.diff(right) == wanted[good]
        packed, at = (flat.astype("<u4") | np.uint32(OF_B)).tobytes(), (4 * ends).tolist()
        return [packed[x:y] if g else b"" for x, y, g in zip(at[:-1], at[1:], good.tolist(), strict=True)]

    def encode(self, stems: list[str]) -> list[bytes]:
        """Packed ids of a space and each stem, A's and then B's; none where B does not give the stem back."""
        b = self.packed_b(self.b.encode(stems, num_threads=1), [b" " + s.encode() for s in stems])
        return [x + y if y else b"" for x, y in zip(self.encode_a(stems), b, strict=True)]

    def encode_marks(self, marks: list[str]) -> list[bytes]:
        """The same for marks that stand behind a letter: B's ids of a letter and the marks, without the letter's."""
        b = [ids[int(np.searchsorted(np.cumsum(self.b_size[ids]), 2)) + 1 :] for ids in self.b.encode(["a" + m for m in marks], num_threads=1)]
        return [x + y if y else b"" for x, y in zip(self.a.each(marks), self.packed_b(b, [m.encode() for m in marks]), strict=True)]

    def looked_up(self, stems: list[str]) -> list[bytes]:
        """What is known of the stems; long ones are not kept."""
        long = [k for k, s in enumerate(stems) if len(s) > LONG]
        if not long:
            return list(map(self.known.all_of(set(stems)).__getitem__, stems))
        short = self.known.all_of({s for s in stems if len(s) <= LONG})
        out = [short.get(s, b"") for s in stems]
        for k, packed in zip(long, self.encode([stems[k] for k in long]), strict=True):
            out[k] = packed
        return out

    def units(self, stems: list[str], marks: list[str]) -> Units:
        packed = [*self.looked_up(stems), *self.encode_marks(marks)]
        count = len(packed)
        first = lambda n: np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(packed), "<u4")
        ends = first(np.fromiter(map(len, packed), np.int64, count) // 4)
        of_b = ids >= OF_B
        at_b = first(of_b)[ends]
        at_a = ends - at_b
        a, b = ids[~of_b].astype(np.int64), (ids[of_b] & np.uint32(OF_B - 1)).astype(np.int64)
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        size_a, size_b = self.a.size[a], self.b_size[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        # bytes up to the end of each unit, the same for both
        until = np.concatenate([[0], end_a])[at_a]
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_at = np.searchsorted(shared, until, "right")
        said = pc.binary_join_element_wise(self.listed(self.a_names, a, end_a, shared), self.listed(self.b_names, b, end_b, shared), "|")
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array(group_at, pa.int32()), said), ";")
        low = np.searchsorted(end_b, end_a - size_a, "right")
        many = np.searchsorted(end_b - size_b, end_a, "left") - low
        place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pairs, links = np.unique(np.repeat(a, many) << 32 | b[place], return_inverse=True)
        return Units(n_a, n_b, np.diff(group_at), n_b == 0, first(many)[at_a], links, pairs, said)

    @staticmethod
    def listed(names: pa.Array, ids: np.ndarray, ends: np.ndarray, shared: np.ndarray) -> pa.Array:
        """For each group the names of its ids, with commas."""
        at = np.concatenate([[0], np.searchsorted(ends, shared, "right")])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(ids))), ",")

    def parts(self, texts: list[str]) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        """The units of the texts, one text's after another's, as places in Units; where each text's begin and end; which text each is."""
        odd = [k for k, t in enumerate(texts) if BLANKS.search(t) or t[0].isspace() or t[-1].isspace()]
        even = np.setdiff1d(np.arange(len(texts)), odd)
        cut = pc.split_pattern(pa.array([texts[k] for k in even.tolist()], pa.large_string()), " ")
        others = [CUT.split(texts[k]) for k in odd]
        ends = np.concatenate([cut.offsets.to_numpy(), len(cut.flatten()) + np.cumsum([len(x) for x in others], dtype=np.int64)])
        numbered = pa.concat_arrays([cut.flatten(), pa.array(list(chain.from_iterable(others)), pa.large_string())]).dictionary_encode()
        pieces, at = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        kinds: dict[str, int] = {}
        mark_at = np.full(len(pieces), -1, np.int64)
        if self.cut_marks:
            trimmed = pc.utf8_rtrim(pieces, ENDS)
            fits = pc.and_(pc.match_substring_regex(trimmed, r"[\pL\pN]$"), pc.not_equal(pieces, trimmed))
            stems = pc.if_else(fits, trimmed, pieces).dictionary_encode()
            marked = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            long, short = (x.take(pa.array(marked)).to_pylist() for x in (pieces, trimmed))
            marks = [p[len(x) :] for p, x in zip(long, short, strict=True)]
            kinds = {m: k for k, m in enumerate(dict.fromkeys(marks))}
            mark_at[marked] = [kinds[m] for m in marks]
        else:
            stems = pieces.dictionary_encode()
        names = stems.dictionary.to_pylist()
        mark_at[mark_at >= 0] += len(names)
        both = np.stack([stems.indices.to_numpy().astype(np.int64)[at], mark_at[at]], 1).ravel()
        there = both >= 0
        return self.units(names, list(kinds)), both[there], np.concatenate([[0], np.cumsum(there)])[2 * ends], np.concatenate([even, np.array(odd, np.int64)])


@lru_cache(maxsize=1)
def aligner(params: AlignmentParams) -> Aligner:
    """One for a worker process."""
    return Aligner(params)


def sections(text: str, most: int) -> Iterator[str]:
    """The text in parts of about `most` characters, cut where units are cut (the space at a cut is dropped, as in units)."""
    at = 0
    while len(text) - at > most and (m := CUT.search(text, at + most)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


@dataclass
class Aligned:
    """Texts aligned together. Text k links the distinct pairs[at[first[k]:first[k + 1]]], times[...] each."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    said: list[str]
    pairs: np.ndarray
    first: np.ndarray
    at: np.ndarray
    times: np.ndarray


def align(texts: list[str], params: AlignmentParams, say=lambda: hashlib.sha256()) -> Aligned:
    """Aligns texts that are not empty. `said` has the hexdigest of what say() makes, updated with the text's groups."""
    own = aligner(params)
    n, known = len(texts), np.zeros((4, len(texts)), np.int64)
    bad, spoke = np.zeros(n, bool), np.zeros(n, bool)
    voices = [say() for _ in texts]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, str]] = []

    def settle() -> None:
        u, units, ends, order = own.parts([p for _, p in held])
        of_text = np.array([k for k, _ in held])[order]
        of_part = np.repeat(np.arange(len(held)), np.diff(ends))
        n_links = np.diff(u.at)
        for row, values in zip(known, (u.n_a, u.n_b, u.n_groups, n_links), strict=True):
            np.add.at(row, of_text, np.diff(np.concatenate([[0], np.cumsum(values[units])])[ends]))
        bad[of_text[of_part[u.bad[units]]]] = True
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), u.said.take(pa.array(units))), ";")
        for (k, _), s in zip(held, whole.take(pa.array(np.argsort(order))), strict=True):
            if spoke[k]:
                voices[k].update(b";")
            voices[k].update(s.as_buffer())
            spoke[k] = True
        key, occurs = np.unique(of_text[of_part] * len(n_links) + units, return_counts=True)
        text, unit = np.divmod(key, len(n_links))
        many = n_links[unit]
        place = np.repeat(u.at[unit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found.append(summed(np.repeat(text, many), u.pairs, u.links[place], np.repeat(occurs, many)))
        held.clear()

    size = 0
    for k, t in enumerate(texts):
        for part in sections(t, params.block_chars):
            held.append((k, part))
            size += len(part)
            if size >= params.block_chars:
                settle()
                size = 0
    if held:
        settle()
    text, pair, times = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    good = ~bad[text]
    text, pair, times = text[good], pair[good], times[good]
    known[:, bad] = 0
    pairs, at = np.unique(pair, return_inverse=True)
    if len(found) > 1:
        text, _, times, at = summed(text, pairs, at, times, places=True)
    said = [v.hexdigest() if not b else "" for v, b in zip(voices, bad, strict=True)]
    return Aligned(*known, said, pairs, np.searchsorted(text, np.arange(n + 1)), at, times)


def summed(text: np.ndarray, pairs: np.ndarray, at: np.ndarray, times: np.ndarray, places: bool = False):
    """Rows of the same text and pair added up, in order of both."""
    key = text * max(len(pairs), 1) + at
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    text, at = np.divmod(key[new], max(len(pairs), 1))
    times = np.add.reduceat(times[order], new) if len(new) else times[:0]
    return (text, pairs[at], times, at) if places else (text, pairs[at], times)


class Voice:
    """Keeps what it is told, where a digest would forget it."""

    def __init__(self):
        self.said: list[bytes] = []

    def update(self, more) -> None:
        self.said.append(bytes(more))

    def hexdigest(self) -> str:
        return b"".join(self.said).decode()


BLOCKS = "block long, pairs array<long>, weights array<long>, docs binary"
MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def keyed(docs: DataFrame) -> DataFrame:
    """Distinct texts that are not empty: key (SHA-256), text, weight (how many documents have it)."""
    texts = docs.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count("*").alias("weight"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "weight")


def text_blocks(docs: DataFrame, params: AlignmentParams) -> DataFrame:
    """Blocks of distinct texts: their distinct id pairs with the number of documents that link each, and the texts' own counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for t in gathered(batches, params.block_chars):
            x = align(t.column("text").to_pylist(), params)
            many = np.diff(x.first)
            weight = np.bincount(x.at, np.repeat(t.column("weight").to_numpy(), many), len(x.pairs)).astype(np.int64)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(x.first, pa.int32()), pa.array(values.astype(np.int32)))
            plain = {"key": t.column("key").combine_chunks(), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links, "groups_sha256": x.said, "at": lists(x.at), "times": lists(x.times)}
            docs = pa.RecordBatch.from_pydict(plain)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(docs)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(x.pairs), one(weight), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "pairs", "weights", "docs"])
            block += 1

    return keyed(docs).mapInArrow(run, BLOCKS)


def counted_pairs(uses: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id) and count from rows of pair and weight."""
    return uses.groupBy("pair").agg(F.sum("weight").alias("count"))


def rated_pairs(counts: DataFrame) -> DataFrame:
    """The counts with `best`: whether no other pair of the A id has more."""
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, params: AlignmentParams) -> DataFrame:
    """a, b, count, best: how many documents link each pair of ids. Texts null or empty, or that B does not give back, link nothing."""
    arrow_rows(docs.sparkSession)
    blocks = text_blocks(docs, params).select(F.explode(F.arrays_zip("pairs", "weights")).alias("x"))
    with Tables(docs.sparkSession) as t:
        rated = rated_pairs(t.stored(counted_pairs(blocks.select(F.col("x.pairs").alias("pair"), F.col("x.weights").alias("weight"))), "pairs"))
        return stored(rated.select(F.shiftright("pair", 32).alias("a"), F.expr("pair & 4294967295").alias("b"), "count", "best"), "pair-counts")


def text_groups(docs: DataFrame, params: AlignmentParams) -> DataFrame:
    """doc_id and groups, the alignment of each text as `a1,a2|b1;a3|b2,b3`; empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = [k for k, t in enumerate(texts) if t]
            said = [""] * len(texts)
            for k, s in zip(at, align([texts[k] for k in at], params, Voice).said, strict=True):
                said[k] = s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string())], names=["doc_id", "groups"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups string")


def aligned_documents(docs: DataFrame, params: AlignmentParams) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are dealt by their full text; each distinct one is tokenised and
    aligned once, in blocks. A block keeps its distinct id pairs and, for each
    text, which of them it links how often, so the join with the counts of the
    whole corpus has a row for a block and pair, not for a document and pair.

    A null or empty text, or one that B's pieces do not give back, has zeros and
    an empty groups_sha256. Repeated rows and null ids give one row each and
    count as documents of their own. Very long texts are aligned in parts; other
    columns of docs are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)

    def measure(_, known: pa.Table, packed: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        count, best = (known.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        docs = pa.ipc.open_stream(packed.column("docs")[0].as_buffer()).read_all().combine_chunks()
        at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
        ends, at, times = at.offsets.to_numpy(), at.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        total = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values[at] * times)])[ends]), pa.int64())
        plain = {c: docs.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(plain | {"n_best": total(best), "count_sum": total(count), "groups_sha256": docs.column("groups_sha256")})

    with Tables(spark) as t:
        blocks = t.stored(text_blocks(docs, params), "blocks")
        uses = blocks.select("block", F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.weights").alias("weight"))
        rated = rated_pairs(t.stored(counted_pairs(uses), "pairs"))
        known = uses.select(F.col("block").alias("of"), "pair").join(rated, "pair")
        measures = known.groupBy("of").cogroup(blocks.select("block", "docs").groupBy("block")).applyInArrow(measure, MEASURES)
        measures = stored(measures, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.nullif("text", F.lit("")), 256)).alias("key"))
    columns = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in measures.columns[1:-1]]
    return rows.join(measures, "key", "left").select("doc_id", *columns, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
