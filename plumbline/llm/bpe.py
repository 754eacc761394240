"""Byte-level BPE encoding and decoding by a segment tree of pair ranks (operator 7)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import arrow_rows

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE, as its public description gives it.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NONE = 1 << 62
#: Units of text kept with their ids in a worker, in each of two generations.
CACHE_UNITS = 400_000
#: Two blanks in a row; Python's blanks include all of the pre-tokenizer's.
BLANKS = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def check_kind(path: str, file: dict) -> None:
    """Refuses tokenizer files that work in another way than this module: their ids would differ."""
    split = file.get("pre_tokenizer") or {}
    wrong = [
        what
        for what, bad in (
            ("a model other than BPE", file["model"].get("type", "BPE") != "BPE"),
            ("a normalizer", file.get("normalizer") is not None),
            ("a pre-tokenizer other than ByteLevel with its own pattern", split.get("type") != "ByteLevel" or not split.get("use_regex", True)),
            ("a prefix space", bool(split.get("add_prefix_space"))),
            ("merges with dropout, affixes or byte fallback", any(file["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} has {', '.join(wrong)}")


class Vocabulary:
    """Merges, ids and bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check_kind(path, file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {as_bytes(token): i for token, i in file["model"]["vocab"].items()}
        self.bytes_of = {i: token for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.letter = [ids.get(bytes([b])) for b in range(256)]
        #: pair of ids (a << 32 | b) to rank; rank to the merged id
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, m in enumerate(file["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank.setdefault(ids[a] << 32 | ids[b], k)
            self.merged.append(ids[a + b])
        self.letters = np.array([-1 if i is None else i for i in self.letter], np.int64)
        self.merged_ids = np.array(self.merged, np.int64)
        top = max(self.bytes_of) + 1
        self.pool = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.pool_size = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.pool_start = np.cumsum(self.pool_size) - self.pool_size
        self.build_table()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


    def build_table(self) -> None:
        """Open addressing over all pairs, so that many pairs can be looked up at once."""
        keys, values = np.array(list(self.rank), np.int64), np.array(list(self.rank.values()), np.int64)
        self.slots = 1 << (4 * len(keys)).bit_length()
        self.table = np.full(self.slots, -1, np.int64)
        self.found = np.full(self.slots + 1, NONE, np.int64)
        left, at, self.probes = np.arange(len(keys)), self.slot(keys), 0
        while len(left):
            self.probes += 1
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = keys[free]
            mine = free[self.table[at[free]] == keys[free]]
            self.found[at[mine]] = values[mine]
            left = left[self.table[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % self.slots

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where they do not merge, or either is -1."""
        keys = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        shape, keys = keys.shape, keys.ravel()
        at = self.slot(keys)
        held = self.table[at]
        out = np.where(held == keys, self.found[at], NONE)
        left = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) % self.slots
            held = self.table[at]
            hit = held == keys[left]
            out[left[hit]] = self.found[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], at[on]
        return out.reshape(shape)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_word(word: bytes, v: Vocabulary) -> list[int]:
    """The ids of one word.

    The leaves of a segment tree hold the rank of each pair of neighbours,
    shifted to make room for its place, so that the root is the leftmost pair of
    lowest rank. A merge changes three leaves at most and their ancestors.
    """
    ids = [v.letter[b] for b in word]
    n = len(ids)
    if n == 1:
        return ids
    get = v.rank.get
    shift = n.bit_length()
    low = (1 << shift) - 1
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    a = ids[0]
    for k in range(1, n):
        b = ids[k]
        r = get(a << 32 | b)
        if r is not None:
            tree[size + k - 1] = r << shift | (k - 1)
        a = b
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    root = tree[1]
    if root == NONE:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while root != NONE:
        k = root & low
        gone = after[k]
        after[k] = nxt = after[gone]
        ids[k] = here = v.merged[root >> shift]
        ids[gone] = -1
        changed = []
        if nxt < n:
            before[nxt] = k
            r = get(here << 32 | ids[nxt])
            changed.append((k, NONE if r is None else r << shift | k))
            changed.append((gone, NONE))
        else:
            changed.append((k, NONE))
        prev = before[k]
        if prev >= 0:
            r = get(ids[prev] << 32 | here)
            changed.append((prev, NONE if r is None else r << shift | prev))
        for leaf, value in changed:
            p = size + leaf
            if tree[p] == value:
                continue
            tree[p] = value
            while p > 1:
                other = tree[p ^ 1]
                if other < value:
                    value = other
                p >>= 1
                if tree[p] == value:
                    break
                tree[p] = value
        root = tree[1]
    return [i for i in ids if i >= 0]


def merge_many(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Packed ids of many words: the same segment trees, one row each, advanced together.

    Words are sorted into classes of tree size; in each step every row that has
    a mergeable pair left takes its root and updates three leaves and their
    ancestors. Words of more than 64 pairs go through merge_word().
    """
    out: list[bytes] = [b""] * len(words)
    classes: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) > 65:
            out[k] = np.array(merge_word(w, v), "<u4").tobytes()
        else:
            classes.setdefault(1 << max(len(w) - 2, 0).bit_length() if len(w) > 2 else 1, []).append(k)
    for size, rows in classes.items():
        step = 400_000 // size  # the trees of one step take some 20 MB, whatever their size
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            for k, packed in zip(some, merge_class([words[k] for k in some], size, v), strict=True):
                out[k] = packed
    return out


def merge_class(words: list[bytes], size: int, v: Vocabulary) -> list[bytes]:
    count, width = len(words), size + 2
    length = np.fromiter(map(len, words), np.int64, count)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
    place = np.arange(width)
    ids = np.where(place < length[:, None], v.letters[raw], -1)
    after = np.tile(place + 1, (count, 1)).ravel()
    before = np.tile(place - 1, (count, 1)).ravel()
    shift, low = 7, 127
    tree = np.full((count, 2 * size), NONE, np.int64)
    rank = v.ranks(ids[:, :size], ids[:, 1 : size + 1])
    tree[:, size:] = np.where(rank < NONE, rank << shift | place[:size], NONE)
    for level in range(size.bit_length() - 2, -1, -1):
        first = 1 << level
        tree[:, first : 2 * first] = np.minimum(tree[:, 2 * first : 4 * first : 2], tree[:, 2 * first + 1 : 4 * first : 2])
    tree, ids = tree.ravel(), ids.ravel()
    row = np.flatnonzero(tree[1 :: 2 * size] < NONE) if size > 0 else np.zeros(0, np.int64)
    while len(row):
        base, top = row * width, row * (2 * size)
        root = tree[top + 1]
        k = root & low
        gone = after[base + k]
        nxt = after[base + gone]
        here = v.merged_ids[root >> shift]
        after[base + k] = nxt
        ids[base + k] = here
        ids[base + gone] = -1
        bound = np.minimum(nxt, width - 1)
        before[base + bound] = k
        prev = before[base + k]
        right = v.ranks(here, np.where(nxt < length[row], ids[base + bound], -1))
        left = v.ranks(np.where(prev >= 0, ids[base + np.maximum(prev, 0)], -1), here)
        last = size - 1
        # a place past the last leaf, or before the first, rewrites a neighbour's leaf with its own value
        changed = np.concatenate([np.minimum(gone, last), np.minimum(k, last), np.where(prev >= 0, prev, np.minimum(k, last))])
        right = np.where(right < NONE, right << shift | k, NONE)
        value = np.concatenate([np.where(gone <= last, NONE, right), right, np.where(prev >= 0, np.where(left < NONE, left << shift | prev, NONE), right)])
        value[: len(row)] = np.where(np.minimum(gone, last) == k, right, value[: len(row)])
        tops = np.concatenate([top, top, top])
        p = changed + size
        tree[tops + p] = value
        while size > 1 and p[0] > 1:
            p = p >> 1
            tree[tops + p] = np.minimum(tree[tops + 2 * p], tree[tops + 2 * p + 1])
        row = row[tree[top + 1] < NONE]
    ids = ids.reshape(count, width)
    alive = ids >= 0
    packed = ids[alive].astype("<u4").tobytes()
    ends = (np.cumsum(alive.sum(1)) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Known:
    """Values by key in two generations: when the young one is full it becomes the old, and what is used again moves back."""

    def __init__(self, make_many, most: int = CACHE_UNITS):
        self.make_many, self.most = make_many, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all_of(self, keys: set[str]) -> dict[str, bytes]:
        """A dictionary that holds every one of the keys."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        old, new = self.old, []
        for k in keys.difference(self.young):
            if k in old:
                self.young[k] = old[k]
            else:
                new.append(k)
        self.young.update(zip(new, self.make_many(new), strict=True))
        return self.young


#: Marks that end a word: after a letter or digit they are a word of their own for the pre-tokenizer.
ENDS = ".,;:!?"


def strings(x: pa.Array) -> list[str]:
    """The strings of an array without nulls, many times faster than Arrow's own list."""
    return x.to_numpy(zero_copy_only=False).tolist()


class Units:
    """Units of text and their packed ids.

    Blanks between two other characters begin a new word of the pre-tokenizer,
    so where no two blanks meet, a text can be cut at its spaces, and the pieces
    (with their leading space) encoded apart, each only once. A piece's closing
    marks are cut off as well.
    """

    def __init__(self, encode_many, encode_whole, most: int = CACHE_UNITS):
        self.encode_many, self.encode_whole = encode_many, encode_whole
        self.stems = Known(lambda stems: encode_many([" " + x for x in stems]), most)
        self.marks = Known(encode_many, 10_000)

    def batch(self, texts: list[str], special: tuple[str, ...]) -> tuple[pa.Array, np.ndarray]:
        """Packed ids of all units of the texts, in order, and how many units each text has.

        Arrow cuts the texts, numbers their distinct pieces, and lays the units
        out; Python sees each distinct stem of the batch once.
        """
        odd = [k for k, t in enumerate(texts) if not t or BLANKS.search(t) or any(s in t for s in special)]
        even = np.ones(len(texts), bool)
        even[odd] = False
        cut = pc.split_pattern(pa.array([texts[k] for k in np.flatnonzero(even).tolist()], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        numbered = cut.flatten().dictionary_encode()
        pieces, at = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        trimmed = pc.utf8_rtrim(pieces, ENDS)
        fits = pc.and_(pc.match_substring_regex(trimmed, r"[\pL\pN]$"), pc.not_equal(pieces, trimmed))
        stems = pc.if_else(fits, trimmed, pieces).dictionary_encode()
        marked = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        names = strings(stems.dictionary)
        known = self.stems.all_of(set(names))
        marks = [p[len(x) :] for p, x in zip(strings(pieces.take(pa.array(marked))), strings(trimmed.take(pa.array(marked))), strict=True)]
        kinds = {m: k for k, m in enumerate(dict.fromkeys(marks), 1)}
        of_mark = self.marks.all_of(set(kinds))
        # a text's first piece has no space before it: these are encoded as they are, and stand behind the stems
        first = np.unique(at[ends[:-1]])
        packed = [known[x] for x in names]
        base = len(packed)
        packed += [b"", *(of_mark[m] for m in kinds)]
        whole_piece = len(packed)
        packed += self.encode_many(strings(pieces.take(pa.array(first))))
        whole_text = len(packed)
        packed += [self.encode_whole(texts[k]) for k in odd]
        stem_at = stems.indices.to_numpy().astype(np.int64)
        mark_at = np.full(len(pieces), base, np.int64)
        mark_at[marked] = base + np.array([kinds[m] for m in marks], np.int64)
        # two units a piece, its stem and its mark
        order = np.stack([stem_at[at], mark_at[at]], 1)
        order[ends[:-1]] = np.stack([whole_piece + np.searchsorted(first, at[ends[:-1]]), np.full(len(ends) - 1, base)], 1)
        count = np.full(len(texts), 2, np.int64)
        count[even] = 2 * np.diff(ends)
        units = np.full(int(count.sum()), base, np.int64)
        is_odd = np.repeat(~even, count)
        units[~is_odd] = order.ravel()
        units[is_odd] = np.stack([whole_text + np.arange(len(odd)), np.full(len(odd), base)], 1).ravel()
        return pa.array(packed, pa.large_binary()).take(pa.array(units)), count

    def ids(self, texts: list[str], special: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        units, count = self.batch(texts, special)
        ends = units.offsets.to_numpy() if hasattr(units, "offsets") else np.frombuffer(units.buffers()[1], np.int64, len(units) + 1, 8 * units.offset)
        flat = np.frombuffer(units.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4") if ends[-1] > ends[0] else np.zeros(0, "<u4")
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(count)])]) // 4


def grouped(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a bounded size, so that more of their units are the same."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Encoder:
    """Encodes texts as the tokenizer file says, in one worker."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        # a unit is mostly one word, so the words of units that were seen are hardly asked for again
        self.words = Known(lambda words: merge_many([w.encode("utf-8", "replace") for w in words], self.v), 25_000)
        self.units = Units(self.many, self.whole, 50_000)

    def many(self, units: list[str]) -> list[bytes]:
        split = [WORDS.findall(u) for u in units]
        get = self.words.all_of(set().union(*split)).__getitem__
        return [b"".join(map(get, s)) for s in split]

    def whole(self, text: str) -> bytes:
        v = self.v
        pieces = v.split.split(text) if v.split else [text]
        packed = iter(self.many([p for p in pieces if p not in v.special]))
        return b"".join(v.special[p].to_bytes(4, "little") if p in v.special else next(packed) for p in pieces)

    def batch(self, texts: list[str]) -> list[bytes]:
        ids, size = self.units.ids(texts, tuple(self.v.special))
        packed, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode(packed: bytes, v: Vocabulary) -> str:
    """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    size = v.pool_size[ids]
    total = int(size.sum())
    start = np.cumsum(size) - size
    at = np.repeat(v.pool_start[ids] - start, size) + np.arange(total)
    return v.pool[at].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of docs and `ids`, the token ids as packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids. The path of the tokenizer file must be
    readable on the executors.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in grouped(batches, 2 << 20):
            ids = encoder.batch([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    plain = docs.drop("ids")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("ids", BinaryType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, both made from the encoded ids.

    A null text counts as empty; repeated rows and null ids give one row each.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = Encoder(path), vocabulary(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in grouped(batches, 2 << 20):
            rows = encoder.batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([sha(r) for r in rows], pa.string()), pa.array([sha(decode(r, v).encode()) for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    # encoded and decoded by one worker, so that a task has a single copy of the vocabulary
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
