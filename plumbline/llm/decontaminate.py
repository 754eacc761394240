"""Benchmark decontamination by BM25 and block-max WAND (operator 4).

Test items are the indexed side; every passage of every training document is a
query. A passage retrieves the items whose BM25 score reaches a share of the
score that the item gets against itself; a retrieved item counts if the passage
holds enough of its question's and its answer's word n-grams, or the answer's
words with few edits behind the question.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored


@dataclass(frozen=True)
class DecontaminationParams:
    #: Words of a passage beyond the longest item; passages overlap by the longest item's words, so that no copy is cut.
    stride: int = 128
    k1: float = 1.2
    b: float = 0.5
    #: Least score, as a share of the item's score against its own words.
    threshold: float = 0.7
    block: int = 32
    #: Word n-grams and the least share of them that a passage must hold.
    gram: int = 5
    question_share: float = 0.8
    answer_share: float = 0.8
    #: Else the answer's words must stand behind its question but for one of them, or for 1 - answer_share if that is more;
    #: answers of fewer words than this must be whole. Words may be put in or left out so far.
    edited_words: int = 3
    shift: int = 2
    #: Items of one index; a larger benchmark is cut into such indexes, which are gone through one after another.
    items_per_index: int = 20_000


WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased: marks between and around words are not part of them."""
    return " ".join(WORD.findall(text or "")).encode("utf-8", "replace").lower().split(b" ") if text and WORD.search(text) else []


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the answer is the last sentence or line, where there is more than one."""
    cut = re.split(r"(?<=[.!?])\s+|\n+", text.strip())
    cut = [c for c in cut if c.strip()]
    return (words_of(" ".join(cut[:-1])), words_of(cut[-1])) if len(cut) > 1 else (words_of(text), [])


def ngrams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def holds_share(grams: set[tuple[bytes, ...]], passage: list[bytes], share: float) -> bool:
    n = len(next(iter(grams), ()))
    return not grams or len(grams & {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}) >= share * len(grams)


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark: items, words of the longest and of the mean one, and items that hold a word (of an index's words)."""

    items: int
    longest: int
    mean: float
    frequency: dict[bytes, int]

    @staticmethod
    def of(bags: list[Counter]) -> Statistics:
        size = [b.total() for b in bags]
        return Statistics(len(bags), max(size, default=0), sum(size) / max(len(bags), 1), Counter(w for b in bags for w in b))


class Index:
    """Postings by item with the greatest impact of each block.

    Impacts are shares of the item's self score. Terms that many items hold are
    set apart as common, the most frequent first, as long as they make up at
    most half the threshold in every item: they alone never retrieve one. The
    other terms' impacts are divided by what their item needs beyond its common
    terms, so that 1 is the least sum of a candidate whatever the item; the full
    score decides.
    """

    def __init__(self, items: list[tuple[int, str]], params: DecontaminationParams, whole: Statistics | None = None):
        self.params = params
        self.ids = [i for i, _ in items]
        bags = [Counter(words_of(t)) for _, t in items]
        whole = whole or Statistics.of(bags)
        self.longest, mean, frequency = whole.longest, whole.mean, whole.frequency
        self.terms = {w: k for k, w in enumerate(sorted(frequency))}
        self.share: list[dict[bytes, float]] = []
        holders: dict[bytes, list[int]] = {}
        for k, bag in enumerate(bags):
            size = sum(bag.values())
            raw = {w: math.log(1 + (whole.items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (params.k1 + 1) / (n + params.k1 * (1 - params.b + params.b * size / mean)) for w, n in bag.items()}
            total = sum(raw.values())
            self.share.append({w: x / total for w, x in raw.items()})
            for w in bag:
                holders.setdefault(w, []).append(k)
        common = np.zeros(len(bags))
        rare = []
        for w in sorted(frequency, key=lambda w: (-frequency[w], w)):
            own = holders[w]
            with_it = common[own] + np.array([self.share[k][w] for k in own])
            if frequency[w] > 1 and with_it.max() <= params.threshold / 2:
                common[own] = with_it
            else:
                rare.append(w)
        size = params.block
        self.lists: dict[int, list[int]] = {}
        self.impacts: dict[int, list[float]] = {}
        self.block_last: dict[int, list[int]] = {}
        self.block_max: dict[int, list[float]] = {}
        self.most = np.zeros(len(self.terms) + 1)  # the last is the place of unknown words
        for w in rare:
            t, own = self.terms[w], holders[w]
            x = [self.share[k][w] / (params.threshold - common[k]) for k in own]
            self.lists[t], self.impacts[t] = own, x
            self.block_last[t] = [own[min(k + size, len(own)) - 1] for k in range(0, len(own), size)]
            self.block_max[t] = [max(x[k : k + size]) for k in range(0, len(own), size)]
            self.most[t] = max(x)
        self.parts = [parts(t) for _, t in items]
        self.grams = [tuple(ngrams(p, params.gram) for p in both) for both in self.parts]

    def search(self, terms: list[int]) -> list[int]:
        """Items whose rare terms among the query's reach 1, by block-max WAND.

        Lists stand sorted by their next item. The pivot is the first list at
        which the greatest impacts add up to 1: no earlier item can. The blocks
        that hold the pivot's item then give a closer bound; if that fails, all
        lists skip to the end of the nearest block.
        """
        size, lists = self.params.block, self.lists
        at = dict.fromkeys(terms, 0)
        out = []
        live = list(terms)
        while live:
            live.sort(key=lambda t: lists[t][at[t]])
            total, pivot = 0.0, -1
            for n, t in enumerate(live):
                total += self.most[t]
                if total >= 1 - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead = live[: pivot + 1]
            bound, nearest = 0.0, None
            for t in ahead:
                block = bisect_left(self.block_last[t], item, at[t] // size)
                if block < len(self.block_last[t]):
                    bound += self.block_max[t][block]
                    end = self.block_last[t][block]
                    nearest = end if nearest is None or end < nearest else nearest
            beyond = item + 1
            if bound >= 1 - 1e-9:
                score = 0.0
                for t in ahead:
                    k = bisect_left(lists[t], item, at[t])
                    if k < len(lists[t]) and lists[t][k] == item:
                        score += self.impacts[t][k]
                if score >= 1 - 1e-9:
                    out.append(item)
            else:
                beyond = max(beyond, (nearest or item) + 1)
                if pivot + 1 < len(live):  # lists behind the pivot join the sum at their next item
                    beyond = min(beyond, max(item + 1, lists[live[pivot + 1]][at[live[pivot + 1]]]))
            for t in ahead:
                at[t] = bisect_left(lists[t], beyond, at[t])
            live = [t for t in live if at[t] < len(lists[t])]
        return out

    def holds(self, item: int, passage: list[bytes]) -> bool:
        """Whether the passage holds enough n-grams of the item's question and of its answer."""
        p = self.params
        question, answer = self.grams[item]
        if not holds_share(question, passage, p.question_share):
            return False
        return holds_share(answer, passage, p.answer_share) or self.answers(item, passage)

    def answers(self, item: int, passage: list[bytes]) -> bool:
        """Whether the answer with few words edited stands behind what the passage holds of the question.

        An edit of one word takes up to `gram` n-grams with it, which is all of a short answer.
        """
        p = self.params
        question, answer = self.parts[item]
        if len(answer) < p.edited_words or not question:
            return False
        n = min(p.gram, len(question))
        at: dict[tuple[bytes, ...], list[int]] = {}
        for k in range(len(question) - n + 1):
            at.setdefault(tuple(question[k : k + n]), []).append(k)
        starts = {k + len(question) - q for k in range(len(passage) - n + 1) for q in at.get(tuple(passage[k : k + n]), ())}
        own = Counter(answer)
        least = len(answer) - max(1, int(len(answer) * (1 - p.answer_share) + 1e-9))
        return any((own & Counter(passage[max(k - p.shift, 0) : k + len(answer) + p.shift])).total() >= least for k in starts)

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """Items found in any passage of a document, with the best score."""
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        size = self.params.stride + self.longest
        start = np.arange(0, max(len(words) - self.longest, 1), self.params.stride)
        # repeats count again here, so this is an upper bound of what a passage's terms can add up to
        sums = np.concatenate([[0.0], np.cumsum(self.most[ids])])
        start = start[sums[np.minimum(start + size, len(words))] - sums[start] >= 1 - 1e-6]
        found: dict[int, float] = {}
        for a in start.tolist():
            own = np.unique(ids[a : a + size])
            most = self.most[own]
            if most.sum() < 1 - 1e-6:
                continue
            items = self.search(own[most > 0].tolist())
            if items:
                passage = words[a : a + size]
                held = set(passage)
                for item in items:
                    score = sum(x for w, x in self.share[item].items() if w in held)
                    if score >= self.params.threshold - 1e-9 and score > found.get(item, 0.0) and self.holds(item, passage):
                        found[item] = score
        return found


def indexes(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> Iterator[tuple]:
    """(items, statistics) of one index after another, broadcast, in order of (item_id, text).

    Counts are taken by Spark over the whole benchmark, so an item's score does
    not depend on the other items of its index. Each index brings at most
    items_per_index items, and the counts of their words, to the driver.
    """
    spark = docs.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in own], pa.int64()), pa.array([sorted(set(w)) for w in own], pa.list_(pa.binary()))], names=["item_id", "text", "size", "words"])

    items = benchmark.where("item_id is not null and length(trim(text)) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = stored(items.mapInArrow(words, "item_id long, text string, size long, words array<binary>"), "items")
    whole = items.agg(F.count("*").alias("items"), F.max("size").alias("longest"), F.avg("size").alias("mean")).first()
    if not whole["items"]:
        return
    frequency = stored(items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "frequency")
    last = None
    while True:
        behind = items if last is None else items.where((F.col("item_id") > last["item_id"]) | ((F.col("item_id") == last["item_id"]) & (F.col("text") > last["text"])))
        some = behind.orderBy("item_id", "text").limit(params.items_per_index)
        rows = some.select("item_id", "text").collect()
        if rows:
            own = some.select(F.explode("words").alias("word")).distinct().join(frequency, "word").collect()
            statistics = Statistics(whole["items"], whole["longest"], whole["mean"], {bytes(r["word"]): r["n"] for r in own})
            yield spark.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in rows], statistics))
        if len(rows) < params.items_per_index:
            return
        last = max(rows, key=lambda r: (r["item_id"], r["text"].encode("utf-8", "replace")))


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None) -> DataFrame:
    """(doc_id, item_id, score) of every benchmark item that a document holds.

    Items are read in order in groups of bounded size, one broadcast index each,
    so the benchmark may grow without any broadcast growing. Null or empty items
    and texts match nothing; null ids of documents are kept as they are;
    repeated rows give repeated results; without items there are no rows.
    """
    params = params or DecontaminationParams()
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, score double")
    for index in indexes(docs, benchmark, params):
        out = out.unionByName(rows.mapInArrow(search_with(index, params), "doc_id long, item_id long, score double"))
    return out


def search_with(index, params: DecontaminationParams):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(index.value[0], params, index.value[1])
        for batch in batches:
            docs, found, scores = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item, score in sorted(own.matches(words_of(text)).items()):
                    docs.append(doc)
                    found.append(own.ids[item])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "score"])

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Each row is judged by its own text where it is read, whatever its id, its
    other columns or their names; null and empty texts stay; repeated rows stay or
    go together; a text is searched whole, however long; without items, or
    without documents, nothing changes.
    """
    params = params or DecontaminationParams()
    arrow_rows(docs.sparkSession)

    def clean_of(index):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Index(index.value[0], params, index.value[1])
            for batch in batches:
                yield batch.filter(pa.array([not own.matches(words_of(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        return clean

    for index in indexes(docs, benchmark, params):
        docs = docs.mapInArrow(clean_of(index), docs.schema)
    return docs
