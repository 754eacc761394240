"""Exact Jaccard join of word shingles (operator 10).

1. Every document becomes a sorted array of 64-bit shingle hashes. Documents
   with the same set (exact copies) collapse to one representative first.
2. Sizes fall into bands so narrow that linked sets lie in the same or the next
   band. For a band with largest set u, linked sets differ in at most
   d = floor((1 - t) / (1 + t) * 2u) shingles, so if the hash space is dealt
   into more than d parts, linked sets agree in a whole part. A (band, part,
   content of the part) key is a tile; candidates meet only in a shared tile.
   Sets with enough parts that are not empty have no tiles of empty ones.
3. In a tile, sets are held against the tile's smallest member first; what is
   connected by those links needs no other comparison. In tiles whose members
   still lie in different components, all members outside the largest of these
   are held against all others, block by block, by hashed bitmaps: bit counts
   bound the overlap from above, and where they allow a link the sets
   themselves meet in the block and give the links that join its components.

No link between different sets is lost, copies are never expanded into pairs,
and no bucket has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, PART_BITS, SALTS, Tables, arrow_rows, connected_components, filter_bit, filter_parts, left_by, marked, maybe_in, stored

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 80
    bitmap_bits: int = 2048
    #: Members of one block of a tile that is compared pair by pair.
    block: int = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words end at ASCII white space."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        out = mixed(out * MIX + h[k : k + len(out)])
    return np.unique(out)


def bands(percent: int, longest: int) -> np.ndarray:
    """First sizes of the bands: the ratio of a band's ends is at most percent / 100."""
    starts = [1]
    while starts[-1] <= longest:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


#: More parts than a linked pair can differ in, so that a set may have a few empty ones.
SPARE = Fraction(21, 20)


def differing(n: int, m: int, percent: int) -> int:
    """The most shingles that linked sets of at most n and m shingles can differ in."""
    t = Fraction(percent, 100)
    return int((1 - t) / (1 + t) * (n + m))


def parts_of(band: int, starts: np.ndarray, percent: int) -> int:
    """More parts than two linked sets of the band can differ in."""
    largest = int(starts[band + 1]) - 1
    return int((differing(largest, largest, percent) + 1) * SPARE) + 1


def tile_keys(s: np.ndarray, starts: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's tiles: those of its own band, and of the next, where it may be the smaller side.

    Very many sets share an empty part. Where a set has more parts that are not
    empty than it can differ in from any linked set, one of these is whole, so
    its empty parts are no tiles. Of two linked sets one such is enough, since
    both have the tiles of what is not empty.
    """
    own = int(np.searchsorted(starts, len(s), "right")) - 1
    out = []
    scrambled = mixed(s ^ MIX)
    for band in (own, own + 1):
        parts = parts_of(band, starts, percent)
        with np.errstate(over="ignore"):
            content = np.zeros(parts, np.uint64)
            place = (s % np.uint64(parts)).astype(np.int64)
            np.add.at(content, place, scrambled)
            label = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
            keys = mixed(mixed(content + MIX) + label * MIX)
        held = np.bincount(place, minlength=parts) > 0
        partner = min(int(starts[band + 1]) - 1, len(s) * 100 // percent)
        out.append(keys[held] if int(held.sum()) > differing(len(s), max(partner, len(s)), percent) else keys)
    return np.concatenate(out)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(mixed(s) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of linked sets of sizes n and m."""
    return -(-(percent * (n + m)) // (100 + percent))


def longest_possible(docs: DataFrame) -> int:
    """An upper bound of a text's words: words and blanks alternate, so half its bytes rounded up."""
    n = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    return n // 2 + 1


#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1


def source_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """id, text_hash, text: a document is known by its id and a hash of its text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")


def jaccard_rows(docs: DataFrame, params: JaccardParams | None = None, id_col: str = "doc_id") -> DataFrame:
    """A row for each of docs: id, text_hash, n (shingles), keep (id and text_hash of the first document of its group)."""
    params = params or JaccardParams()
    arrow_rows(docs.sparkSession)
    percent, words, width = params.percent, params.words, params.bitmap_bits
    starts = bands(percent, longest_possible(docs) + 1)
    starts = np.append(starts, [starts[-1] * 100 // percent + 1, (starts[-1] * 100 // percent + 1) * 100 // percent + 1])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, keys, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                keys.append(tile_keys(s, starts, percent).view(np.int64) if len(s) else np.zeros(0, np.int64))
                bits.append(bitmap(s, width).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["id", "text_hash", "n", "node", "keys", "bits"],
            )

    source = source_rows(docs, id_col)
    with Tables(docs.sparkSession) as t:
        signed = t.stored(source.mapInArrow(sign, "id long, text_hash long, n long, node long, keys array<long>, bits binary"), "signed")
        usable = signed.where("node is not null")
        nodes = t.stored(usable.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("head"), F.count("*").alias("many")), "nodes")
        tiles = tiles_of(usable, nodes, t)
        ends = tiles.groupBy("key").agg(F.min("node").alias("first"))
        star = t.stored(tiles.join(ends, "key").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        own = filter_parts(tiles, "node")
        bits = t.stored(maybe_in(usable.select("node", "n", "bits"), own, "node").dropDuplicates(["node"]), "bits")
        # most sets are linked to their least candidate, which makes nearly all other pairs of them needless
        least = t.stored(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
        links = t.stored(verified(least, bits, nodes, source, params, t), "links")
        found = connected_components(links, store=t.stored)
        apart = t.stored(across(star.join(least, ["a", "b"], "left_anti"), found), "pairs")
        for others in (lambda: verified(apart, bits, nodes, source, params, t), lambda: joining(t.stored(unresolved(tiles, found, bits, params, t), "near"), nodes, source, params)):
            more = t.stored(others(), "links")
            if not more.isEmpty():
                links = links.unionByName(more)
                found = connected_components(links, store=t.stored)

        # what is neither a copy nor linked is its own group
        grouped = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").where("many > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
        grouped = t.stored(grouped, "grouped")
        first = grouped.groupBy("component").agg(F.min("head").alias("keep")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        decided = grouped.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(first, ["component", "salt"]).select("node", "many", "keep")
        rows = left_by(signed.select("id", "text_hash", "n", "node"), t.stored(decided, "decided"), ["node"], "many", signed.count())
        return stored(rows.select("id", "text_hash", "n", F.coalesce("keep", F.struct("id", "text_hash")).alias("keep")), "groups")


def jaccard_groups(docs: DataFrame, params: JaccardParams | None = None, id_col: str = "doc_id") -> DataFrame:
    """Every document's shingle count and group: (id, n_shingles, component_id).

    component_id is the smallest id reachable over links. An empty or null text
    has no shingles and links with nothing, not even another empty text. A null
    id stands behind all others: its row has the smallest id of its group, or
    null where the group has none. An id with several texts is several documents
    that happen to have the same id; rows that repeat an id and its text give
    one row each.
    """
    named = lambda c: F.when(c != NO_ID, c)
    return jaccard_rows(docs, params, id_col).select(named(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), named(F.col("keep.id")).alias("component_id"))


def node_of(s: np.ndarray) -> int:
    """The 64-bit fingerprint of a set, by which equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def tiles_of(usable: DataFrame, nodes: DataFrame, t: Tables) -> DataFrame:
    """(key, node) of all tiles with more than one set, a stored table.

    Copies leave first: which rows are copies is settled on ids alone, so keys
    are not shuffled for it but for the few rows that a filter mistakes for one.
    """
    heads = nodes.where("many > 1").select("node", "head", "many")
    rows = maybe_in(usable.select("id", "text_hash", "node"), filter_parts(heads, "node"), "node")
    copies = t.stored(left_by(rows, heads, ["node"], "many", rows.count()).where("head IS NOT NULL AND NOT (id = head.id AND text_hash = head.text_hash)").select("id", "text_hash").distinct(), "copies")
    name = ["id", "text_hash"]
    keyed = marked(usable.select(*name, "node", "keys"), filter_parts(copies, *name), *name)
    mistaken = t.stored(keyed.where("maybe__").select(*name).distinct().join(copies, name, "left_anti"), "mistaken")
    late = maybe_in(keyed.where("maybe__").drop("maybe__"), filter_parts(mistaken, *name), *name).join(mistaken, name, "left_semi")
    tiled = keyed.where("NOT maybe__").select("node", "keys").unionByName(late.select("node", "keys")).select("node", F.explode("keys").alias("key"))
    # sets are distinct by now, so a key that comes twice is shared
    shared = t.stored(tiled.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    return t.stored(maybe_in(tiled, filter_parts(shared, "key"), "key").distinct().join(shared, "key").select("key", "node"), "tiles")


def marked_ids(ids: DataFrame) -> np.ndarray:
    """The membership filter of (id, text_hash) as one array of bits, of fixed size."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in filter_parts(ids, "id", "text_hash").collect():
        at = int(r["part"]) * PART_BITS // 8
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def with_sets(source: DataFrame, wanted: np.ndarray, params: JaccardParams) -> DataFrame:
    """(node, s) of the documents that pass the filter.

    The filter passes every document that is asked for, and a few others, whose
    sets are never used; so texts are not shuffled to find them.
    """
    words = params.words
    shared = source.sparkSession.sparkContext.broadcast(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            hit = (shared.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
            sets = [shingles(x, words) for x in batch.column("text").filter(pa.array(hit)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "s"])

    return source.select("text", filter_bit("id", "text_hash").alias("h")).mapInArrow(build, "node long, s binary")


def verified(pairs: DataFrame, bits: DataFrame, nodes: DataFrame, source: DataFrame, params: JaccardParams, t: Tables) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: bit counts first, exact intersection after."""
    percent = params.percent
    side = lambda table, x, *columns: table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            if not len(n_a):
                continue
            x, y = (np.stack([np.frombuffer(v, np.uint8) for v in batch.column(c).to_pylist()]) for c in ("bits_a", "bits_b"))
            # each shingle of a that b lacks leaves its bit, or shares it with another of a
            common = np.bitwise_count(x & y).sum(1, dtype=np.int64)
            most = np.minimum(n_a - np.bitwise_count(x).sum(1, dtype=np.int64), n_b - np.bitwise_count(y).sum(1, dtype=np.int64)) + common
            may = pa.array(most >= needed(n_a, n_b, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(may), batch.column("b").filter(may)], names=["a", "b"])

    def exact(group: pd.DataFrame) -> pd.DataFrame:
        lead = np.frombuffer(group[group["lead"]]["s"].iloc[0], np.uint64)
        own = group[~group["lead"]]
        own = own[[linked(lead, np.frombuffer(s, np.uint64), percent) for s in own["s"]]]
        return pd.DataFrame({"a": own["a"], "b": own["node"]})

    # the bitmaps, of fixed size, meet first; the sets only of pairs that they allow
    near = pairs.join(side(bits, "a", "n", "bits"), "a").join(side(bits, "b", "n", "bits"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    allowed = t.stored(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bound, "a long, b long"), "allowed")
    # a set goes once to each part of the pairs that it is in: a's set, and block of its partners' sets at most on average
    parts = allowed.groupBy("a").agg(F.ceil(F.count("*") / params.block).cast("int").alias("parts"))
    dealt = t.stored(allowed.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")), "dealt")
    roles = dealt.select(F.col("b").alias("node"), "a", "part", F.lit(False).alias("lead")).unionByName(dealt.select(F.col("a").alias("node"), "a", "part", F.lit(True).alias("lead")).distinct())
    wanted = marked_ids(nodes.join(roles.select("node").distinct(), "node").select("head.*"))
    return with_sets(source, wanted, params).join(roles, "node").groupBy("a", "part").applyInPandas(exact, "a long, b long").distinct()


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are in different components."""
    own = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    met = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return met.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def unresolved(tiles: DataFrame, found: DataFrame, bits: DataFrame, params: JaccardParams, t: Tables) -> DataFrame:
    """The sets that have a candidate of another component in a block of a tile that the first links leave divided: key, i, j, node, query, n, component.

    Of a pair across components at most one lies in the tile's largest component,
    so the members outside it are the queries and all members are searched. Both
    are cut into blocks, and a block of queries with a block of members is one
    group of bounded size. Tiles with the same members count once. A row is given for a
    set and block, not for a pair, so there are no more rows than were searched.
    """
    percent, block = params.percent, params.block
    placed = tiles.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    divided = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("largest"), F.sum("who").alias("who")).where("components > 1 AND size > 2")
    once = divided.groupBy("who", "size").agg(F.min(F.struct("key", "largest")).alias("x")).select("x.key", F.col("x.largest.component").alias("largest"), F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("x.largest.n")) / block).cast("int").alias("asked"))
    once = t.stored(once, "divided")
    inside = t.stored(placed.join(once, "key"), "divided")
    part = lambda n, seed: F.pmod(F.xxhash64("node", "key", F.lit(seed)), F.col(n)).cast("int")
    members = inside.select("key", "node", "component", F.lit(False).alias("query"), part("blocks", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"))
    queries = inside.where("component <> largest").select("key", "node", "component", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), part("asked", 2).alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ask, own = group[group["query"]], group[~group["query"]].sort_values(["n", "node"])
        stack = lambda g: np.stack([np.frombuffer(v, np.uint8) for v in g["bits"]]).view(np.uint64) if len(g) else np.zeros((0, 1), np.uint64)
        bits, n, component = stack(own), own["n"].to_numpy(), own["component"].to_numpy()
        spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        met, asked = np.zeros(len(own), bool), np.zeros(len(ask), bool)
        for at, (x, size, group_of) in enumerate(zip(stack(ask), ask["n"].to_numpy(), ask["component"].to_numpy(), strict=True)):
            near = slice(int(np.searchsorted(n, -(-size * percent // 100))), int(np.searchsorted(n, size * 100 // percent, "right")))
            bound = np.bitwise_count(bits[near] & x).sum(1, dtype=np.int64) + np.minimum(size - int(np.bitwise_count(x).sum()), spare[near])
            hit = (bound >= needed(size, n[near], percent)) & (component[near] != group_of)
            met[near] |= hit
            asked[at] = hit.any()
        return pd.concat([own[met], ask[asked]])[["key", "i", "j", "node", "query", "n", "component"]]

    # a task compares some hundred pairs of blocks, however few bytes these have
    tasks = (once.agg(F.sum(F.col("blocks").cast("long") * F.col("asked"))).first()[0] or 0) // 512 + int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = members.unionByName(queries).join(bits, "node").repartition(tasks, "key", "i", "j").groupBy("key", "i", "j")
    return met.applyInPandas(compare, "key long, i int, j int, node long, query boolean, n long, component long")


#: Shingles of the sets that are held against each other in one group, about.
GROUP_SHINGLES = 1 << 20


def joining(near: DataFrame, nodes: DataFrame, source: DataFrame, params: JaccardParams) -> DataFrame:
    """Links (a, b) that join the components of each block of unresolved() as far as its sets are linked.

    The exact intersections are counted where the sets meet, and a link between
    sets that other links already join is left out: a block gives fewer links
    than it has sets, however many of its pairs are linked, or nearly are.
    """
    percent, width = params.percent, params.bitmap_bits
    heavy = near.groupBy("key", "i", "j").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("parts"))
    dealt = near.join(heavy, ["key", "i", "j"]).withColumns({"own": F.pmod(F.xxhash64("node"), "parts").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    dealt = dealt.select("key", "i", "j", F.expr("IF(query, other, own)").alias("u"), F.expr("IF(query, own, other)").alias("v"), "node", "query", "component")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["node", "query"])
        group = group.assign(s=[np.frombuffer(v, np.uint64) for v in group["s"]])
        ask, own = group[group["query"]], group[~group["query"]]
        sets, node = own["s"].tolist(), own["node"].to_numpy()
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        stack = lambda g: np.stack([bitmap(s, width) for s in g]).view(np.uint64)
        a, b = [], []
        if len(own) and len(ask):
            bits, label, joined = stack(sets), own["component"].to_numpy().copy(), {}
            spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
            for s, x, this, mine in zip(ask["s"], stack(ask["s"]), ask["node"], ask["component"], strict=True):
                while mine in joined:
                    mine = joined[mine]
                bound = np.bitwise_count(bits & x).sum(1, dtype=np.int64) + np.minimum(len(s) - int(np.bitwise_count(x).sum()), spare)
                at = np.flatnonzero((100 * np.minimum(n, len(s)) >= percent * np.maximum(n, len(s))) & (bound >= needed(len(s), n, percent)) & (label != mine))
                if not len(at):
                    continue
                flat = np.concatenate([sets[k] for k in at])
                common = np.add.reduceat(s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat, np.cumsum(n[at]) - n[at], dtype=np.int64)
                for k in at[common >= needed(len(s), n[at], percent)]:
                    if label[k] != mine:
                        a.append(this)
                        b.append(node[k])
                        joined[int(label[k])] = mine
                        label[label == label[k]] = mine
        return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    wanted = marked_ids(nodes.join(near.select("node").distinct(), "node").select("head.*"))
    met = with_sets(source, wanted, params).dropDuplicates(["node"]).join(dealt, "node")
    return met.groupBy("key", "i", "j", "u", "v").applyInPandas(settle, "a long, b long").distinct()


def keep_one(docs: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """Of each group the document with the smallest id (and text hash); documents without words all stay.

    A null id stands behind all others, so a copy without id goes. Rows that
    repeat an id and its text are one document and stay or go together.
    """
    gone = jaccard_rows(docs, params).where("id <> keep.id OR text_hash <> keep.text_hash").select("id", "text_hash").distinct()
    rows = docs.withColumns({"id__": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "hash__": F.coalesce(F.xxhash64("text"), F.lit(0))})
    gone = gone.select(F.col("id").alias("id__"), F.col("text_hash").alias("hash__"))
    rows = marked(rows, filter_parts(gone, "id__", "hash__"), "id__", "hash__")
    unsure = rows.where("maybe__").join(gone, ["id__", "hash__"], "left_anti")
    return rows.where("NOT maybe__").select(docs.columns).unionByName(unsure.select(docs.columns))
