"""N-gram Jaccard join: a MinHash LSH forest proposes, word shingles decide.

Each text's shingle set has a signature of DEPTH minima in each of TREES trees. A tree is a trie of its signatures: a node at depth d stands for
all that share a prefix of d minima. The prefixes that must match begin at DEPTH minima in every tree and are shortened, one
minimum in one tree at a time, until a pair at the threshold meets in some tree with the target probability; the next to be
shortened is the tree in which that costs the fewest pairs to compare for what it gains, by the sizes of its trie's nodes (of all texts). Texts
with equal shingle sets (by a 128-bit hash) are one class from the start and meet others through one text.

The classes that share a prefix gather in a block named after the least of them in that tree, so two that share any prefix
share a block. A block is compared as a whole, in tiles of bounded size, and gives back a number of links for each member and
a tree that spans what is linked: rows grow with members, never with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_bytes, coded, filled, hash_strings, materialise, mix, numbered, row_of, split_words, table, unique_name

SHINGLE, THRESHOLD, TARGET = 5, 0.8, 0.9999
#: Bytes of a minimum in a signature.
TREES, DEPTH, WIDE = 32, 10, 2
#: A tile has about so many members or bytes of text from either side at most.
TILE, TILE_BYTES = 512, 4 << 20
#: Numbers of tiles, ids of classes, shared prefixes and texts to compare are broadcast up to so many (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def miss(threshold: float, depths: list[int]) -> float:
    """The probability that a pair at the threshold shares no prefix of the depths given."""
    return math.exp(sum(math.log1p(-(threshold**d)) for d in depths))


def least_depth(threshold: float, trees: int, target: float) -> int:
    """A prefix length that reaches the target if all trees have it; no tree's prefix gets shorter."""
    length = DEPTH
    while length > 1 and 1 - miss(threshold, [length] * trees) < target:
        length -= 1
    return max(1, length - 1)


def shortened(pairs: dict[tuple[int, int], float], threshold: float, trees: int, target: float) -> list[int]:
    """The prefix length of each tree. pairs: how many pairs share a prefix, by (tree, depth)."""
    least, depths = least_depth(threshold, trees, target), [DEPTH] * trees

    def price(t: int) -> tuple[float, int]:
        d = depths[t]
        gain = math.log1p(-(threshold**d)) - math.log1p(-(threshold ** (d - 1)))
        return (1 + pairs.get((t, d - 1), 0.0) - pairs.get((t, d), 0.0)) / gain, t

    while 1 - miss(threshold, depths) < target and (open_trees := [t for t in range(trees) if depths[t] > least]):
        depths[min(map(price, open_trees))[1]] -= 1
    return depths


def shingle_hashes(offsets: np.ndarray, codes: np.ndarray, names: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's shingles begin, and the 64-bit hashes of all: n words, or all of a shorter text's; of a text without words none."""
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if not starts[-1]:
        return starts, np.zeros(0, np.uint64)
    word = hash_strings(names)[codes]
    row = row_of(starts)
    first = offsets[row] + np.arange(starts[-1]) - starts[row]
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = first + k
            inside = at < offsets[row + 1]
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at, len(word) - 1)], np.uint64(0)) + np.uint64(k + 1))
    return starts, out


def distinct_per_row(starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted, once each."""
    row = row_of(starts)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.searchsorted(r[new], np.arange(len(starts))), h[new]


def signatures(starts: np.ndarray, hashes: np.ndarray, trees: int, depth: int = DEPTH) -> np.ndarray:
    """[row, tree, depth]: 16 bits of each minimum; rows without shingles have 0."""
    rng = np.random.default_rng(20240229)
    full = np.flatnonzero(np.diff(starts) > 0)
    out = np.zeros((len(starts) - 1, trees, depth), ">u2")
    if not len(full):
        return out
    at = starts[:-1][full]
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    value = np.empty_like(low)
    with np.errstate(over="ignore"):
        for t in range(trees):
            for d in range(depth):
                a, b = (np.uint32(x | 1) for x in rng.integers(0, 2**32, 2, np.uint64))
                np.multiply(low, a, out=value)
                value ^= high
                value *= b
                least = np.minimum.reduceat(value, at)
                out[full, t, d] = least ^ (least >> np.uint32(16))
    return out


def sign(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, th (the text's hash), set_hash (128 bits of the shingle set), n_bytes and sig (WIDE * DEPTH bytes for each tree; null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = filled(part.column("text"))
                offsets, words = split_words(texts)
                codes, names = coded(words)
                starts, hashes = distinct_per_row(*shingle_hashes(offsets, codes, names))
                sig = signatures(starts, hashes, trees)
                with np.errstate(over="ignore"):
                    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
                    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)])
                    both = np.column_stack([one[starts[1:]] - one[starts[:-1]], two[starts[1:]] - two[starts[:-1]]])
                some = np.diff(starts) > 0
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([x.tobytes() for x in both], pa.binary()), size, pa.array([x.tobytes() if s else None for x, s in zip(sig, some, strict=True)], pa.binary())], ["doc_id", "th", "set_hash", "n_bytes", "sig"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, set_hash binary, n_bytes long, sig binary")


def blocks_of(classes: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """node, blocks: the blocks of each class (node, sig) that shares a prefix with another in some tree."""
    least, size = least_depth(threshold, trees, target), WIDE * DEPTH
    prefix = lambda d: F.xxhash64("tree", F.expr(f"substring(sig, 1, {WIDE} * ({d}))"))
    entries = classes.where("sig IS NOT NULL").select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig")
    entries = entries.select("node", "tree", F.expr(f"substring(sig, {size} * tree + 1, {size})").alias("sig")).withColumn("key", prefix(least))
    # Whoever shares no prefix of the least length shares none.
    shared = entries.groupBy("key").agg(F.min("node").alias("_least"), F.max("node").alias("_most")).where("_least < _most").select("key")
    shared = materialise(shared, "shared")
    if shared.count() <= BROADCAST_ROWS:  # else the signatures are shuffled
        shared = F.broadcast(shared)
    alive = materialise(entries.join(shared, "key").drop("key"), "tries")
    nodes = alive.select("tree", "sig").groupBy("tree", "sig").agg(F.count(F.lit(1)).cast("double").alias("n"))
    nodes = nodes.select("tree", "sig", "n", F.explode(F.sequence(F.lit(least), F.lit(DEPTH))).alias("depth")).groupBy("tree", "depth", prefix("depth").alias("key")).agg(F.sum("n").alias("n"))
    pairs = {(r["tree"], r["depth"]): r["pairs"] for r in nodes.groupBy("tree", "depth").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    depths = shortened(pairs, threshold, trees, target)
    cut = alive.select("node", F.xxhash64("tree", F.expr(f"substring(sig, 1, {WIDE} * element_at(array({', '.join(map(str, depths))}), tree + 1))")).alias("key"))
    block = cut.groupBy("key").agg(F.min("node").alias("block"), F.max("node").alias("_most")).where("block < _most").drop("_most")
    return cut.join(block, "key").groupBy("node").agg(F.collect_set("block").alias("blocks"))


# --- comparing the members of two tiles ---------------------------------------------------------------------------------------


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact shingle sets in CSR form; a shingle is a number that stands for its words themselves."""
    offsets, words = split_words(pa.array(texts, pa.large_string()))
    codes, names = coded(words)
    base = len(names) + 1
    counts = np.diff(offsets)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    row = row_of(starts)
    first = offsets[row] + np.arange(starts[-1]) - starts[row]
    number = np.zeros(len(first), np.int64)
    for k in range(SHINGLE):  # words one by one: (number so far, next word) gets a number of its own
        at = first + k
        nxt = np.where(at < offsets[row + 1], codes[np.minimum(at, max(0, len(codes) - 1))] + 1, 0) if len(codes) else np.zeros(len(first), np.int64)
        number = np.unique(number * base + nxt, return_inverse=True)[1] if len(first) else number
    width = int(number.max()) + 1 if len(number) else 1
    both = np.unique(row * width + number)
    return np.searchsorted(both // width, np.arange(len(texts) + 1)), both % width


def common_shingles(starts: np.ndarray, columns: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left row, right row]: how many shingles the two have in common."""
    n, row = len(starts) - 1, row_of(starts)
    side_l, side_r = np.full(n, -1), np.full(n, -1)
    side_l[left], side_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    in_l, in_r = np.bincount(columns[side_l[row] >= 0], minlength=int(columns.max()) + 1 if len(columns) else 1), np.bincount(columns[side_r[row] >= 0], minlength=int(columns.max()) + 1 if len(columns) else 1)
    useful = np.flatnonzero((in_l > 0) & (in_r > 0))
    place = np.full(len(in_l), -1)
    place[useful] = np.arange(len(useful))
    keep = place[columns] >= 0
    row, col = row[keep], place[columns[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 2048
    for begin in range(0, len(useful), width):
        i, j = np.searchsorted(col, [begin, begin + width])
        r, c = row[i:j], col[i:j] - begin
        a, b = np.zeros((len(left), min(width, len(useful) - begin)), np.float32), np.zeros((len(right), min(width, len(useful) - begin)), np.float32)
        at = side_l[r] >= 0
        a[side_l[r[at]], c[at]] = 1
        at = side_r[r] >= 0
        b[side_r[r[at]], c[at]] = 1
        use_a, use_b = np.flatnonzero(a.any(axis=1)), np.flatnonzero(b.any(axis=1))
        out[np.ix_(use_a, use_b)] += a[use_a] @ b[use_b].T
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for the edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def compare_tile(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """node, links (rows of other classes linked with node in this tile) and root (the least node that it is linked with here).

    A pair is counted in the least block that both belong to.
    """
    whole = bool(group["i"].iloc[0] == group["j"].iloc[0])
    sets = group.sort_values("node").reset_index(drop=True)
    starts, columns = shingle_sets(sets["_text"].fillna("").tolist())
    block = sets["block"].iloc[0]
    size = np.diff(starts)
    side = sets["side"].to_numpy()
    left, right = (np.arange(len(sets)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, found_a, found_b = np.zeros(len(sets), np.int64), [], []
    copies = sets["copies"].to_numpy(np.int64)
    blocks = [frozenset(int(x) for x in b if x < block) for b in sets["blocks"]]
    for begin in range(0, len(left), TILE):
        rows = left[begin : begin + TILE]
        common = common_shingles(starts, columns, rows, right)
        union = size[rows][:, None] + size[right][None, :] - common
        a, b = np.nonzero((common >= threshold * union - 1e-6) & (common > 0))
        a, b = rows[a], right[b]
        once = a < b if whole else np.ones(len(a), bool)
        a, b = a[once], b[once]
        if len(a) and any(blocks):
            fresh = np.fromiter((blocks[x].isdisjoint(blocks[y]) if blocks[x] and blocks[y] else True for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            a, b = a[fresh], b[fresh]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])
    node = sets["node"].to_numpy()
    linked = np.flatnonzero(links > 0)
    return pd.DataFrame({"node": node[linked], "links": links[linked], "root": node[roots(len(sets), a.astype(np.int64), b.astype(np.int64))[linked]]})


# --- components ------------------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for edges (a, b) with a >= b.

    Each round lets every node adopt the least label around it and its label's label; it ends when nothing changes. Rounds are written to
    the shared folder. Only sums and minima by node are shuffled, which combine before the shuffle.
    """
    edges = materialise(edges.where("a <> b").distinct(), "edges")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        above = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        new = new.join(above, F.col("root") == F.col("_n"), "left").select("node", "old", F.least("root", F.coalesce("_up", "root")).alias("root"))
        new = materialise(new, "labels")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def with_classes(docs: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """What join_similar() gives, and th (a hash of the text) and class (a number for each class)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = materialise(sign(docs, trees), "signatures")
    one = F.min(F.struct("doc_id", "th")).alias("one")
    classes = signed.where("doc_id IS NOT NULL").groupBy("set_hash").agg(one, F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    classes = numbered(classes.select("set_hash", F.col("one.doc_id").alias("rep"), F.col("one.th").alias("th"), "copies", "n_bytes", "sig"), "classes", "node")

    member = blocks_of(classes.select("node", "sig"), threshold, trees, target)
    member = materialise(member.join(classes.select("node", "rep", "th", "copies", "n_bytes"), "node"), "members")
    in_block = member.select("node", "rep", "th", "copies", "n_bytes", "blocks", F.explode("blocks").alias("block"))
    # Only blocks of several tiles need their number known: at most one for each TILE members or TILE_BYTES.
    sizes = in_block.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n_bytes") / TILE_BYTES)).cast("long").alias("tiles"))
    sizes = materialise(sizes.where("tiles > 1"), "tiles")
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    placed = in_block.join(sizes, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), F.when(F.col("own") <= k, 0).otherwise(1).alias("side")))
    placed = placed.withColumn("x", F.explode(others)).select("block", "node", "rep", "th", "copies", "blocks", "x.i", "x.j", "x.side")
    wanted = member.select("rep", "th")
    if member.count() <= BROADCAST_ROWS:  # else all texts are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("rep"), "th", F.col("text").alias("_text")).join(wanted, ["rep", "th"], "left_semi")
    texts = texts.dropDuplicates(["rep", "th"])  # equal rows
    wide = placed.join(texts, ["rep", "th"]).select("block", "i", "j", "side", "node", "copies", "blocks", "_text")
    compared = wide.groupBy("block", "i", "j").applyInPandas(lambda g: compare_tile(g, threshold), "node long, links long, root long")
    compared = materialise(compared, "links")

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = materialise(labels.join(links, "node").join(classes.select("node", "rep"), "node"), "linked")
    ids = materialise(linked.groupBy("root").agg(F.min("rep").alias("class_id")), "class_ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    linked = linked.join(ids, "root").select("node", "root", "class_id", "links")
    result = classes.select("set_hash", "node", "rep", "copies").join(linked, "node", "left")
    result = result.select("set_hash", F.coalesce("root", "node").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    keyed = signed.select("doc_id", "th", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    out = keyed.join(result, "set_hash", "left")
    return out.select("doc_id", "class_id", "copy_id", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "th", "class")


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of what is linked, step by step), copy_id (the least with the same shingle set),
    n_copies (rows with the same set) and n_links (other rows whose sets have a Jaccard similarity of threshold or more).

    docs: doc_id (integer), text. A text of fewer words than a shingle has one shingle of them all; texts without words (null, empty) are copies of one
    another and of nothing else. A row with a null doc_id counts in no class: class_id is null, n_copies and n_links 0. Repeated rows are
    copies. Rows with one doc_id and different texts are told apart (classes that have their least id in common bear the same
    class_id). Texts are read whole. Empty table: no rows. Other columns are not read.
    """
    return with_classes(docs, threshold, trees, target).drop("th", "class")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of join_similar(): one with the class's id. Rows with a null doc_id all stay."""
    rows = with_classes(docs, THRESHOLD, TREES, TARGET).where("doc_id = class_id")
    chosen = rows.groupBy("class", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    chosen = materialise(chosen.groupBy("class").agg(F.min(F.struct("doc_id", "th", "n")).alias("x")).select("x.*"), "chosen")
    mark, names = unique_name(docs, "_text_hash"), [unique_name(docs, f"_kept_{c}") for c in ("doc_id", "th", "n")]
    ids = chosen.toDF(*names)
    marked = docs.withColumn(mark, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(names[0])) & (F.col(mark) == F.col(names[1]))
    out = marked.join(ids.where(F.col(names[2]) == 1), same, "left_semi")
    repeated = ids.where(F.col(names[2]) > 1)
    if not repeated.isEmpty():  # equal rows stay once
        out = out.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark]))
    return out.drop(mark).unionByName(docs.where("doc_id IS NULL"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
