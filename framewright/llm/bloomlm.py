"""Language-model scores from a log-frequency Bloom filter of word and bigram counts.

A count is held as its level, the number of STEPS that it reaches: the n-gram is entered once for each level up to its own. A reader probes
level after level until a probe fails, so a count is found by repeated membership tests; it is never too low, and too high with a
probability that falls geometrically. Every n-gram of the training texts is in the filter, whose segments (by the upper bits of the
n-gram's hash) have so many bits an entry. How many segments there are follows from the bytes of training text, so neither filter nor
scores depend on how the rows are dealt. Up to a bound on its size the filter is broadcast; beyond it the distinct n-grams of each slice
of text go to their segments by a shuffle, and their levels come back: the scores are the same.

A bigram's probability is (c + k p) / (n + k): c its count, n its context's, p the word's own probability, and k = n ^ NEW, after
Heaps's law about the number of different words behind a context (Witten and Bell's weight for the unseen).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_bytes, coded, filled, hash_strings, materialise, mix, split_words, sums, table

#: Bits of a filter that is broadcast at most (96 MB), bits of an entry, and probes for each: about 1 % of unseen entries are found.
MAX_BITS, BITS, PROBES = 3 << 28, 10, 5
#: Bytes of training text for each segment, at most. A slice sends each segment a block of keys, so there are slices x segments blocks: large
#: slices and segments keep them few (3.4 million at 10 GB of text).
SEGMENT = 16 << 20
#: Levels of counts.
STEPS = np.asarray(sorted({1, *(x << k for k in range(39) for x in (2, 3))}), np.int64)
#: Exact counts of so many words at most (the most frequent) go to all workers, for the base score; others are joined.
HEAD = 1 << 18
#: N-grams that a task holds before it passes them on.
HELD = 2_000_000
#: Bytes of text worked on at once, and those whose n-grams are asked for together where the filter is too large to broadcast.
SLICE, ASKING = 3 << 20, 6 << 20
#: N-grams that a segment looks up at once.
ASKED = 1 << 18
#: The number of different words behind a context that occurs n times is taken for n ^ NEW.
NEW = 0.9
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n", b" "))  # hashes of what is no word


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's tokens begin (one more entry at the end), and the 64-bit hashes of all; each text ends in END."""
    offsets, words = split_words(pc.ascii_lower(texts))
    codes, names = coded(words)
    n = len(offsets) - 1
    out = np.full(len(codes) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] + np.arange(n)] = False
    if len(codes):
        out[inside] = hash_strings(names)[codes]
    return offsets + np.arange(n + 1), out


def bigrams(offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token behind its predecessor (BEGIN for a text's first), and the predecessors."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    with np.errstate(over="ignore"):
        return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + tokens), before


def unigram_key(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ np.uint64(0x5851F42D4C957F2D))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, side="right")


#: The count that a level stands for: the geometric mean of its least and greatest.
LEVEL_COUNT = np.concatenate([[0.0], np.sqrt(STEPS * np.append(STEPS[1:] - 1.0, 2.0 * STEPS[-1]))])


def probes(keys: np.ndarray, at_level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the entry (key, level) in a segment of so many bits."""
    with np.errstate(over="ignore"):
        a = mix(keys + np.uint64(at_level) * np.uint64(0xD1342543DE82EF95))
        b = mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        for j in range(PROBES):
            yield (a + np.uint64(j) * b) % bits


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of a segment: BITS for each entry of all its n-grams."""
    levels = level(counts)
    size = max(64, int(levels.sum()) * BITS // 8 * 8)
    field = np.zeros(size, bool)
    for k in range(1, int(levels.max()) + 1 if len(levels) else 1):
        for at in probes(keys[levels >= k], k, np.uint64(size)):
            field[at] = True
    return np.packbits(field).tobytes()


@dataclass
class Model:
    """The filter's segments end to end, where each begins and how many bits it has; exact counts of the head; the corpus's totals."""

    field: np.ndarray
    begins: np.ndarray
    bits: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    types: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it is not in the filter."""
        out = np.zeros(len(keys), np.int64)
        shift = np.uint64(64 - (len(self.bits).bit_length() - 1))
        seg = (keys >> shift).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(keys), np.int64)
        begins, bits = self.begins[seg], self.bits[seg]
        alive = np.flatnonzero(bits > 0)
        for k in range(1, len(STEPS) + 1):
            there = np.ones(len(alive), bool)
            for at in probes(keys[alive], k, bits[alive]):
                at = at + begins[alive]
                there &= (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            hit = alive[there]
            if not len(hit):
                break
            out[hit] = k
            alive = hit
        return out

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of head words, 0 for others."""
        if not len(self.head):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.head, tokens), len(self.head) - 1)
        return np.where(self.head[at] == tokens, self.head_counts[at], 0)

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of words by the filter."""
        return LEVEL_COUNT[self.levels(unigram_key(tokens))]


@dataclass
class Answered(Model):
    """A model without a filter, for one slice of text: the levels of its n-grams (sorted) are given."""

    keys: np.ndarray
    found: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, sorted (np.unique hashes them first, which takes many times as long)."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def short(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(f"<u{next(w for w in (1, 2, 4, 8) if w == 8 or n.max() < 1 << 8 * w)}").tobytes()


def gather(docs: DataFrame, segments: int) -> DataFrame:
    """seg, words and their counts, all n-gram keys and their counts (as bytes), from training texts; a task passes on sums, not tokens."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

        def combined(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for is_word, parts in held.items():
                if not parts:
                    continue
                keys, n = combined(parts)
                order = keys if not is_word else unigram_key(keys)
                seg = (order >> shift).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)
                by = np.argsort(seg, kind="stable")
                keys, n, seg = keys[by], n[by], seg[by]
                cuts = np.flatnonzero(np.diff(seg, prepend=-1))
                ends = np.append(cuts[1:], len(seg))
                yield pa.RecordBatch.from_arrays([pa.array(seg[cuts]), pa.array([is_word] * len(cuts)), pa.array([keys[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()), pa.array([short(n[i:j]) for i, j in zip(cuts, ends, strict=True)], pa.binary())], ["seg", "is_word", "keys", "n"])
                parts.clear()

        size = 0
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                offsets, tokens = token_hashes(filled(part.column("text")))
                pairs, _ = bigrams(offsets, tokens)
                for is_word, x in ((True, tokens), (False, pairs)):
                    got = np.unique(x, return_counts=True)
                    held[is_word].append(got)
                    size += len(got[0])
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "seg long, is_word boolean, keys binary, n binary")


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model of docs' texts, the exact count n of each word's hash h outside the head, and the segments (seg, bits) if they are too large for the model."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = 1 << max(4, (size // SEGMENT).bit_length())

    def reduce(group: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        words, words_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for is_word, k, n in zip(group.column("is_word").to_pylist(), group.column("keys").to_pylist(), group.column("n").to_pylist(), strict=True):
            (words if is_word else keys).append(np.frombuffer(k, np.uint64))
            (words_n if is_word else counts).append(np.frombuffer(n, f"<u{8 * len(n) // len(k)}").astype(np.int64))
        word, back = np.unique(np.concatenate(words), return_inverse=True)
        word_n = np.bincount(back, np.concatenate(words_n), len(word)).astype(np.int64)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        bits = build_segment(np.concatenate([key, unigram_key(word)]), np.concatenate([n, word_n]))
        seg = group.column("seg")[0].as_py()
        return pa.table({"seg": pa.array([seg] + [None] * len(word), pa.int64()), "bits": pa.array([bits] + [None] * len(word), pa.binary()), "h": pa.array(np.concatenate([[0], word.view(np.int64)]), pa.int64()), "n": pa.array(np.concatenate([[0], word_n]), pa.int64())})

    gathered = gather(docs, segments).repartition(segments // 2, "seg")  # tasks grow with the input
    built = materialise(gathered.groupBy("seg").applyInArrow(reduce, "seg long, bits binary, h long, n long"), "ngrams")
    words = built.where("seg IS NULL").select("h", "n")
    # The head: all words of a count level or above, down to the level at which they would be more than HEAD.
    by_level = sorted(((r["l"], r["types"], r["tokens"]) for r in words.groupBy(F.floor(F.log2("n")).alias("l")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()), reverse=True)
    cut, size = 2**62, 0
    for lev, types, _ in by_level:
        size += types
        if size > HEAD:
            break
        cut = 2**lev
    head = words.where(F.col("n") >= cut).toArrow()  # at most HEAD rows
    h, n = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(h)
    field, begins, bits = [], np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
    at = 0
    filters = built.where("seg IS NOT NULL").select("seg", "bits")
    near = 8 * filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] <= MAX_BITS
    for row in filters.toLocalIterator() if near else ():  # MAX_BITS in all at most
        field.append(np.frombuffer(row["bits"], np.uint8))
        begins[row["seg"]], bits[row["seg"]] = at, 8 * len(row["bits"])
        at += 8 * len(row["bits"])
    model = Model(np.concatenate(field) if field else np.zeros(1, np.uint8), begins, bits, h[order], n[order], sum(t for _, _, t in by_level), sum(t for _, t, _ in by_level))
    return model, words.where(F.col("n") < cut), None if near else filters


def score_part(m: Model, part: pa.RecordBatch, offsets: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """The scores of a slice of rows (doc_id, held_out, text) with its tokens, and the words outside the head."""
    pairs, before = bigrams(offsets, tokens)
    word, of_word = np.unique(tokens, return_inverse=True)
    exact, about = m.exact(word), m.counts(word)
    begun = about[np.searchsorted(word, END)] if len(word) else 0.0  # a text begins as often as it ends
    context_n = np.where(before == BEGIN, begun, about[np.roll(of_word, 1)])  # every other context is the token before
    pair, of_pair = np.unique(pairs, return_inverse=True)
    own = (about + 1) / (m.tokens + m.types + 1)
    seen = np.minimum(LEVEL_COUNT[m.levels(pair)][of_pair], np.minimum(context_n, about[of_word]))
    k = np.maximum(context_n, 1.0) ** NEW
    p = (seen + k * own[of_word]) / (context_n + k)
    known = exact[of_word] > 0
    tail = np.flatnonzero(~known & (about[of_word] > 0))  # what the filter doesn't know has no count
    row = np.searchsorted(offsets, tail, side="right") - 1
    key, n = np.unique(row * len(word) + of_word[tail], return_counts=True)
    ends = pa.array(np.searchsorted(key, np.arange(len(offsets)) * len(word)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (word[key % max(1, len(word))].view(np.int64), n)]
    base = sums(np.log10(exact[of_word] + 1.0), offsets)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(offsets)), pa.array(sums(known.astype(np.int64), offsets)), pa.array(base), pa.array(sums(np.log10(p), offsets)), *lists],
        ["doc_id", "held_out", "n_tokens", "head_known", "head_base", "score", "tail", "tail_n"],
    )


def wanted(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The keys, sorted, that score_part looks up in the filter for a slice's tokens."""
    return distinct(np.concatenate([distinct(bigrams(offsets, tokens)[0]), unigram_key(distinct(tokens))]))


def score_by_shuffle(rows: DataFrame, shared: Broadcast, filters: DataFrame, schema: str) -> DataFrame:
    """score_part of rows (doc_id, held_out, text) under a filter too large to broadcast.

    A slice of text asks each segment once for its distinct n-grams there, so a segment's group grows with the slices, as the number of
    segments does. The slices are cut by place in the input's partitions; should a second reading cut them otherwise, the job fails.
    """
    segments = len(shared.value.bits)
    shift = np.uint64(64 - (segments.bit_length() - 1))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in by_bytes(batch, "text", ASKING):
                yield pa.RecordBatch.from_arrays([pa.array([n] * part.num_rows, pa.int64()), part.column("doc_id"), part.column("held_out"), part.column("text")], ["slice", "doc_id", "held_out", "text"])
                n += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in by_bytes(batch, "text", ASKING):
                keys = wanted(*token_hashes(filled(part.column("text"))))
                ends = np.searchsorted(keys >> shift, np.arange(segments + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(some), pa.int64()), pa.array(some), pa.array([keys[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())], ["slice", "seg", "keys"])
                n += 1

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        field = np.frombuffer(segment.column("bits")[0].as_py() if segment.num_rows else b"", np.uint8)
        one = np.zeros(1, np.uint64)
        m = Model(field, one, one + np.uint64(8 * len(field)), one[:0], np.zeros(0, np.int64), 0, 0)
        blocks = asked.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blocks), np.uint64)
        found = np.zeros(len(keys), np.uint8)
        for i in range(0, len(keys), ASKED):
            found[i : i + ASKED] = m.levels(keys[i : i + ASKED])
        ends = np.cumsum([0, *(len(b) // 8 for b in blocks)])
        return pa.table({"slice": asked.column("slice"), "seg": asked.column("seg"), "levels": pa.array([found[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())})

    def put(rows: pa.Table, answers: pa.Table) -> pa.Table:
        m = shared.value
        part = rows.combine_chunks().to_batches()[0]
        offsets, tokens = token_hashes(filled(part.column("text")))
        keys = wanted(offsets, tokens)
        answers = answers.sort_by("seg")
        sizes = [len(x) for x in answers.column("levels").to_pylist()]
        seg, n = np.unique(keys >> shift, return_counts=True)
        if seg.tolist() != answers.column("seg").to_pylist() or n.tolist() != sizes:
            raise RuntimeError("the input's partitions changed between two readings")
        found = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8).astype(np.int64)
        m = Answered(m.field, m.begins, m.bits, m.head, m.head_counts, m.tokens, m.types, keys, found)
        return pa.Table.from_batches([score_part(m, part, offsets, tokens)])

    # Both readings take the same columns: pruned ones would deal a repartitioned input otherwise.
    asked = rows.mapInArrow(ask, "slice long, seg long, keys binary")
    answers = asked.groupBy("seg").cogroup(filters.groupBy("seg")).applyInArrow(answer, "slice long, seg long, levels binary")
    texts = rows.mapInArrow(cut, f"slice long, doc_id {kind}, held_out boolean, text string")
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(put, schema)


def score(docs: DataFrame, model: Model, rare: DataFrame, held_out: F.Column, filters: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; rare and filters: what train() gives beside the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    norm = math.log10(model.tokens + model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                yield score_part(m, part, *token_hashes(filled(part.column("text"))))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, score double, tail array<long>, tail_n array<long>"
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    rows = rows.mapInArrow(run, schema) if filters is None else score_by_shuffle(rows, shared, filters, schema)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "scores")
    shared.unpersist()  # the scores are written
    tails = rows.select("_row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("_row", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("times")).join(rare, "h")
    tails = tails.groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_base"))
    out = rows.drop("tail", "tail_n").join(tails, "_row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )


def is_held_out(doc_id: F.Column, folds: int = 7, fold: int = 2) -> F.Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents under the model of those that aren't held out.

    Null and empty texts have one token, the end. Repeated rows count in training as often as they occur. With nothing to train on, counts are 0.
    Texts of any length are read whole. Empty table: no rows. Other columns are not read.
    """
    held = is_held_out(F.col("doc_id"))
    model, rare, filters = train(docs.where(~held))
    return score(docs, model, rare, held, filters)


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
