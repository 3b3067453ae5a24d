"""Toxicity by a classifier chain: a linear model for each category, fed with the probabilities of the categories before it.

The probabilities that a later model is trained on are out-of-fold: each document's comes from a model that has not seen it, so
in training they are as good as they will be in use. Features are the words of a text and their beginnings (which catch inflected
forms), hashed; the models are fitted on the driver on a bounded sample of labelled documents, and all texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_bytes, coded, filled, row_of, split_words, table, unique_name

#: Labelled documents that the chain is fitted on at most, in the order of a hash of their ids.
SAMPLE = 8192
#: KEPT features for each category at most.
BITS, KEPT, FOLDS = 20, 600, 3
#: Bytes of text worked on at once.
SLICE = 3 << 19
#: Rejected from this probability on.
THRESHOLD = 0.25
#: Features with a lower chi-square against every category are noise.
MIN_CHI = 15.0
#: Lengths of the word beginnings that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: In the order of the chain: name, and when a labelled document belongs to it.
CATEGORIES = (("junk", "quality = 0"), ("toxic_junk", "toxic = 1 AND quality = 0"), ("toxic", "toxic = 1"))
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings, without the signs at its ends, in lower case."""
    w = EDGE.sub("", word).lower()
    if not w:
        return []
    names = [f"w:{w}", *(f"p{n}:{w[:n]}" for n in PREFIXES if len(w) >= n)]
    return [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names]


def document_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each text: where each text's begin, and the features; and each text's number of words.

    wanted: a flag for each feature; others are left out.
    """
    offsets, words = split_words(texts)
    codes, names = coded(words)
    per_word = [word_features(w) for w in names.to_pylist()]
    if wanted is not None:
        per_word = [[f for f in fs if wanted[f]] for fs in per_word]
    sizes = np.asarray([len(f) for f in per_word], np.int64)
    flat = np.fromiter((f for fs in per_word for f in fs), np.int64, int(sizes.sum()))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    rows, use = row_of(offsets), sizes[codes] > 0 if len(codes) else np.zeros(0, bool)
    pair = np.unique(rows[use] * max(1, len(names)) + codes[use])
    row, code = pair // max(1, len(names)), pair % max(1, len(names))
    n = sizes[code]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[code], n)
    both = np.unique(np.repeat(row, n) << BITS | flat[at])
    return np.searchsorted(both >> BITS, np.arange(len(offsets))), both & ((1 << BITS) - 1), np.diff(offsets)


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def lbfgs(loss, w: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """The minimum of a convex loss (value and gradient), by limited-memory BFGS with backtracking."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -grad, []
        for s, y in reversed(past):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, step = grad @ d, 1.0 if past else 1.0 / max(1.0, float(np.abs(grad).sum()))
        if slope > -1e-7:
            break
        while True:
            new, new_grad = loss(w + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        if (step * d) @ (new_grad - grad) > 1e-12:
            past = [*past[1 - memory :], (step * d, new_grad - grad)]
        w, value, grad = w + step * d, new, new_grad
    return w


@dataclass
class Linear:
    """Weights of the kept features (by place), of the dense inputs, and the bias."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, starts: np.ndarray, columns: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> Linear:
        """Logistic regression with a ridge; rows are in CSR form."""
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(y)
        base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
        w = np.zeros(width + dense.shape[1] + 1)
        w[-1] = np.log(base / (1 - base))

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            score = np.bincount(row, v[columns], n) + dense @ v[width:-1] + v[-1]
            error = probability(score) - y
            grad = np.concatenate([np.bincount(columns, error[row], width), dense.T @ error, [error.sum()]])
            grad[:-1] += l2 * v[:-1]
            return float(np.logaddexp(0, score).sum() - y @ score + 0.5 * l2 * (v[:-1] @ v[:-1])), grad

        w = lbfgs(loss, w, rounds)
        return cls(w[:width], w[width:-1], float(w[-1]))

    def predict(self, starts: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return probability(np.bincount(row, self.weights[columns], len(starts) - 1) + dense @ self.dense + self.bias)


@dataclass
class Chain:
    """names: categories in order; place: of each hashed feature among the kept ones, or -1."""

    names: list[str]
    place: np.ndarray
    models: list[Linear] = field(default_factory=list)

    @staticmethod
    def extra(words: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Dense inputs: the text's length and the logits of the categories before."""
        logit = [np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))) / 4 for p in before]
        return np.column_stack([np.log1p(words) / 8, *logit])

    @classmethod
    def fit(cls, names: list[str], starts: np.ndarray, features: np.ndarray, words: np.ndarray, labels: np.ndarray, kept: int = KEPT, folds: int = FOLDS) -> Chain:
        """labels: [document, category], 0 or 1."""
        n = len(words)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))

        def chosen(which: np.ndarray) -> np.ndarray:
            """The place of each feature among those that tell categories apart in the rows given."""
            mine, rows = which[row], int(which.sum())
            seen = np.bincount(features[mine], minlength=1 << BITS).astype(np.float64)
            out = np.zeros(1 << BITS, bool)
            for y in labels.T:  # chi-square of presence against each category
                hit = np.bincount(features[mine & (y[row] > 0)], minlength=1 << BITS)
                p = y[which].mean() if rows else 0.0
                if 0 < p < 1:
                    chi = np.where(seen >= 3, (hit - seen * p) ** 2 / np.maximum(seen * p * (1 - p), 1e-9), 0.0)
                    top = np.argsort(-chi, kind="stable")[:kept]
                    out[top[chi[top] >= MIN_CHI]] = True
            return np.where(out, np.cumsum(out) - 1, -1)

        def rows_of(which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            use = which[row] & (place[features] >= 0)
            return np.searchsorted((np.cumsum(which) - 1)[row[use]], np.arange(which.sum() + 1)), place[features[use]]

        fold, every = np.arange(n) % folds, np.ones(n, bool)
        places = [chosen(fold != f) for f in range(folds)]  # what is held out has no say in the features
        inside = [rows_of(fold != f, places[f]) for f in range(folds)]
        outside = [rows_of(fold == f, places[f]) for f in range(folds)]
        chain, before = cls(names, chosen(every)), []
        whole = rows_of(every, chain.place)
        for y in labels.T.astype(np.float64):
            dense = cls.extra(words, before)
            out = np.zeros(n)
            for f in range(folds):
                model = Linear.fit(*inside[f], int(places[f].max()) + 1, dense[fold != f], y[fold != f])
                out[fold == f] = model.predict(*outside[f], dense[fold == f])
            chain.models.append(Linear.fit(*whole, int(chain.place.max()) + 1, dense, y))
            before.append(out)
        return chain

    def predict(self, texts: pa.Array) -> list[np.ndarray]:
        starts, features, words = document_features(texts, self.place >= 0)
        columns, before = self.place[features], []
        for model in self.models:
            before.append(model.predict(starts, columns, self.extra(words, before)))
        return before


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    """A chain fitted on at most sample labelled documents: of rows that share an id, the one whose text has the least hash."""
    from pyspark.sql.types import LongType

    flags = [F.coalesce(F.expr(rule), F.lit(False)).cast("long").alias(f"_c{i}") for i, (_, rule) in enumerate(categories)]
    chosen = labels.select(F.col("doc_id").alias("_id"), *flags).where("_id IS NOT NULL").groupBy("_id").agg(*(F.max(f"_c{i}").cast(LongType()).alias(f"_c{i}") for i in range(len(categories))))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    least = rows.groupBy(F.col("_id").alias("_one")).agg(F.min("_th").alias("_least"))  # at most sample rows
    rows = rows.join(F.broadcast(least), (F.col("_id") == F.col("_one")) & (F.col("_th") == F.col("_least"))).dropDuplicates(["_id"])
    names = [f"_c{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                starts, features, words = document_features(filled(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(features, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(words), *(part.column(c) for c in names)], ["id", "features", "words", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, features array<int>, words long, " + ", ".join(f"{c} long" for c in names)).toArrow().combine_chunks()
    got = got.take(pc.sort_indices(got, [("id", "ascending")])).combine_chunks() if len(got) else got
    if not len(got):
        return Chain.fit([c for c, _ in categories], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(categories))))
    lists = got.column("features").chunk(0)
    starts = np.asarray(lists.offsets, np.int64)
    labels_of = np.column_stack([got.column(c).to_numpy() for c in names])
    return Chain.fit([c for c, _ in categories], starts - starts[0], lists.flatten().to_numpy(), got.column("words").to_numpy(), labels_of)


def classify(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, decide: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns keep, or all) with a probability p_<category> for each category and the boolean toxic; columns of docs by these names give way.

    Null and empty texts have no features, so the models' biases speak; they are never rejected. Texts are read whole. Repeated rows score alike. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    out = [*(f"p_{c}" for c in chain.names), "toxic"]
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in out]
    text = unique_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text, SLICE):
                texts = filled(part.column(text))
                p = shared.value.predict(texts)
                empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
                toxic = (p[chain_names.index(decide)] >= threshold) & ~empty
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *map(pa.array, p), pa.array(toxic)], [*columns, *out])

    chain_names = chain.names
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, ", ".join([schema, *(f"p_{c} double" for c in chain.names), "toxic boolean"]))


def filter_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, decide: str = "toxic") -> DataFrame:
    """The rows of docs that classify() finds not toxic, with all their columns."""
    shared, which = docs.sparkSession.sparkContext.broadcast(chain), chain.names.index(decide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                texts = filled(part.column("text"))
                empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
                yield part.filter(pa.array((shared.value.predict(texts)[which] < threshold) | empty))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
