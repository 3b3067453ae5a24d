"""Packing of documents into fixed windows by non-negative least squares over length combinations.

The histogram of piece lengths is all that the plan depends on. Combinations of a few lengths that fill a window exactly are the
columns of A; x >= 0 minimises |A x - histogram|, each length weighted by its tokens, and x rounded says how often each combination is
used. What rounding leaves is fitted again with combinations of its own, until hardly anything is left, which is packed greedily,
largest first. A plan names places by (length, rank among pieces of that length), so the pieces find theirs side by side.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import by_bytes, coded, filled, kept, numbered, ranked, table

WINDOW, END = 4096, 2
#: Members of a combination at most, combinations of each size for each length, and how often further ones are sought.
MEMBERS, CHOICES, MORE = 6, 10, 4
GOLDEN = (5**0.5 - 1) / 2
#: Distinct words that a worker remembers before it starts afresh.
CACHED, SHORT = 600_000, 8
#: Bytes of text worked on at once, and words whose ids are gathered at once.
SLICE, GATHERED = 2 << 20, 1 << 20
#: Signs that may follow a word; none of them begins a piece of its own inside a run.
SIGNS = ".,!?;:#*$%&|<>()[]"


# The normaliser and splitter that a vocabulary's file must have for what WordTokenizer does word by word.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Token ids (little-endian uint32 bytes) of texts as the tokenizers library gives them, remembered word by word.

    This holds for vocabularies whose pieces never reach over white space. Texts for which that or the normaliser's effect
    depends on more than single words go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if [spec[k] for k in ("normalizer", "pre_tokenizer")] != [NORMALISER, SPLITTER] or spec["model"].get("end_of_word_suffix") != "</w>" or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a lower-case BPE vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        # For words of letters only, which no normaliser or pattern would change or cut: white space, the byte alphabet and the merges alone.
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def plain(text: str) -> bool:
        """Lower-casing word by word and splitting as Python does give the library's pieces."""
        import unicodedata

        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return not any(c in text for c in "\x1c\x1d\x1e\x1fΣİ") and unicodedata.is_normalized("NFC", text)

    def _library(self, texts: list[str]) -> list[bytes]:
        return self._ids(self.library, texts)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of words of letters: all as one text, cut behind the tokens that end a word."""
        ids = np.asarray(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):  # a word without an end of its own
            return self._ids(self.bare, words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, new: list[str]) -> None:
        """Words of letters go to the bare tokenizer, with signs behind them in two parts; others to the library."""
        known, tails, rest = self.known, [], []
        letters = set()
        for w in new:
            core = w.rstrip(SIGNS)
            if core.isalpha():
                letters.add(core)
                if len(core) < len(w):
                    tails.append((w, core, w[len(core) :]))
            else:
                rest.append(w)
        for ids_of, words in ((self._words, letters), (self._library, {*rest, *(t for _, _, t in tails)})):
            words = list(words.difference(known))
            known.update(zip(words, ids_of(words), strict=True))
        known.update((w, known[core] + known[tail]) for w, core, tail in tails)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.plain(t) or any(s in t for s in self.special)]
        lower = [t.lower() for t in texts]
        for i in whole:
            lower[i] = ""
        lists = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        offsets = np.asarray(lists.offsets).astype(np.int64)
        codes, names = coded(lists.flatten())
        if len(self.known) > CACHED:  # short words are the ones that come back
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT}
            if len(self.known) > CACHED // 2:
                self.known.clear()
        known, names = self.known, names.to_numpy(zero_copy_only=False).tolist()
        known[""] = b""  # white space at either end of a text
        if new := [w for w in names if w not in known]:
            self._learn(new)
        each = [known[w] for w in names]
        ids, size = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(size) - size
        raw, before = [], [np.zeros(1, np.int64)]
        for i in range(0, len(codes), GATHERED):
            part = codes[i : i + GATHERED]
            n = size[part]
            ends = np.cumsum(n)
            raw.append(ids[np.arange(ends[-1]) + np.repeat(first[part] - ends + n, n)].tobytes())
            before.append(ends + before[-1][-1])
        at = 4 * np.concatenate(before)[offsets - offsets[0]]
        raw = b"".join(raw)
        out = [raw[i:j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Each document's tokens, with the id end behind them, cut every window ids: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = kept(f"words {path}", lambda: WordTokenizer(path)), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE, keep=True):
                raw = filled(part.column("text")).cast(pa.large_binary()).to_pylist()
                encoded = tokenizer.encode([b.decode("utf-8", "replace") for b in raw])
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, got in enumerate(encoded):
                    got += last
                    n = len(got) // 4
                    for at in range(0, n, window):
                        piece = got[4 * at : 4 * (at + window)]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if keep_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


# --- the plan -----------------------------------------------------------------------------------------------------------


def combinations(weight: np.ndarray, left: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Combinations of two to MEMBERS present lengths that fill the window exactly, one in each row (0: no member), sorted and distinct.

    Each length below the window is the first member of some of each size; the others but the last stand at quantiles of the weight,
    evenly spread by multiples of the golden ratio; the last fills the rest, if that length is present.
    """
    present = np.flatnonzero(left[:window])
    if not len(present):
        return np.zeros((0, MEMBERS), np.int64)
    share = np.maximum(weight[present], 0.0)
    share = np.cumsum(share if share.sum() > 0 else np.ones(len(present)))
    share /= share[-1]
    out = []
    for size in range(2, MEMBERS + 1):
        first = np.repeat(present, CHOICES if size > 2 else 1)
        n = np.arange(len(first)) + 1.0
        members = [first, *(present[np.minimum(np.searchsorted(share, (n * GOLDEN**k + GOLDEN * (seed + k)) % 1.0), len(present) - 1)] for k in range(1, size - 1))]
        rest = window - sum(members)
        fits = np.flatnonzero((rest > 0) & (left[np.clip(rest, 0, window - 1)] > 0))
        out.append(np.pad(np.column_stack([*members, rest])[fits], ((0, 0), (0, MEMBERS - size))))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def nnls(columns: np.ndarray, target: np.ndarray, x: np.ndarray, tolerance: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """x >= 0 that minimises the sum of length * (A x - target)^2, column j of A counting the members of columns[j], from a first x.

    Accelerated projected gradients with restarts, on columns scaled to one norm. Also given: the residual, and how far x is from
    the Kuhn-Tucker conditions (no gradient where x > 0, none downhill where x = 0), as a share of the target's norm; it ends at the tolerance.
    """
    real = (columns > 0).astype(float)
    weight = np.arange(len(target), dtype=float)
    product = lambda x: np.bincount(columns.ravel(), (real * x[:, None]).ravel(), len(target))
    transposed = lambda r: ((weight * r)[columns] * real).sum(axis=1)
    scale = 1 / np.sqrt(transposed(np.ones(len(target))))
    norm, v = 1.0, np.full(len(columns), len(columns) ** -0.5)
    for _ in range(20):  # the largest singular value
        v = scale * transposed(product(scale * v))
        norm = float(np.linalg.norm(v))
        v /= norm
    step, size = 1 / (1.1 * norm), np.sqrt((weight * target * target).sum())
    y = z = x / scale
    t = 1.0
    for k in range(rounds):
        new = np.maximum(0.0, z - step * scale * transposed(product(scale * z) - target))
        if ((z - new) * (new - y)).sum() > 0:
            t = 1.0
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, y, t = new + (t - 1) / ahead * (new - y), new, ahead
        if k % 20 == 19 or k == rounds - 1:
            r = target - product(scale * y)
            gradient = scale * transposed(r)
            off = float(np.abs(np.where(y > 0, gradient, np.maximum(0.0, gradient))).max() / max(size, 1e-12))
            if off <= tolerance:
                break
    return scale * y, r, off


def rounded(columns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of windows for x, taken from left: first the whole part of each, then one more by the size of the fractions, as far as left goes."""
    whole, out = np.floor(x + 1e-9).astype(np.int64), []
    part = x - whole
    first = np.argsort(-whole, kind="stable")
    second = np.argsort(-part, kind="stable")
    for order, times in ((first[whole[first] > 0], whole), (second[part[second] > 1e-6], np.ones(len(x), np.int64))):
        for j in order.tolist():
            members = tuple(int(m) for m in columns[j] if m)
            used = {m: members.count(m) for m in members}
            n = min(int(times[j]), *(int(left[m]) // k for m, k in used.items()))
            if n:
                out.append((members, n))
                for m, k in used.items():
                    left[m] -= n * k
    return out


def fitted(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Windows by least squares, taken from left: fitted and rounded again while that places a 100th of what there was and more than that is left."""
    chosen, tokens = [], np.arange(len(left))
    if left[window]:
        chosen.append(((window,), int(left[window])))
        left[window] = 0
    every = int((left * tokens).sum())
    seed, before = 0, 2 * every + 1
    while every and 100 * (now := int((left * tokens).sum())) > every and 100 * (before - now) >= every:
        before, target = now, left.astype(float)
        columns = combinations(target, left, window, seed)
        if not len(columns):
            break
        x, r, _ = nnls(columns, target, np.zeros(len(columns)))
        for _ in range(MORE):  # combinations of what does not fit yet
            if (np.abs(r) * tokens).sum() <= 0.01 * now:
                break
            seed += 1
            some = x > 1e-6
            new = np.concatenate([columns[some], combinations(r, left, window, seed)])
            columns, at = np.unique(new, axis=0, return_index=True)
            x, r, _ = nnls(columns, target, np.append(x[some], np.zeros(len(new)))[at])
        chosen += rounded(columns, x, left)
        seed += 1
    return chosen


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Windows for what is left, by length counts: the largest length first, then whatever fits best, as often as the counts allow."""
    left, out = left.copy(), []
    while left.any():
        members, gap, have = [], window, left.copy()
        while gap and len(fits := np.flatnonzero(have[: gap + 1])):
            length = int(fits[-1])
            members.append(length)
            have[length] -= 1
            gap -= length
        used = np.bincount(members, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        out.append((tuple(members), times))
    return out


@dataclass
class Plan:
    """Places by length: pieces of a length with ranks from first[i] up to first[i+1] go to sequences base[i], base[i]+1, ... at offset[i]."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            first = self.first[int(one)]
            run = np.searchsorted(first, rank[at], side="right") - 1
            sequence[at] = self.base[int(one)][run] + rank[at] - first[run]
            offset[at] = self.offset[int(one)][run]
        return sequence, offset


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram[length]: number of pieces. Its cost depends on the window only, not on how many pieces there are."""
    left = histogram.astype(np.int64).copy()
    chosen = fitted(left, window)
    chosen += greedy(left, window)
    first: dict[int, list[int]] = {}
    base: dict[int, list[int]] = {}
    offset: dict[int, list[int]] = {}
    taken = np.zeros(len(left), np.int64)
    sequence = 0
    for members, n in chosen:
        at = 0
        for length in members:
            first.setdefault(length, []).append(int(taken[length]))
            base.setdefault(length, []).append(sequence)
            offset.setdefault(length, []).append(at)
            taken[length] += n
            at += length
        sequence += n
    as_arrays = lambda d: {k: np.asarray(v, np.int64) for k, v in d.items()}
    return Plan(as_arrays(first), as_arrays(base), as_arrays(offset), sequence)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    docs: doc_id, text; other columns are not read. Null and empty texts give the id end alone. A text of over window tokens is cut every
    window ids; its last piece goes with others'. Pieces in a sequence leave no gap. Repeated rows are packed as often as they occur;
    pieces of equal length take places in the order of the written table. Empty table: no rows. Only the histogram (window + 1
    counts) and the plan drawn from it (bounded by the window, too) pass through the driver.
    """
    rows = numbered(pieces(docs, path, window, end, keep_ids), "pieces", "_row")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most window rows
        histogram[length] = n
    places = rows.sparkSession.sparkContext.broadcast(plan(histogram, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "_rank"]
            sequence, offset = places.value.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = ranked(rows, ["length"], "_row", "_rank").drop("_row")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns)
    return placed.select(*columns, "_rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
