"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers stand for the tokenizer:

* The splitter reads code points (as symbols: letter, number, space ...) and emits a cut before those that begin a piece. A
  chunk of text is a map from the state before it to the state after it; the maps of all chunks are found side by side and
  composed by a parallel prefix scan, so a text of any length is no longer than its chunks to work on.
* The counter reads the bytes of a piece. Its transitions carry the number of tokens by which the piece's BPE encoding grows,
  which may be negative: a longer token can take the place of shorter ones. States and transitions are made when first used.

The counter rests on a property of BPE: the encoding of a prefix ends in one token that is settled by the encoding before that
token, so the last token of each prefix that a vocabulary entry can still reach back to is all that need be remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_bytes, filled, kept, table

#: Code points handled at once; a chunk of the scan; entries that a worker's caches hold before they start afresh.
SLICE, CHUNK, CACHED = 2 << 20, 1024, 800_000

# Symbols of the splitter. A1 and A2: an apostrophe with one or two more letters of a contraction behind it. Of white space:
# LAST_SPACE and LAST_OTHER stand before something else, MORE before more white space or the end.
LETTER, NUMBER, OTHER, A1, A2, LAST_SPACE, LAST_OTHER, MORE, RESET = range(9)
# States. FRESH: the next code point begins a piece. REST1 and REST2: so many letters of a contraction are to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, REST1, REST2 = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """The next state and whether a piece begins, by [symbol * 8 + state]."""
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[symbol] = state
        cut[symbol, [state, AFTER_SPACE]] = False
    to[LETTER, [REST1, REST2]], cut[LETTER, [REST1, REST2]] = (FRESH, REST1), False
    for symbol, state in ((A1, REST1), (A2, REST2)):
        to[symbol] = state
        to[symbol, [IN_OTHER, AFTER_SPACE]], cut[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER, False
    to[LAST_SPACE], to[LAST_OTHER], to[MORE], to[RESET] = AFTER_SPACE, FRESH, IN_WHITE, FRESH
    cut[MORE, IN_WHITE] = False
    return to.ravel(), cut.ravel()


NEXT, CUT = _splitter()


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """LETTER, NUMBER, MORE (white space) or OTHER for each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for symbol, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (MORE, r"\s+")):
        for m in regex.finditer(pattern, every):
            i, j = (ord(x) for x in (m[0][0], m[0][-1]))
            out[i : j + 1] = symbol
    out[0xD800:0xE000] = OTHER
    return out


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The splitter's input for code points; at the positions resets one text ends and another begins."""
    sym = symbol_table()[points]
    sym[resets] = RESET
    ahead = np.append(sym[1:], np.uint8(RESET))
    last = (sym == MORE) & (ahead != MORE) & (ahead != RESET)
    sym[last] = np.where(points[last] == 32, LAST_SPACE, LAST_OTHER)
    if len(at := np.flatnonzero(points == 39)):
        padded = np.append(points, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        is2 = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        is1 = np.isin(one, [ord(c) for c in "stmd"])
        sym[at[is2]], sym[at[is1]] = A2, A1
    return sym


def chunk_maps(sym: np.ndarray) -> np.ndarray:
    """sym: [step, chunk] times 8. For each chunk, the state after it for each state before it."""
    state = np.broadcast_to(np.arange(8, dtype=np.uint8), (sym.shape[1], 8))
    for row in sym:
        state = NEXT[row[:, None] + state]
    return state


def exclusive_scan(maps: np.ndarray) -> np.ndarray:
    """The map of all that precedes each chunk, by doubling: log2 rounds of compositions that do not wait for one another."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return np.concatenate([np.arange(8, dtype=np.uint8)[None], out[:-1]])


def cuts(sym: np.ndarray) -> np.ndarray:
    """Where pieces begin."""
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, RESET, np.uint8)
    padded[:n] = sym
    by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * np.uint8(8)
    state = exclusive_scan(chunk_maps(by_step))[:, FRESH]
    found = np.empty((CHUNK, chunks), bool)
    for j, row in enumerate(by_step):
        at = row + state
        found[j], state = CUT[at], NEXT[at]
    return np.flatnonzero(found.T.ravel()[:n])


class Counter(dict):
    """Tokens of each piece (the keys are strings), by a transducer over bytes that grows as it is used."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        super().__init__()
        to_byte = {c: b for b, c in byte_alphabet().items()}
        # A token is known by its rank: bytes first, then each merge's result in the order of merges.
        rank = {c: r for r, c in enumerate(to_byte)}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(r, r) for r in rank.values()]
        spelled = [bytes([b]) for b in to_byte.values()]
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left + right not in vocabulary or left not in rank or right not in rank:
                raise ValueError(f"the merge {left} {right} isn't of a byte-level BPE")
            r = rank.setdefault(left + right, len(self.parts))
            if r == len(self.parts):
                self.parts.append((rank[left], rank[right]))
                spelled.append(spelled[rank[left]] + spelled[rank[right]])
            self.joined.setdefault((rank[left], rank[right]), r)
        self._trie(spelled)
        self.reset()

    def _trie(self, spelled: list[bytes]) -> None:
        """Prefixes of tokens as nodes; for each, the node of its longest proper suffix, and the tokens that end in it."""
        self.child, self.depth, token = {}, [0], [-1]
        for r, word in enumerate(spelled):
            node = 0
            for b in word:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    token.append(-1)
                node = self.child[at]
            token[node] = r
        self.suffix, self.ends = [0] * len(token), [()] * len(token)
        for at, node in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            parent, b = at >> 8, at & 255
            if parent:
                self.suffix[node] = self._goto(self.suffix[parent], b)
            own = ((self.depth[node], token[node]),) if token[node] >= 0 else ()
            self.ends[node] = own + self.ends[self.suffix[node]]  # longest first

    def _goto(self, node: int, b: int) -> int:
        while (at := node << 8 | b) not in self.child and node:
            node = self.suffix[node]
        return self.child.get(at, 0)

    def reset(self) -> None:
        #: A state: its node, and for each prefix from there to here its last token (-1: none, the piece begins) and its tokens less those of now.
        self.states, self.ids, self.step = [(0, (-1,), (0,))], {}, {}
        self.clear()

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the tokens left and right beside each other: no earlier merge joins parts of them across the border."""
        below = len(self.parts)  # merges of this rank or above come too late to cross the border
        while True:
            if self.joined.get((left, right), below) < below:
                return False
            # The later of the two is taken apart first; a byte can't be, then it is the other's turn.
            take_left = left > right
            for side in (take_left, not take_left):
                whole = left if side else right
                inner = self.parts[whole][1] if side else self.parts[whole][0]
                if inner != whole:
                    below = whole if side else whole + 1
                    left, right = (inner, right) if side else (left, inner)
                    break
            else:
                return True

    def grow(self, key: int) -> int:
        """The transition of key (state << 8 | byte): the state it leads to and its tokens plus 128, as one number."""
        node, lasts, counts = self.states[key >> 8]
        to = self._goto(node, key & 255)
        for length, token in self.ends[to]:
            # The prefix before the token; lasts ends with the prefix that ends here.
            if length > len(lasts):
                continue
            last = lasts[-length]
            if last < 0 or self.follows(last, token):
                gained = counts[-length] + 1
                break
        else:
            raise AssertionError("bytes are tokens")
        keep = self.depth[to] + 1
        lasts, counts = (*lasts, token)[-keep:], (*(c - gained for c in counts), 0)[-keep:]
        state = (to, lasts, counts)
        if (number := self.ids.get(state)) is None:
            number = self.ids[state] = len(self.states)
            self.states.append(state)
        out = self.step[key] = number << 8 | gained + 128
        return out

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHED or len(self.step) > CACHED:
            self.reset()
        state, tokens, known = 0, 0, self.step
        for b in piece.encode("utf-8", "replace"):
            key = state << 8 | b
            x = known.get(key) or self.grow(key)
            state = x >> 8
            tokens += (x & 255) - 128
        if len(piece) <= 64:
            self[piece] = tokens
        return tokens


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces = Counter(spec["model"]["vocab"], spec["model"]["merges"])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special token's string is one token, and what lies beside it is text of its own."""
        import re

        segments, owner, out = [], [], np.zeros(len(texts), np.int64)
        mark = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for i, t in enumerate(texts):
            if mark and any(s in t for s in self.special):
                got = mark.split(t)
                out[i] += len(got) - 1
                segments += got
                owner += [i] * len(got)
            else:
                segments.append(t)
                owner.append(i)
        if not segments:
            return out
        joined = "\0".join(segments)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1  # of each segment's separator
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = cuts(symbols(points, ends[:-1]))
        at = found.tolist()
        known = self.pieces
        tokens = np.fromiter((known[joined[i:j]] for i, j in zip(at, [*at[1:], len(joined)], strict=True)), np.int64, len(at))
        tokens[np.isin(found, ends[:-1])] = 0
        total = np.concatenate([[0], np.cumsum(tokens)])
        begins = np.concatenate([[0], ends[:-1] + 1])
        first, last = np.searchsorted(found, begins), np.searchsorted(found, ends)
        np.add.at(out, np.asarray(owner), total[last] - total[first])
        return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for each row of docs.

    path: a byte-level BPE in the format of the tokenizers library, readable by the workers. The counts are those of the whole
    text. Null and empty texts: 0 of both. Repeated rows and null ids are counted one by one. Empty table: no rows. Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"counts {path}", lambda: TokenCounter(path))
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE, keep=True):
                raw = filled(part.column("text")).cast(pa.large_binary()).to_pylist()
                tokens = counter.counts([b.decode("utf-8", "replace") for b in raw])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
