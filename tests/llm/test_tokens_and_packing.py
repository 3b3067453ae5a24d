import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import no_documents, odd_documents
from tokenizers import Tokenizer

from framewright.llm import packing, tokenfst
from framewright.llm.common import table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*" \n\t'strevlmd.,a1é中 　’Σİ0²🎉́$<|>\x00\x1c\u0085", "'s", "'ll", "'re", "'ve", "<|endoftext|>", "<|startoftext|>", "  ", " the", "Hello", "\r\n", "ẞ", "ﬁ"]


def random_texts(n=3000):
    rnd = random.Random(7)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["", "a" * 3000, " " * 3000, "ab" * 2000 + "'" * 40]


def test_counts_equal_the_library():
    texts, lib = random_texts(), Tokenizer.from_file(BYTES)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert tokenfst.TokenCounter(BYTES).counts(texts).tolist() == want


def test_chunk_maps_compose():
    """Cuts found chunk by chunk equal those of one sequential run."""
    rnd = np.random.default_rng(1)
    sym = rnd.integers(0, 9, 5 * tokenfst.CHUNK + 17).astype(np.uint8)
    state, want = 0, []
    for i, s in enumerate(sym):
        at = int(s) * 8 + state
        if tokenfst.CUT[at]:
            want.append(i)
        state = int(tokenfst.NEXT[at])
    assert tokenfst.cuts(sym).tolist() == want


def test_the_counter_starts_afresh_when_full(monkeypatch):
    monkeypatch.setattr(tokenfst, "CACHED", 50)
    texts, lib = random_texts(300), Tokenizer.from_file(BYTES)
    assert tokenfst.TokenCounter(BYTES).counts(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokenfst.TokenCounter(WORDS)


def test_count_tokens_on_odd_documents(spark):
    lib = Tokenizer.from_file(BYTES)
    docs = odd_documents(spark)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = tokenfst.count_tokens(docs, BYTES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokenfst.count_tokens(no_documents(spark), BYTES).collect() == []


def test_words_equal_the_library():
    texts, lib = random_texts(), Tokenizer.from_file(WORDS)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert packing.WordTokenizer(WORDS).encode(texts) == want


def check_packing(rows, docs, window=4096):
    lib = Tokenizer.from_file(WORDS)
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    for doc_id, text in docs:
        ids = np.asarray([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [p.start for p in pieces] == list(range(0, len(ids), window))
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    return sequences


def test_packing_small(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    rows = packing.op6_packing(spark, small).collect()
    sequences = check_packing(rows, docs)
    assert sum(r.length for r in rows) > 0.97 * 4096 * (len(sequences) - 1)


def test_packing_odd_documents(spark):
    docs = odd_documents(spark).where("doc_id <> 5 AND doc_id IS NOT NULL")
    rows = packing.pack(docs, WORDS).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len(packing.pack(odd_documents(spark), WORDS, keep_ids=True).where("doc_id = 5").collect()) == 3
    assert packing.pack(no_documents(spark), WORDS).collect() == []


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(64, rng.geometric(0.05, 5000)), minlength=65)
    plan = packing.plan(histogram, 64)
    load = np.zeros(plan.sequences, int)
    taken = set()
    for length in np.flatnonzero(histogram):
        rank = np.arange(histogram[length])
        sequence, offset = plan.place(np.full(len(rank), length), rank)
        np.add.at(load, sequence, length)
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            for k in range(length):
                assert (s, o + k) not in taken
                taken.add((s, o + k))
    assert load.max() <= 64 and load.sum() == (histogram * np.arange(65)).sum()
    assert load.sum() / (64 * plan.sequences) > 0.98


def test_least_squares_meet_the_kuhn_tucker_conditions():
    rng = np.random.default_rng(4)
    histogram = rng.integers(1, 50, 129).astype(float)
    histogram[0] = 0
    columns = packing.combinations(histogram, histogram, 128, 0)
    assert ((columns.sum(axis=1) == 128) & ((columns > 0).sum(axis=1) <= packing.MEMBERS)).all()
    x, r, off = packing.nnls(columns, histogram, np.zeros(len(columns)), 1e-6, 20_000)
    a = np.zeros((129, len(columns)))
    for j, c in enumerate(columns):
        for length in c[c > 0]:
            a[length, j] += 1
    w = np.arange(129)
    assert np.allclose(r, histogram - a @ x) and (x >= 0).all() and off <= 1e-6
    gradient = a.T @ (w * r)
    size = np.sqrt((w * histogram**2).sum() * (a * a * w[:, None]).sum(axis=0).max())
    assert gradient.max() < 1e-4 * size and np.abs(gradient[x > 0]).max() < 1e-4 * size


def test_least_squares_place_nearly_all(spark):
    """Of the tokens of the larger table, 90 % at least are placed by least squares, and windows are full."""
    n = Counter()
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    for r in packing.pieces(docs, WORDS).groupBy("length").count().collect():
        n[r["length"]] = r["count"]
    histogram = np.asarray([n[k] for k in range(packing.WINDOW + 1)], np.int64)
    left, tokens = histogram.copy(), np.arange(packing.WINDOW + 1)
    chosen = packing.fitted(left, packing.WINDOW)
    assert all(sum(c) == packing.WINDOW for c, _ in chosen)
    assert sum(times * sum(c) for c, times in chosen) + (left * tokens).sum() == (histogram * tokens).sum()
    assert (left * tokens).sum() < 0.1 * (histogram * tokens).sum()
    assert (histogram * tokens).sum() / packing.WINDOW / packing.plan(histogram).sequences > 0.999


def test_other_word_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.WordTokenizer(BYTES)


def test_op5_over_the_whole_table(spark, small):
    lib = Tokenizer.from_file(BYTES)
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = tokenfst.op5_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs.items()}


def test_workers_keep_one_operators_things():
    from framewright.llm import common

    assert common.kept("a", lambda: 1) == 1 and common.kept("a", lambda: 2) == 1
    assert common.kept("b", lambda: 3) == 3 and common.kept("a", lambda: 4) == 4


def test_new_words_are_encoded_as_one_text(monkeypatch):
    """Words that are not known yet cost one call of the tokenizer together, not one each, and their ids are those of the library."""
    tokenizer = packing.WordTokenizer(WORDS)
    words = ["unverhofftes", "coördinatie", "zyxwvut", "naïveté", "q"]
    called = []
    plain = packing.WordTokenizer._ids
    monkeypatch.setattr(packing.WordTokenizer, "_ids", staticmethod(lambda t, x: called.append(len(x)) or plain(t, x)))
    texts = [" ".join(words), f" {words[0]},  {words[3]} {words[4]}! ", "", "\t"]
    got = tokenizer.encode(texts)
    assert len(words) not in called
    assert got == plain(tokenizer.library, texts)


def test_words_are_split_as_python_does():
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lists = packing.pc.utf8_split_whitespace(packing.pa.array(texts, packing.pa.large_string()))
    assert [x.split() for x in texts] == lists.to_pylist()
