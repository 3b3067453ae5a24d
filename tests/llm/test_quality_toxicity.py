import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import no_documents, odd_documents

from framewright.llm import quality, toxicity
from framewright.llm.common import table


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(inside)


def test_statistics(spark):
    rows = odd_documents(spark).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in rows)
    out = quality.judge(odd_documents(spark)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in out)
    assert quality.judge(no_documents(spark)).collect() == []
    assert quality.filter_quality(no_documents(spark)).collect() == []


def test_filter_agrees_with_judge(spark, medium):
    docs = table(spark, medium, "documents")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_bands_reject_junk_and_keep_prose(spark, medium):
    out = quality.judge(table(spark, medium, "documents")).join(table(spark, medium, "labels"), "doc_id").where("NOT base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98
    assert out[out.quality == 0].kept.mean() < 0.1


class PlainModel:
    """Modified Kneser-Ney in dictionaries, as quality.train() describes it."""

    def __init__(self, docs):
        words = [(lang, re.findall("[^\x20\x09-\x0d]+", text)) for lang, text in docs]
        totals, counts = Counter(), Counter()
        for lang, ws in words:
            totals[lang] += len(ws)
            counts.update((lang, w) for w in ws)
        every = sum(totals.values())
        self.vocabulary = {k for k, n in counts.items() if totals[k[0]] >= every * quality.LANGUAGE_SHARE and n >= totals[k[0]] * quality.WORD_SHARE}
        tri = Counter(g for lang, ws in words for g in self.trigrams(lang, ws))
        bi = Counter((g[0], *g[2:]) for g in tri)
        uni = Counter((g[0], *g[2:]) for g in bi)
        self.own, self.weight = {}, {}
        for level in (tri, bi):
            least = quality.NGRAM_SHARE * sum(level.values())
            context_total, kept = Counter(), Counter()
            for g, n in level.items():
                context_total[g[:-1]] += n
            for lang in {g[0] for g in level}:
                d = quality.discounts([sum(1 for g, n in level.items() if g[0] == lang and n == k) for k in (1, 2, 3, 4)])
                for g, n in level.items():
                    if g[0] == lang and n >= least:
                        self.own[g] = max(0, n - d[min(n, 3)]) / context_total[g[:-1]]
                        kept[g[:-1]] += self.own[g]
            self.weight |= {c: 1 - x for c, x in kept.items()}
        self.uni = {g: n for g, n in uni.items() if n >= quality.NGRAM_SHARE * sum(uni.values())}
        self.base = Counter()
        for g, n in self.uni.items():
            self.base[g[0]] += n

    def trigrams(self, lang, ws):
        t = ["<", "<", *(w if (lang, w) in self.vocabulary else None for w in ws), ">"]
        return [(lang, *t[i : i + 3]) for i in range(len(t) - 2)]

    def ppl(self, lang, text):
        logs = []
        for g in self.trigrams(lang, re.findall("[^\x20\x09-\x0d]+", text)):
            p = (self.uni.get((lang, g[3]), 0) + 1) / (self.base[lang] + quality.BASE)
            p = self.own.get((lang, *g[2:]), 0) + self.weight.get((lang, g[2]), 1) * p
            p = self.own.get(g, 0) + self.weight.get(g[:3], 1) * p
            logs.append(math.log10(p))
        return -sum(logs) / len(logs)


def test_perplexities_and_verdicts_against_a_plain_model(spark, small):
    rows = table(spark, small, "documents").select("doc_id", "lang", "text").collect()
    rows += [type(rows[0])(doc_id=10**6 + i, lang=x, text=t) for i, (x, t) in enumerate([(None, "a b a"), ("xx", "one two"), ("en", None)])]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)).collect()}
    model = PlainModel([(r.lang or "", r.text or "") for r in rows])
    ppl = {r.doc_id: model.ppl(r.lang or "", r.text) if brute(r.text)[0] else None for r in rows}
    for i, p in ppl.items():
        assert (p is None and got[i].ppl is None) or math.isclose(p, got[i].ppl, rel_tol=1e-4)
    for lang in {r.lang for r in rows}:
        of = [i for i in ppl if got[i].lang == lang and ppl[i] is not None]
        good = [i for i in of if not got[i].base_failed] or of
        if not good:
            continue
        different = {(got[i].ppl, got[i].n_words) for i in good}
        q = np.quantile([round(p * quality.STEP) for p, _ in different], [0.15, 0.5, 0.85]) / quality.STEP
        low, high = q[1] - quality.LOWER * max(q[1] - q[0], quality.LEAST), q[1] + quality.UPPER * max(q[2] - q[1], quality.LEAST)
        for i in of:
            assert math.isclose(got[i].low, low, rel_tol=1e-9) and math.isclose(got[i].high, high, rel_tol=1e-9)
            assert got[i].kept == (not got[i].base_failed and low <= got[i].ppl <= high)


def test_small_languages_have_a_vocabulary(spark):
    """A language below a 2^10th of all tokens had none, and its texts' perplexity told nothing but their length."""
    large = " ".join(f"word{i % 50}" for i in range(400_000))
    prose, mixed = "la la na " * 20, "na la la la na na " + "na na na la " * 13 + "la la"
    assert len(prose.split()) == len(mixed.split())
    rows = [(0, "en", large), *((i, "xx", prose) for i in range(1, 6)), (9, "xx", mixed)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got[1].ppl < got[9].ppl


def test_languages_beyond_the_broadcast(spark, small, monkeypatch):
    docs = table(spark, small, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat('l', doc_id % 40) ELSE lang END AS lang")
    docs = docs.union(docs.limit(1).selectExpr("doc_id + 1000000", "''", "'no words'")).cache()
    key = lambda rows: sorted(((r.doc_id, r.ppl, r.low, r.high, r.kept) for r in rows), key=str)
    want, kept = key(quality.judge(docs).collect()), {r.doc_id for r in quality.filter_quality(docs).collect()}
    for size in (0, 60_000):  # no language is broadcast, or some
        monkeypatch.setattr(quality, "NEAR_NGRAMS", size)
        monkeypatch.setattr(quality, "CHUNK", 5000)
        assert key(quality.judge(docs).collect()) == want
        assert {r.doc_id for r in quality.filter_quality(docs).collect()} == kept


def test_no_ngram_is_left_out(spark, small, monkeypatch):
    """N-grams below NGRAM_SHARE of their language's counts went to the lower order: here nearly all of them would."""
    docs = table(spark, small, "documents")
    docs = docs.union(docs.where("doc_id < 3")).cache()  # repeated rows, too
    key = lambda rows: sorted(((r.doc_id, r.ppl, r.low, r.high, r.kept) for r in rows), key=str)
    want, kept = key(quality.judge(docs).collect()), sorted(r.doc_id for r in quality.filter_quality(docs).collect())
    assert kept == sorted(x[0] for x in want if x[4])
    for size in (quality.NEAR_NGRAMS, 0):
        monkeypatch.setattr(quality, "NGRAM_SHARE", 2.0**-7)
        monkeypatch.setattr(quality, "NEAR_NGRAMS", size)
        monkeypatch.setattr(quality, "CHUNK", 20_000)
        assert key(quality.judge(docs).collect()) == want
        assert sorted(r.doc_id for r in quality.filter_quality(docs).collect()) == kept


def test_kneser_ney_sums_to_one(spark):
    texts = [" ".join(np.random.default_rng(i).choice(list("abcde"), 300, p=[0.4, 0.3, 0.2, 0.05, 0.05])) for i in range(10)]
    model = quality.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"))
    lang = quality.language_hash(["x"])
    for context in ((quality.BEGIN, quality.BEGIN), (quality.FIRST, quality.FIRST + 2), (quality.FIRST + 4, quality.FIRST + 4), (4000, 4001)):
        codes = (context[0] * quality.BASE + context[1]) * quality.BASE + np.arange(quality.BASE)
        assert math.isclose((10 ** model.log10(np.repeat(lang, len(codes)), codes)).sum(), 1, rel_tol=1e-5)


def test_trigrams_do_not_cross_texts():
    vocabulary = quality.Vocabulary.of([("x", h) for h in quality.word_hashes(pa.array(["b a"], pa.large_string()))[1].tolist()])
    offsets, hashes = quality.word_hashes(pa.array(["a b", "", "c"], pa.large_string()))
    row, codes = vocabulary.trigrams(quality.language_hash(["x"] * 3), offsets, hashes)
    a, b = (vocabulary.words.get(quality.key_of(quality.language_hash(["x"]), hashes[i : i + 1].view(np.uint64), 0), 0)[0] for i in (0, 1))
    code = lambda x, y, z: (x * quality.BASE + y) * quality.BASE + z
    assert {a, b} == {quality.FIRST, quality.FIRST + 1} and row.tolist() == [0, 0, 0, 1, 2, 2]
    assert codes.tolist() == [code(0, 0, a), code(0, a, b), code(a, b, quality.END), code(0, 0, quality.END), code(0, 0, quality.UNKNOWN), code(0, quality.UNKNOWN, quality.END)]


def test_model_does_not_depend_on_the_layout(spark, small):
    docs = table(spark, small, "documents")
    one, many = ({r.doc_id: (r.ppl, r.kept) for r in quality.judge(docs.repartition(n)).collect()} for n in (1, 40))
    assert one == many


def test_chain_on_held_out_documents(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    big = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    chain = toxicity.train(big[0].where("doc_id % 3 > 0"), big[1])
    out = toxicity.classify(big[0].where("doc_id % 3 = 0"), chain, keep=["doc_id"]).join(big[1].withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    y = out.label == 1
    assert out.toxic[y].mean() > 0.85 and out.toxic[~y].mean() < 0.02
    assert docs.count() and labels.count()


def test_later_models_hear_of_earlier_ones():
    """Where the second category is the first one's exact echo, the chain leans on the first probability."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "fine", "plain", "calm"], 7)) + (" vile" if i % 4 == 0 else " calm") for i in range(400)]
    starts, features, words = toxicity.document_features(pa.array(texts, pa.large_string()))
    y = (np.arange(400) % 4 == 0).astype(np.int64)
    chain = toxicity.Chain.fit(["a", "b"], starts, features, words, np.column_stack([y, y]))
    p = chain.predict(pa.array(["good " * 7 + "vile", "good fine " * 4], pa.large_string()))
    assert p[1][0] > 0.5 > 0.2 > p[1][1] and chain.models[1].dense[1] > 0


def test_held_out_documents_have_no_say_in_their_features():
    """A fold's words that stand in no other fold are no feature of the models that judge it: its out-of-fold probabilities don't know them."""
    n, folds = 300, toxicity.FOLDS
    texts = ["calm plain words here " + ("vile" if i % 2 else "good") + f" mark{i % folds}{i % 2}" for i in range(n)]
    starts, features, words = toxicity.document_features(pa.array(texts, pa.large_string()))
    y = (np.arange(n) % 2)[:, None]
    seen = []
    fit = toxicity.Linear.fit

    def spy(starts, columns, width, dense, y, **more):
        seen.append((len(y), width))
        return fit(starts, columns, width, dense, y, **more)

    toxicity.Linear.fit = spy
    try:
        toxicity.Chain.fit(["a"], starts, features, words, y)
    finally:
        toxicity.Linear.fit = fit
    assert [k for k, _ in seen] == [n - n // folds] * folds + [n]
    assert all(width < seen[-1][1] for _, width in seen[:-1])


def test_a_repeated_id_does_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 200 + [(1, "d e f")] * 50 + [(2, "vile words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert len(chain.models) == len(toxicity.CATEGORIES)
    clash = docs.selectExpr("doc_id", "text", "1 as _text", "2 as _th")
    assert toxicity.classify(clash, chain).columns[:4] == ["doc_id", "text", "_text", "_th"]
    assert quality.judge(clash.selectExpr("*", "'x' as lang", "3 as _lang", "4 as _language"), ("_text", "_lang", "_language")).count() == 251


def test_odd_documents(spark):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 1, 0), (5, 0, None), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    chain = toxicity.train(docs, labels)
    out = toxicity.classify(docs, chain)
    assert out.count() == docs.count() and not out.where("text IS NULL OR text = ''").where("toxic").count()
    assert toxicity.filter_toxic(docs, chain).columns == docs.columns
    empty = toxicity.train(no_documents(spark), labels)
    assert toxicity.classify(docs, empty).count() == docs.count() and toxicity.classify(no_documents(spark), chain).count() == 0


@pytest.mark.parametrize("word,like", [("Idiot,", "idiot"), ("%%%fool!", "fool"), ("***", None)])
def test_word_features(word, like):
    assert toxicity.word_features(word) == (toxicity.word_features(like) if like else [])


def test_op9_over_the_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = quality.op9_quality_rules(spark, small).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in docs.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def test_copies_do_not_narrow_the_bands(spark, medium):
    """A third of all rows copies of one document: the others are kept as before."""
    docs = table(spark, medium, "documents").select("doc_id", "text", "lang")
    before = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    first = docs.where(docs.doc_id == min(before))
    more = docs.unionByName(first.crossJoin(spark.range(500)).selectExpr("1000000 + id as doc_id", "text", "lang"))
    after = {r.doc_id for r in quality.judge(more).where("kept AND doc_id < 1000000").collect()}
    assert len(before - after) <= 0.01 * len(before)
