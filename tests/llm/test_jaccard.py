import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import no_documents, odd_documents, random_text

from framewright.llm import jaccard
from framewright.llm.common import table


def shingles(text):
    w = (text or "").replace("\x85", "\x85").split(" ")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """doc_id -> (class_id, n_links), comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links, parent = Counter(), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, least[find(a)], links[a]) for a, (i, _) in enumerate(sets))


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.where("doc_id IS NOT NULL").collect())


def test_prefixes_are_shortened_until_the_target():
    least = jaccard.least_depth(0.8, 32, 0.9999)
    same = jaccard.shortened({}, 0.8, 32, 0.9999)
    assert 1 - jaccard.miss(0.8, same) >= 0.9999 and min(same) >= least
    longer = [d + (i == same.index(min(same))) for i, d in enumerate(same)]
    assert 1 - jaccard.miss(0.8, longer) < 0.9999
    # A tree whose short prefixes are crowded keeps longer ones.
    crowded = {(t, d): 10.0 ** (9 if t == 3 else 2) * 2.0 ** (10 - d) for t in range(32) for d in range(least, 11)}
    depths = jaccard.shortened(crowded, 0.8, 32, 0.9999)
    assert depths[3] == 10 and 1 - jaccard.miss(0.8, depths) >= 0.9999


def test_repeated_ids_lose_no_link(spark):
    rnd = random.Random(3)
    a, b = random_text(rnd, 500, 10**6), random_text(rnd, 500, 10**6)
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (9, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join_similar(docs)) == brute(rows) == [(5, 5, 1), (5, 5, 2), (7, 5, 1), (9, 5, 2), (9, 5, 2)]
    assert sorted(r.text for r in jaccard.keep_one(docs).collect()) == sorted([a, b])


def test_recall_at_the_threshold(spark):
    """Pairs with a similarity just above the threshold, all found."""
    rnd, rows = random.Random(8), []
    for i in range(150):
        words = [f"w{i}_{k}" for k in range(240)]
        other = list(words)
        for k in rnd.sample(range(3, 237, 6), 5):  # each change costs up to five shingles on either side
            other[k] += "x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    js = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert 0.8 <= min(js) and max(js) < 0.85
    out = got(jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(n for _, _, n in out) >= 0.99 * len(rows)


def test_documents_against_all_pairs(spark, medium):
    docs = table(spark, medium, "documents")
    assert got(jaccard.join_similar(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rnd = random.Random(5)
    base = random_text(rnd, 120, 5000).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, random_text(rnd, 60)) for i in range(50)]
    assert got(jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_documents(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    out = jaccard.join_similar(odd_documents(spark))
    assert got(out) == brute(rows)
    assert all((r.class_id, r.n_copies, r.n_links) == (None, 0, 0) for r in out.where("doc_id IS NULL").collect())
    assert jaccard.join_similar(no_documents(spark)).collect() == []


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({0: 1, 3: 1, 4: 1, 5: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, None: 2})


def test_common_shingles_equal_sets():
    rnd = random.Random(2)
    texts = [random_text(rnd, rnd.randint(0, 40), 20) for _ in range(40)]
    starts, columns = jaccard.shingle_sets(texts)
    sets = [shingles(t) for t in texts]
    assert np.diff(starts).tolist() == [len(s) for s in sets]
    left, right = np.arange(0, 25), np.arange(10, 40)
    want = [[len(sets[a] & sets[b]) for b in right] for a in left]
    assert jaccard.common_shingles(starts, columns, left, right).astype(int).tolist() == want


def test_signatures_estimate_similarity():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    other = [w if rnd.random() < 0.96 else w + "x" for w in words]
    texts = pa.array([" ".join(words), " ".join(other)], pa.large_string())
    offsets, flat = jaccard.split_words(texts)
    codes, names = jaccard.coded(flat)
    starts, hashes = jaccard.distinct_per_row(*jaccard.shingle_hashes(offsets, codes, names))
    x, y = shingles(texts[0].as_py()), shingles(texts[1].as_py())
    keys = jaccard.signatures(starts, hashes, 600, 1)[:, :, 0]
    j = len(x & y) / len(x | y)
    assert math.isclose((keys[0] == keys[1]).mean(), j, abs_tol=0.08)


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in jaccard.components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
