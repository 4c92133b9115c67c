"""Near duplicates against all pairs compared by plain sets."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common, minhash


def plain_weights(texts):
    """Per text its {shingle: weight}, by plain Python over hashed shingles."""
    tf = []
    for t in texts:
        words = t.lower().split()
        windows = Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
        tf.append({int(minhash.shingles([w])[0][0]): c for w, c in windows.items()})
    slots = np.zeros(1 << minhash.DF_BITS, np.int64)
    for c in tf:
        for h in c:
            slots[h >> (minhash.HASH_BITS - minhash.DF_BITS)] += 1
    n, total, m = len(texts), int(slots.sum()), 1 << minhash.DF_BITS

    def level(h):
        c = slots[h >> (minhash.HASH_BITS - minhash.DF_BITS)]
        df = min(max(c - (total - c) / (m - 1), 1), max(1, n))
        return float(np.clip(np.rint(255 * (1 - math.log(df) / math.log(max(2, n)))), 0, 255))

    return [{h: k * (1 + minhash.IDF_SPAN / 255 * level(h)) for h, k in c.items()} for c in tf]


def plain_components(rows):
    """Smallest doc_id of each document's component by comparing all pairs."""
    texts = [t or "" for _, t in rows]
    w = plain_weights(texts)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, x in enumerate(w):
        for h in x:
            where.setdefault(h, []).append(i)
    pairs = {p for v in where.values() for p in itertools.combinations(v, 2)}
    for i, j in pairs:
        both = sum(min(w[i][h], w[j][h]) for h in w[i].keys() & w[j].keys())
        if both >= minhash.THRESHOLD * (sum(w[i].values()) + sum(w[j].values()) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r for r in minhash.near_duplicates(df).collect()}


def test_against_all_pairs(spark, texts):
    base = [texts.text(80) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)]
    for share in (0.005, 0.01, 0.02, 0.03, 0.05):
        rows += [(len(rows) + i, texts.edited(t, share)) for i, t in enumerate(base)]
    # one large group whose members differ from its hub by more and less
    hub = texts.text(120)
    rows += [(1000 + i, texts.edited(hub, texts.r.choice([0.0, 0.01, 0.02, 0.04]))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  two"), (2005, "two one"), (2006, base[0] + " "), (2007, base[0].upper())]
    want = plain_components(rows)
    got = result(spark, rows)
    assert got.keys() == want.keys()
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) and r.class_id <= d for d, r in got.items())
    assert got[2004].class_id == 2003 and got[2006].component_id == 0 and got[2001].kept


def test_driver_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {d: r.component_id for d, r in result(spark, rows).items()} == plain_components(rows)


def test_empty_repeated_and_extra_columns(spark, texts):
    empty = spark.createDataFrame([], "doc_id bigint, text string, bands string, id int")
    assert minhash.near_duplicates(empty).count() == 0
    t = texts.text(60)
    df = spark.createDataFrame([(1, t, "x", 1), (1, t, "y", 2), (2, t, None, 3), (None, t, None, 4)], "doc_id bigint, text string, key string, h int")
    got = Counter(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 1, True), (1, 1, 1, False), (2, 1, 1, False), (None, 1, 1, False)])
    assert minhash.drop_duplicates(empty).columns == empty.columns


def test_rows_that_share_a_doc_id(spark, texts):
    """Unlike texts under one number, or under none, are all compared."""
    a, b, c, d = (texts.text(60) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (2, a), (2, b), (None, a), (2, b), (None, c), (None, c), (3, c + " "), (5, d), (4, near), (6, ""), (6, ""), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, _d int")
    got = minhash.near_duplicates(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    kept = Counter(tuple(r)[:2] for r in minhash.drop_duplicates(df).collect())
    assert kept == Counter([(1, a), (2, b), (3, c + " "), (5, d), (6, ""), (6, ""), (None, None)])
    assert Counter(r.doc_id for r in got if r.kept) == Counter(k[0] for k in kept.elements())
    assert {r.component_id for r in got if r.doc_id == 4} == {1}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        hits = []
        for _ in range(40):
            h = np.sort(rng.integers(0, 2**63, 2000).astype(np.uint64))
            w = rng.uniform(0.5, 3, len(h))
            keep = rng.random(len(h)) < share
            sig = minhash.signatures(np.r_[h, h[keep]], np.log(np.r_[w, w[keep]]), np.array([0, len(h)]))
            hits.append((sig[0] == sig[1]).mean() - w[keep].sum() / w.sum())
        assert abs(np.mean(hits)) < 0.03


def test_word_hashes(monkeypatch):
    """Words alone, together, in small parts, of any length: the same hashes."""
    words = ["a", "b", "ab", "ba", "é漢字", "x" * 5000, "aa", "aaa", "\x00", "0"]
    alone = [minhash.hashed_words([w])[0].tolist() for w in words]
    assert all(len(h) == 1 for h in alone) and len({h[0] for h in alone}) == len(words)
    texts = [" ".join(words), "", " \n", "\t".join(words[::-1]) + "\x0b", words[3].upper()]
    for part in (minhash.PART, 7):
        monkeypatch.setattr(minhash, "PART", part)
        flat, n = minhash.hashed_words(texts)
        assert n.tolist() == [10, 0, 0, 10, 1]
        assert flat.tolist() == [h[0] for h in alone + alone[::-1] + [alone[3]]]
    assert minhash.hashed_words([])[0].tolist() == minhash.hashed_words([""])[0].tolist() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)], [(9, 1), (9, 2), (9, 3), (4, 5)], [], [(i, i + 1) for i in range(1, 60)], [(2, 1), (1, 2), (3, 3)]])
def test_components(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in range(1, 61)], "id bigint")
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    label = {i: i for i in range(1, 61)}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in common.components(nodes, df).collect()} == label
