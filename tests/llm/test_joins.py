"""Line dedup, lattice hashing and mixing against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lattice, linededup, mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# -- line dedup ----------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b, k):
    """Edit distance at most k, with cheap tests first."""
    if abs(len(a) - len(b)) > k:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    j = next((j for j, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - j], b[: len(b) - j]
    return max(len(a), len(b)) <= k or (len(a) <= 400 and distance(a, b) <= k)


def plain_dedup(rows, edits):
    """doc row number -> (exact, near) positions that go."""
    first, out = {}, defaultdict(lambda: ([], []))
    places = []
    for d, t in rows:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(linededup.TRIM)
            if len(line) >= linededup.MIN_CHARS:
                places.append((d, pos, line))
    places.sort(key=lambda p: (p[0], p[1]))
    by_length = defaultdict(list)
    for d, pos, line in places:
        if line in first:
            out[d][0].append(pos)
            continue
        if any(close(line, other, edits) for n in range(len(line) - edits, len(line) + edits + 1) for other in by_length[n]):
            out[d][1].append(pos)
        first[line] = (d, pos)
        by_length[len(line)].append(line)
    return out


def variants(r, line, n):
    """``line`` after n random edits."""
    out = list(line)
    for _ in range(n):
        p = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out.insert(p, r.choice("qwz é"))
        elif kind == 1:
            out[p] = r.choice("qwzé")
        else:
            del out[p]
    return "".join(out)


def check_lines(spark, rows, edits=linededup.EDITS):
    plain = plain_dedup(rows, edits)
    want = []
    for d, t in rows:
        exact, near = plain[d]
        gone = {*exact, *near}
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        want.append((d, len(t.split("\n")) if t is not None else 0, len(exact), len(near), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in linededup.report(docs(spark, rows), edits=edits).collect()]
    assert sorted(got) == sorted(want)
    return sum(w[3] for w in want)


def test_lines_against_all_pairs(spark, texts):
    r = random.Random(6)
    base = [" ".join(texts.words(r.randint(3, 9))) for _ in range(60)]
    lines = base + [variants(r, x, n) for x in base for n in (0, 1, 2, 3, 4)]
    # one crowded bucket: the same line but for its number
    lines += [f"entry number {i:05d} of the long table of contents" for i in range(0, 4000, 57)]
    lines += ["short", "", "  " + base[0] + " \t", base[1] + "\r", "a" * 20, "a" * 19, "a" * 21, "a" * 23]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range((len(lines) + 4) // 5)]
    assert check_lines(spark, rows + [(9000, None), (9001, ""), (9002, "\n\n")]) > 40


def permuted(r, n):
    """Lines that begin alike and hold the same letters, some near copies."""
    tail = list("the quick brown fox jumps over the lazy dog and then sleeps all day long 0123")
    lines = []
    for _ in range(n):
        r.shuffle(tail)
        lines.append("2024-05-01 INFO [main] org.example.Server " + "".join(tail))
    return lines + [variants(r, x, r.choice((1, 2, 3))) for x in lines[:: n // 10]]


def test_one_segment_in_many_lines(spark, monkeypatch):
    """Results as of all pairs; pairs grow with the lines, not their square."""
    r = random.Random(8)
    lines = permuted(r, 150)
    assert check_lines(spark, [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(17)]) >= 5
    made, verified = [], linededup.verified

    def counted(pairs, texts, edits):
        made.append(pairs.count())
        return verified(pairs, texts, edits)

    monkeypatch.setattr(linededup, "verified", counted)
    counts = []
    for n in (1000, 2000):
        made.clear()
        linededup.report(docs(spark, list(enumerate(permuted(r, n))))).count()
        counts.append(sum(made))
    assert counts[0] < 20 * 1000 and counts[1] <= 2.5 * counts[0]


def test_other_edit_limits(spark, texts):
    r = random.Random(12)
    base = [" ".join(texts.words(r.randint(5, 9))) for _ in range(30)]
    lines = base + [variants(r, x, n) for x in base for n in (1, 3, 4, 5, 6)] + permuted(r, 90)
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 9 : i * 9 + 9])) for i in range((len(lines) + 8) // 9)]
    assert check_lines(spark, rows, edits=1) < check_lines(spark, rows, edits=4)
    with pytest.raises(ValueError, match="segment"):
        linededup.report(docs(spark, rows), near_from=2)


def test_a_text_that_loses_many_lines(spark):
    line = "the same line again and again"
    kept = [f"a line of its own {hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(300)]
    text = "\n".join(x for k in kept for x in [k, *[line] * 100])
    row = linededup.report(docs(spark, [(1, text), (2, line)])).where("doc_id = 1").head()
    want = "\n".join([kept[0], line, *kept[1:]])
    assert (row.n_lines, row.n_exact, row.n_near) == (30300, 29999, 0)
    assert row.kept_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_clashing_names(spark):
    names = ["_d", "_t", "_exact", "_near", "_row", "_text", "_clean", "h", "line", "_source", "_block", "_tokens", "_c0", "_e", "weight", "a b", "x`y"]
    df = spark.createDataFrame([(1, "some words that make a line\nand more", "s", *range(17)), (2, "some words that make a line", None, *range(17))], ["doc_id", "text", "source", *names])
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [tuple(df.where("doc_id = 1").head())]
    out = mixing.mix(df, facts=False)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in df.collect()}
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_tokens", "epoch", "rank", "_weight"] and out.head().weight == names.index("weight")


def test_driver_lines(spark, sf):
    check_lines(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_edit_distance(spark, edits):
    r = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcé😀 ") for _ in range(r.randint(0, 40)))
        b = variants(r, a, r.randint(0, edits + 2)) if len(a) > edits + 2 else a[::-1]
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect()
    for a, b, d in rows:
        want = distance(a, b)
        assert (d == want) if want <= edits else (d is None or d > edits), (a, b, d, want)


def test_stage_rules(spark):
    """Rows that lose every word go, untouched blank ones stay, columns and order stay."""
    line = "this line is long enough to count as one"
    df = spark.createDataFrame([(1, line, "en", 40, 1), (2, line, "en", 40, 2), (3, line + "\nown", "en", 44, 3), (4, "", "en", 0, 4), (5, None, "en", None, 5), (None, "no id but text of its own here", "x", 30, 6), (1, line, "en", 40, 7)], "doc_id bigint, text string, lang string, n_chars bigint, pos int")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert got == sorted([("1", line, 40), ("1", line, 40), ("3", "own", 3), ("4", "", 0), ("5", None, None), ("None", "no id but text of its own here", 30)], key=lambda x: (x[0], str(x[1])))
    assert linededup.report(df.limit(0)).count() == 0 and linededup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines(spark, tmp_path):
    """The query finds equal lines of any length, near ones from 8 code points on."""
    from corpus_pipeline import line_dedup
    from tidemark.llm.queries import op7_line_dedup

    rows = [(1, "OK\nRead more\nLe.\nx\nfirst"), (2, " Read more\t\nAs.\nRead mores\nx\n\n"), (3, "OK\n请点击这里阅读全文吧\n请点击此处阅读全文吧"), (4, "Le.\nRead"), (5, "OK")]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_exact, r.n_near) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0), 2: (2, 1), 3: (1, 1), 4: (1, 0), 5: (1, 0)}
    kept = {r.doc_id: r.text for r in line_dedup(spark, df, "").collect()}
    assert kept == {1: rows[0][1], 2: "As.\n\n", 3: "请点击这里阅读全文吧", 4: "Read"}


# -- lattice ----------------------------------------------------------------------------
def plain_links(rows):
    good = {}
    for d, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[d] = x / np.sqrt((x * x).sum())
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= lattice.THRESHOLD:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for d, _ in rows:
        seen, todo = {d}, [d]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[d] = (d, len(links[d]), min(seen), min(seen) == d)
    return out


def at_cosine(rng, u, c):
    w = rng.normal(size=len(u))
    w -= (w @ u) * u
    return c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w)


def unit(rng, n):
    u = rng.normal(size=n)
    return u / np.linalg.norm(u)


def test_lattice_against_all_pairs(spark, sf):
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    dim = len(rows[0][1])
    add = lambda v: rows.append((5000 + len(rows), None if v is None else [None if x is None else float(x) for x in v]))
    for c in (0.951, 0.96, 0.97, 0.99, 0.94, 0.949):
        for _ in range(25):
            u = unit(rng, dim)
            add(u)
            add(at_cosine(rng, u, c) * rng.uniform(0.1, 50))
    common = unit(rng, dim)
    for _ in range(60):
        add(common)
    add(at_cosine(rng, common, 0.98))
    add(None)
    add([])
    add([0.0] * dim)
    add([None, *common[1:]])
    add([float("nan"), *common[1:]])
    add([float("inf"), *common[1:]])
    add(common * 1e30)
    add(common[:8])
    add(common[:8] * 2)
    df = spark.createDataFrame([(d, None if v is None else [None if x is None else float(x) for x in v]) for d, v in rows], "vec_id bigint, embedding array<double>")
    assert {r.vec_id: tuple(r) for r in lattice.near_duplicates(df).collect()} == plain_links(rows)


def test_large_groups_of_near_copies(spark):
    """Cores, strays around them and links between cores, against all pairs."""
    rng = np.random.default_rng(11)
    rows = []
    for spread, size in ((0.05, 400), (0.17, 300), (0.25, 150), (0.32, 60)):
        base = unit(rng, 32)
        w = rng.normal(size=(size, 32))
        w -= (w @ base)[:, None] * base
        rows += list(base + spread * rng.uniform(0.7, 1.3, (size, 1)) * w / np.linalg.norm(w, axis=1, keepdims=True))
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= lattice.THRESHOLD
    label = np.arange(len(x))
    while (new := np.where(hit, label, len(x)).min(1)).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    want, have = hit.sum(1) - 1, np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.995 * want.sum()
    tight = slice(0, 700)  # cores count every link
    assert (have[tight] == want[tight]).all()


def test_vectors_that_share_an_id(spark):
    x, y, z = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    rows = [(1, x), (1, y), (None, x), (2, y), (None, z), (None, None), (3, [0.0, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, id int")
    got = Counter(tuple(r) for r in lattice.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True)])
    assert lattice.near_duplicates(df.limit(0)).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_spanning_labels():
    rng = np.random.default_rng(5)
    for _ in range(20):
        hit = rng.random((12, 9)) < 0.12
        left, right = lattice.spanning(hit)
        for i, j in zip(*np.nonzero(hit), strict=True):
            assert left[i] == right[j]
        assert (left[~hit.any(1)] == -1).all() and (right[~hit.any(0)] == -1).all()
        for group in set(left[left >= 0]):
            seen, more = {("l", group)}, [("l", group)]
            while more:
                side, k = more.pop()
                near = [("r", j) for j in np.flatnonzero(hit[k])] if side == "l" else [("l", i) for i in np.flatnonzero(hit[:, k])]
                more += [n for n in near if n not in seen]
                seen.update(near)
            assert {i for s, i in seen if s == "l"} == set(np.flatnonzero(left == group))


def test_recall_at_the_threshold():
    """Own cells of one side against probes of the other."""
    rng = np.random.default_rng(1)
    u = np.array([unit(rng, 64) for _ in range(1500)])
    v = np.array([at_cosine(rng, x, lattice.THRESHOLD) for x in u])
    found, noise = np.zeros(len(u), bool), 0
    for t in range(lattice.TABLES):
        own, probes = lattice.cells(u, t)[0], lattice.cells(v, t)[1]
        found |= (own[:, None] == probes).any(1)
        noise += (np.roll(own, 1)[:, None] == probes).any(1).mean()
    assert found.mean() > 0.995 and noise < 0.01


def test_nearest_lattice_points():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 3
    best = lattice.nearest_e8(x)
    twice = (2 * best).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (best.sum(1) % 2 == 0).all()
    assert len(lattice.MINIMAL) == 240 and len({tuple(v) for v in lattice.MINIMAL}) == 240
    near = ((x[:, None] - (best[:, None] + lattice.MINIMAL)) ** 2).sum(2).min(1)
    assert (((x - best) ** 2).sum(1) <= near + 1e-9).all()


def test_vectors_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x", 5), (1, [1.0, 0.0], "y", 6), (2, [2.0, 0.1], "z", 7), (None, [1.0, 0.0], "n", 8)], "vec_id bigint, embedding array<float>, id string, cell int")
    got = Counter(tuple(r) for r in lattice.near_duplicates(df).collect())
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)])
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# -- mixing -----------------------------------------------------------------------------
def corpus(spark, sizes, seed=0):
    r, rows = random.Random(seed), []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), s, " ".join("w" for _ in range(r.randint(1, 60)))))
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string"), rows


def epochs(mixed, rows):
    tokens, out = Counter(), Counter()
    for _, s, t in rows:
        tokens[s or ""] += len((t or "").split())
    for r in mixed.collect():
        out[r.source or ""] += r.mix_tokens
    return {s: out[s] / tokens[s] for s in tokens if tokens[s]}


def test_repetition_limit(spark):
    df, rows = corpus(spark, {"big": 3000, "mid": 900, "low": 500, "tiny": 300})
    mixed = mixing.mix(df)
    e = epochs(mixed, rows)
    assert abs(e["big"] - 1) < 1e-9 and abs(e["tiny"] - 2) < 0.02 and 1 < e["mid"] < e["low"] < 2
    share = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in e}
    total = sum(share.values())
    x = 1 - math.log(2) / math.log(share["big"] / share["tiny"])
    want = {s: (n / total) ** (x - 1) / (share["big"] / total) ** (x - 1) for s, n in share.items()}
    assert all(abs(e[s] - want[s]) < 0.02 for s in e)
    assert {r.doc_id for r in mixed.collect()} == {d for d, _, _ in rows}  # no document is lost


def test_entropy_target(spark):
    df, rows = corpus(spark, {"a": 2000, "b": 700, "c": 250})
    goal = 1.0
    mixed = mixing.mix(df, mixing.Target(entropy=goal)).collect()
    tokens = Counter()
    for r in mixed:
        tokens[r.source] += r.mix_tokens
    p = np.array(list(tokens.values())) / sum(tokens.values())
    assert abs(-(p * np.log(p)).sum() - goal) < 0.02
    assert abs(sum(tokens.values()) / sum(len(t.split()) for _, _, t in rows) - 1) < 0.02


def test_block_permutations(spark):
    """Each whole epoch emits every block once, in an order of its own; same seed, same result."""
    df, _ = corpus(spark, {"big": 1500, "small": 200})
    one = [tuple(r) for r in mixing.mix(df, keep=["doc_id", "source"]).collect()]
    assert sorted(one) == sorted(tuple(r) for r in mixing.mix(df, keep=["doc_id", "source"]).collect())
    small = [r for r in one if r[1] == "small"]
    first = {r[0]: r[4] for r in small if r[3] == 0}
    assert len(first) == 200
    second = {r[0]: r[4] for r in small if r[3] == 1}
    assert any(first[d] != second[d] for d in second)


def test_mixing_edges(spark):
    rows = [(1, "a", "x y z", 1), (2, "a", None, 2), (3, None, "one two", 3), (4, "empty", "", 4), (5, "empty", None, 5), (1, "a", "x y z", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, epoch int")
    out = mixing.mix(df, keep=["doc_id", "source", "text"]).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5}
    stage = mixing.mix(df.withColumn("weight", F.lit(1)).withColumn("block", F.lit("x")), facts=False)
    assert stage.columns == ["doc_id", "source", "text", "epoch", "weight", "block"] and stage.count() == len(out)
    assert mixing.mix(df.drop("epoch").limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, source string, text string")
    assert mixing.mix(alone).count() == 1
