"""The corpus pipeline, stage by stage and as a whole."""

from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import minhash, mixing, piece, quality
from tidemark.llm.queries import ORACLES, PIECE_MODEL, QUERIES, tokenizer_file
from tidemark.session import materialise, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(name, input, output) of every stage."""
    out, docs = [], table(spark, sf, "documents")
    for name, f in corpus_pipeline.STAGES:
        after = materialise(f(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(stages):
    _, before, after = stages[0]
    led = quality.apply_policy(quality.ledger(before))
    assert ids(after) == ids(led.where("kept"))


def test_line_stage(stages):
    _, before, after = stages[1]
    seen = Counter()
    for r in after.collect():
        seen.update({x.strip() for x in r.text.split("\n") if len(x.strip()) >= 20})
        assert r.n_chars == len(r.text)
    assert max(seen.values()) == 1  # no line twice
    lines = lambda df: {x.strip() for r in df.collect() for x in r.text.split("\n") if len(x.strip()) >= 20}
    assert len(lines(before) - lines(after)) < 0.02 * len(lines(before))  # only near copies are lost


def test_near_stage(stages):
    from test_minhash import plain_components

    _, before, after = stages[2]
    want = plain_components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == Counter(d for d, c in want.items() if d == c)


def test_mixing_stage(stages):
    _, before, after = stages[3]
    counts = ids(after)
    assert counts.keys() == ids(before).keys() and max(counts.values()) <= 2
    assert sum(counts.values()) == mixing.mix(before).count()


def test_last_stage(stages):
    import sentencepiece

    _, before, after = stages[4]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_MODEL))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == ids(before)
    for r in after.collect():
        want = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == want and r.decoded == lib.decode(want)


def test_odd_documents(spark, sf):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage."""
    long = "A text about nothing in particular that goes on for a while, word by word. "
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (3, long * 1, "en", "s", 75, 3)]
    rows += [(10 + i, " ".join(f"word{i}x{k}" for k in range(60 + i)), "en", None if i % 3 else "s", 1, i) for i in range(6)]
    rows += [rows[-1], (None, " ".join(f"none{k}" for k in range(70)), "en", "t", 1, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, epoch int")
    for docs in (df, df.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            docs = materialise(f(spark, docs, sf), "odd")
    assert docs.count() == 0
    docs = df
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = materialise(f(spark, docs, sf), "odd")
        assert docs.columns == df.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {None, *range(10, 16)}


def test_registered(spark, sf):
    import __spark_entry__ as entry

    assert sorted(QUERIES) == sorted(n for n in entry.queries() if n.startswith("op")) and len(QUERIES) == 10
    assert "pipeline" in entry.queries() and ORACLES.keys() <= entry.oracle_sql().keys()
    assert entry.queries()["pipeline"](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    from oracle import check, connect

    sf = "/root/testdata/sf0.001"
    check(spark, sf, name, QUERIES[name], ORACLES[name], connect(sf))


def test_models_are_shared():
    assert piece.pieces(tokenizer_file(PIECE_MODEL)) is piece.pieces(tokenizer_file(PIECE_MODEL))
    assert minhash.THRESHOLD == 0.8 and minhash.SHINGLE == 5
