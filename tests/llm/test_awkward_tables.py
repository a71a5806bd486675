"""Every operator on null ids, repeated rows and columns that clash with its own names."""

from collections import Counter

import numpy as np
import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore " * 3
CLASH = "size target n component node fp k item_id score quality toxic label start rate v".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, LONG, "a", "p"), (None, None, None, None), (1, LONG, "a", "p"), (1, LONG, "a", "p"), (2, None, None, "p/q"), (3, "mail x@y.com now", "b", None), (4, LONG + "tail", "a", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, path string").selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(CLASH)])


ALL = Counter({None: 2, 1: 2, 2: 1, 3: 1, 4: 1})


def ids(df, name="doc_id"):
    return Counter(r[name] for r in df.select(name).collect())


def test_row_for_row(spark, docs):
    import public_tokenizers

    from waveloom.llm import licenses, mixing, pii, quality, simhash, tokens, toxicity

    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (4, 0, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for got in (pii.sanitised(docs), licenses.scanned(docs), tokens.round_trip(docs, path), simhash.near_duplicates(docs), quality.scored(docs, marks), toxicity.scored(docs, marks), mixing.mixed(docs)):
        assert ids(got) == ALL
    # columns of the user's by the operators' names keep their values in the mix and in what the stages keep
    own = {tuple(r) for r in docs.collect()}
    for kept in (mixing.emitted(docs), quality.accepted(docs, marks, threshold=0.0), simhash.first_of_groups(docs)):
        assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= own
    assert ids(simhash.first_of_groups(docs)) == Counter([1, 2, 3])  # 4 differs from 1 by few bits
    assert all(r["held_out"] is not None for r in docs.select(quality.held_out(docs["doc_id"]).alias("held_out")).collect())


def test_rows_without_id_take_no_part(spark, docs):
    from waveloom.llm import decontam, suffix

    items = spark.createDataFrame([(1, LONG), (None, LONG), (2, None), (2, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()} == {(1, 1), (4, 1)}
    assert ids(decontam.clean(docs, items)) == Counter({None: 2, 2: 1, 3: 1})
    got = {(r["doc_id"], r["n_removed"]) for r in suffix.repeated(docs).collect()}
    assert got == {(None, 0), (1, 0), (2, 0), (3, 0), (4, len(LONG))}
    assert ids(suffix.repeated(docs)) == ALL


def test_vectors(spark):
    from waveloom.llm.embeddings import near_duplicates

    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, 0.01])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as block", "3 as component_id", "4 as n_links", "5 as label")
    got = near_duplicates(vectors)
    assert ids(got, "vec_id") == Counter({None: 1, 1: 2, 2: 1, 3: 1})
    assert {r["vec_id"]: r["n_links"] for r in got.collect()}[2] == 0


def test_rows_without_id_that_stand_alone_or_link_others(spark):
    from waveloom.llm import embeddings, simhash

    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (None, "quite another text of nine words in all here"), (5, " ".join(words[:59])), (7, " ".join(words[1:]))]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=30).collect()}
    assert {(None, 5), (5, 5), (7, 5)} <= got
    alone = simhash.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in alone] == [None, None]
    at = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(None, at(0.4)), (3, at(0.0)), (2, at(0.8)), (None, at(2.5))]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(None, 2, 2, False), (3, 1, 2, False), (2, 1, 2, True), (None, 0, None, True)], key=repr)


def test_labelled_rows_do_not_grow_with_repeats(spark):
    from waveloom.llm.quality import labelled

    docs = spark.createDataFrame([(2, "a b c")] * 50 + [(3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(2, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert {(r["doc_id"], r["text"], r["y"]) for r in labelled(docs, marks, "quality", 10).collect()} <= {(2, "a b c", 1), (3, None, 1)}
    assert labelled(docs, marks, "quality", 10).count() <= 2


def test_scratch_tables_go_with_their_scope(spark):
    from pathlib import Path

    from waveloom.llm import common

    with common.scratch(spark):
        path = common.written(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_columns_of_any_name(spark, docs):
    import corpus_pipeline
    from waveloom.llm import decontam, mixing, quality, simhash

    odd = docs.drop("size").selectExpr("*", "doc_id as `x.y`", "source as Size", "text as TEXT2", "1 as `a``b`", "2 as `row.text`", "3 as At")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "quite another text of nine words in all here")], "item_id long, text string")
    own = Counter(map(tuple, odd.collect()))
    for got in (mixing.emitted(odd), quality.accepted(odd, marks, threshold=0.0), simhash.first_of_groups(odd), decontam.clean(odd, items)):
        assert got.columns == odd.columns and set(map(tuple, got.collect())) <= set(own)
    assert Counter(map(tuple, quality.accepted(odd, marks, threshold=0.0).collect())) == own == Counter(map(tuple, decontam.clean(odd, items).collect()))
    scored = quality.scored(odd, marks)
    assert scored.columns == [*odd.columns, "quality_score", "quality_pred"] and Counter(map(tuple, scored.select(*[f"`{c.replace('`', '``')}`" for c in odd.columns]).collect())) == own
    mixed = mixing.mixed(odd)
    assert "Size" not in mixed.columns and mixed.columns[-4:] == ["size", "source_size", "target", "copies"] and {(r["doc_id"], r["x.y"]) for r in mixed.collect()} == {(r["doc_id"], r["x.y"]) for r in odd.collect()}
    kept = odd
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == odd.columns and set(map(tuple, kept.collect())) <= set(own), name


def test_stages_on_empty_and_very_long_texts(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "", "a"), (3, None, None), (4, "y" * 1_000_000, "b")], "doc_id long, text string, source string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[1:]:
            kept = stage(spark, kept, "/root/testdata/sf0.001")
            rows = kept.collect()
            assert len(rows) <= 12 and (table is docs or not rows), name
        assert table is not docs or {1} <= {r["doc_id"] for r in rows}


def test_other_versions_encode_whole_texts(monkeypatch):
    import public_tokenizers

    from waveloom.llm import tokens

    texts = ["Some words, 12 of them  and\n more. ", None, "", "don't   stop", "x" * 50]
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = tokens.PieceEncoder(path)
    monkeypatch.setitem(tokens.VERSIONS, "regex", "1.0")
    other = tokens.PieceEncoder(path)
    assert known.plain and not other.plain
    for a, b in zip(known.encode(texts, 0), other.encode(texts, 0), strict=True):
        assert a.tolist() == b.tolist()
