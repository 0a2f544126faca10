import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from epithet.llm import queries
from epithet.llm.byte_bpe import ByteBpe

from .conftest import ODD, prose

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_statement(spark, name):
    assert compare(name, queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.oracle_sql()[name]) == ""


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) < set(names) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_ranker", "near_duplicates", "mixing", "byte_bpe"
    ]


@pytest.fixture(scope="module")
def folder(make_docs, spark, tmp_path_factory):
    """Documents of which the right result is known: (rows, path)."""
    good = {i: prose(i, 90 + i) for i in range(60)}
    junk = {100 + i: prose(i, 150).upper().replace(" ", "!! ") for i in range(20)}
    near = {200 + i: good[i] + "\nOne more line here." for i in range(0, 60, 6)}
    copies = {300 + i: good[7] for i in range(5)}
    odd = {400 + i: t for i, t in enumerate(ODD)}
    rows = [(i, t, f"s{i % 3}") for part in (good, junk, near, copies, odd) for i, t in part.items()]
    path = tmp_path_factory.mktemp("tables")
    make_docs(rows).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return good, str(path)


def test_stages_one_by_one(spark, folder, tmp_path):
    good, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, path)
        assert name == "byte_bpe" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    rules, ranker, alone, mixed, encoded = seen
    clean = set(good) | {200 + i for i in range(0, 60, 6)} | {300 + i for i in range(5)}
    assert clean <= set(rules) and not set(rules) & set(range(100, 120))
    assert clean <= set(ranker) <= set(rules)
    # one of each group stays, the one with the smallest id
    assert set(good) <= set(alone) and not set(alone) & set(range(200, 305))
    assert set(mixed) <= set(alone) and max(map(mixed.count, set(mixed))) <= 2
    assert encoded == mixed
    bpe = ByteBpe.load()
    for r in docs.collect():
        if r.doc_id in good:
            assert bpe.decode(r.ids) == good[r.doc_id].encode() and r.n_tokens == len(r.ids)


def test_run_gives_the_stages_rows(spark, folder):
    _, path = folder
    first, second = (
        sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2)
    )
    assert first and first == second


def test_stages_on_empty_tables(spark, folder):
    _, path = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, path).count() == 0
