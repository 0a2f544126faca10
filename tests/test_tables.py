import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from epithet.operators import sentences
from epithet.params import POPULATION_TAXONOMY, Lexicon, taxonomy_frame
from epithet.sources import corpus, tables

LEX = Lexicon.of(["thai", "sri lankan"])


def write_gz(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    good = [json.dumps({"id": f"a{i}", "text": f"Thai word {i}.", "url": "x"}) for i in range(5)]
    write_gz(tmp_path / "c.00000.json.gz", [*good, "{broken", "not json"])
    write_gz(tmp_path / "c.00001.jsonl.gz", [json.dumps({"id": "b", "text": "Plain.", "source": "web"})])
    (tmp_path / "notes.txt").write_text("ignored")
    return tmp_path


def test_corpus_scan_skips_bad_lines_and_other_files(spark, folder):
    docs = corpus.read_corpus(spark, str(folder))
    assert sorted(r.doc_id for r in docs.collect()) == ["a0", "a1", "a2", "a3", "a4", "b"]
    assert docs.columns == ["doc_id", "text", "source"]
    spread = corpus.read_corpus(spark, str(folder), partitions=4)
    assert spread.count() == 6 and spread.rdd.getNumPartitions() == 4


@pytest.fixture
def damaged_folder(folder):
    """The folder with a file that is cut and one that is no gzip."""
    whole = gzip.compress("".join(json.dumps({"id": f"c{i}", "text": f"{i} " * 300}) + "\n" for i in range(4000)).encode())
    (folder / "c.00002.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "c 00003%41.json.gz").write_bytes(b"no gzip at all")
    return folder


def test_scan_says_what_it_lost(spark, damaged_folder):
    scan = corpus.scan_corpus(spark, str(damaged_folder))
    docs = scan.docs.collect()
    cut = {r.file.rsplit("/", 1)[1]: r for r in scan.cut().collect()}
    assert set(cut) == {"c.00002.jsonl.gz", "c%2000003%2541.json.gz"}
    assert 0 < cut["c.00002.jsonl.gz"].lines < 4000 and cut["c%2000003%2541.json.gz"].lines == 0
    from_cut = sum(r.doc_id.startswith("c") for r in docs)
    assert 0 < from_cut <= cut["c.00002.jsonl.gz"].lines
    # a line cut in the middle may be counted as broken
    broken = scan.broken.where(~F.col("file").contains("00002")).collect()
    assert sorted(r.line for r in broken) == ["not json", "{broken"]
    assert all(r.file.endswith("c.00000.json.gz") for r in broken)
    counts = scan.counts.get
    assert counts["lines"] == len(docs) + counts["broken"] and counts["broken"] in (2, 3)
    assert corpus.damaged(spark.createDataFrame([], "file string")).count() == 0


def test_read_corpora_unites_columns(spark, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    write_gz(other / "x00000.jsonl.gz", [json.dumps({"id": "z", "lang": "en"})])
    df = corpus.read_corpora(spark, [str(folder), str(other)])
    assert {"id", "text", "source", "lang"} <= set(df.columns) and df.count() == 2


def test_shards_tokens_and_csv(spark, tmp_path):
    docs = spark.range(25).select(
        F.col("id").alias("doc_id"), F.lit("Thai one. Sri Lankan two.").alias("text")
    ).coalesce(1)
    tables.write_shards(docs, str(tmp_path / "mixed"), records=10)
    files = sorted((tmp_path / "mixed").glob("*.json.gz"))
    assert len(files) == 3
    assert corpus.documents(spark.read.json(str(tmp_path / "mixed"))).count() == 25

    tables.write_tokens(sentences.document_tokens(docs, LEX), str(tmp_path / "tokens"))
    rows = spark.read.json(str(tmp_path / "tokens")).collect()
    assert len(rows) == 25 and rows[0].tokens == ["thai", "one", "sri_lankan", "two"]

    tables.export_csv(spark.createDataFrame([("a", 1.5)], "grp string, x double"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert list(csv.reader(part.open())) == [["grp", "x"], ["a", "1.5"]]


def test_replace_is_atomic(spark, tmp_path):
    root = str(tmp_path)
    tables.replace_table(spark.range(5), root, "t")
    reader = tables.read_table(spark, root, "t")

    def fail(batches):
        yield from batches
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        tables.replace_table(spark.range(9).mapInPandas(fail, "id bigint"), root, "t")
    assert tables.read_table(spark, root, "t").count() == 5
    # written but not yet current
    snapshot = tables.new_snapshot(spark, root, "t")
    spark.range(7).write.parquet(f"{root}/t/{snapshot}")
    assert tables.read_table(spark, root, "t").count() == 5
    tables.publish(spark, root, "t", snapshot)
    assert tables.read_table(spark, root, "t").count() == 7
    assert reader.count() == 5  # a reader that began before goes on with its snapshot
    tables.drop_old(spark, root, "t")
    assert tables.read_table(spark, root, "t").count() == 7 and len(tables.snapshots(spark, root, "t")) == 1
    assert len([p for p in (tmp_path / "t").iterdir() if not p.name.startswith((".", "_"))]) == 1
    # a table made from its own old rows
    again = tables.read_table(spark, root, "t")
    assert tables.replace_table(again.union(again), root, "t").count() == 14


def test_plain_folders_are_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert tables.read_table(spark, str(tmp_path), "plain").count() == 3


def test_replace_table(spark, tmp_path):
    root = str(tmp_path)
    tables.replace_table(spark.range(5), root, "t")
    assert tables.replace_table(spark.range(2), root, "t").count() == 2
    maps = spark.sql("SELECT 'a' AS grp, map('x', 2L) AS counter")
    assert tables.replace_table(maps, root, "m").first().counter == {"x": 2}


def test_census_labels(spark, tmp_path):
    names = ["GEO_ID", "NAME", "T_001N", "POPGROUP", "POPGROUP_LABEL", *[f"T_{i:03d}N" for i in range(2, 10)]]
    labels = ["Chinese, except Taiwanese alone", "Hmong alone or in any combination", "Other Asian alone",
              "Sri Lankan alone", "Japanese"]
    lines = [names, ["Geography", "Name", "Total", "Group", "Labels", *["x"] * 8]]
    lines += [["0100000US", "United States", "100", "37", label, *["7"] * 8] for label in labels]
    path = tmp_path / "census.csv"
    path.write_text("﻿" + "\n".join(",".join(f'"{v}"' for v in line) + "," for line in lines) + "\n")
    table = corpus.read_census(spark, str(path))
    assert table.count() == 5 and table.first().total == 100 and table.first().geo_id == "0100000US"
    terms = {r.term for r in corpus.census_terms(table).collect()}
    assert terms == {"chinese", "hmong", "sri lankan", "japanese"}
    lex = corpus.census_lexicon(table, taxonomy_frame(spark, POPULATION_TAXONOMY))
    assert {"sri_lankan", "hmong", "pacific_islander", "fijian"} <= {r.term for r in lex.terms.collect()}


def test_lexicon_files(spark, tmp_path):
    spark.createDataFrame([("Thai",)], "term string").write.parquet(str(tmp_path / "lex"))
    assert [r.term for r in corpus.read_lexicon(spark, str(tmp_path / "lex")).terms.collect()] == ["thai"]
    (tmp_path / "lex.csv").write_text("term\nSri Lankan\n")
    assert [r.term for r in corpus.read_lexicon(spark, str(tmp_path / "lex.csv")).terms.collect()] == ["sri_lankan"]
