import gzip
import json

import pytest
from pyspark.sql import functions as F

from epithet.operators import annotate, classify, counts, rules, sentences
from epithet.params import TEST_LEXICON, TEST_TAXONOMY, Lexicon
from epithet.plans import jobs
from epithet.streaming import incremental

LEX = TEST_LEXICON
WORDS = "thon than ther erin eriner thanea lovely rentable walked running bold cat dog of the".split()


def make_docs(n):
    """Small deterministic texts built from a few words."""
    out = []
    for i in range(n):
        words = [WORDS[(i * 7 + j * j * 3 + j) % len(WORDS)] for j in range(40)]
        cuts = [" ".join(words[k : k + 8]) for k in range(0, 40, 8)]
        out.append((f"d{i}", ". ".join(cuts)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(60), "doc_id string, text string").cache()


def as_set(df):
    cols = sorted(df.columns)
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


def window_rows(df):
    return counts.modifier_rows(jobs.modifiers_of(df, LEX, feed="window"))


def test_order_and_partitioning_do_not_matter(spark, docs):
    shuffled = docs.orderBy(F.rand(3)).repartition(7)
    for options in ({"feed": "window"}, {"annotator": annotate.surface_annotate}):
        first, second = (counts.modifier_rows(jobs.modifiers_of(d, LEX, **options)) for d in (docs, shuffled))
        assert as_set(first) == as_set(second) != []


def test_counts_add_up_to_units(docs):
    units = jobs.modifiers_of(docs, LEX, feed="window").where(F.size("verbs") + F.size("adjs") > 0)
    assert window_rows(docs).agg(F.sum("cnt")).first()[0] == units.count()


def test_unknown_feed(docs):
    with pytest.raises(ValueError):
        jobs.modifiers_of(docs, LEX, feed="other")


def test_syntactic_feed_needs_an_annotator(docs):
    with pytest.raises(ValueError, match="annotator"):
        jobs.modifiers_of(docs, LEX)


def test_hand_parses_through_the_job(spark, tmp_path):
    """The hand-parsed sentences as a token table: extraction gives the modifiers they should."""
    from test_rules import GROUPS, parses

    sents, tokens, expected = [], [], {}
    for name, wanted, toks in parses():
        # a document of one sentence, spelled so that splitting and tokenising leave its words alone
        sents.append((name, " ".join(t[1] for t in toks if t[1].isalnum())))
        tokens += [(name, 0, *t) for t in toks]
        expected[name] = wanted
    rows = spark.createDataFrame(
        tokens, "doc_id string, sent_id bigint, i int, text string, lemma string, pos string, tag string, dep string, head int, ent string"
    )
    table = annotate.write_token_table(rows, "hand_parses", 4, str(tmp_path / "tokens"))
    docs = spark.createDataFrame(sents, "doc_id string, text string")
    study = jobs.Study(root=str(tmp_path / "study"), lexicon=GROUPS)
    found = jobs.modifiers_of(docs, GROUPS, annotator=annotate.token_table_annotate(table))
    got = {r.doc_id: [r.nouns, r.verbs, r.adjs] for r in found.collect()}
    compared = {name: w for name, w in expected.items() if name in got}
    assert len(compared) >= 10 and got == compared
    stored = jobs.extract(docs, study, annotator=annotate.token_table_annotate(table))
    assert stored.agg(F.sum("cnt")).first()[0] == sum(1 for w in got.values() if w[1] or w[2])


def test_token_table_is_read_as_it_lies(spark, tmp_path):
    tokens = spark.range(4000).selectExpr(
        "concat('d', id % 50) AS doc_id", "id div 1000 AS sent_id", "cast(id % 1000 div 50 AS int) AS i", "'thon' AS text",
        "'thon' AS lemma", "'NOUN' AS pos", "'NN' AS tag", "'dep' AS dep", "0 AS head", "'' AS ent",
    )
    table = annotate.write_token_table(tokens, "tokens_by_sentence", 4, str(tmp_path / "tokens"))
    sents = annotate.parsed_sentences(table, LEX)
    assert sents.count() == 200 and sents.select(F.size("toks")).distinct().collect()[0][0] == 20
    parsed = annotate.token_table_annotate(table)(spark.range(0).selectExpr("'a' AS doc_id", "id AS sent_id"))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan parquet spark_catalog.default.tokens_by_sentence")
    between = [line for line in plan[:scan].splitlines() if "Exchange" in line]
    # at most the sentences move, and they come before the tokens' side of the join
    side = plan[:scan].rsplit("Join", 1)[1].splitlines()
    aggregate = next(i for i, line in enumerate(side) if "Aggregate" in line)
    assert not [line for line in side[aggregate:] if "Exchange" in line], between


def test_document_frequency_counts_a_document_once(docs):
    terms = rules.modifier_terms(jobs.modifiers_of(docs, LEX, feed="window"))
    most = counts.document_frequency(terms).agg(F.max("cnt")).first()[0]
    assert most <= docs.count()
    assert counts.document_frequency(terms.union(terms)).agg(F.max("cnt")).first()[0] == most


def test_all_stages(spark, docs, tmp_path):
    study = jobs.Study(
        root=str(tmp_path), lexicon=LEX, taxonomy=TEST_TAXONOMY, category="alpha",
        poses=("adj", "verb", "noun"), min_count=1,
    )
    jobs.extract(docs, study, feed="window")
    cleaned = jobs.clean(spark, study)
    assert {"category", "region"} <= set(cleaned.columns)
    top = jobs.log_odds(spark, study)
    assert top.count() > 0
    texts = top.select(F.col("term").alias("text")).union(
        spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "text string")
    )
    value = [F.pmod(F.hash("text", F.lit(i)), F.lit(97)).cast("float") for i in range(4)]
    jobs.compare(spark, study, texts.distinct().withColumn("vector", F.array(*value)))
    for name in ("sim_vals", "region_stats", "contrast_vals", "alignment_contrast", "category_boxes"):
        assert study.table(spark, name).count() > 0, name
    assert spark.read.option("header", True).csv(str(tmp_path / "top5_csv")).count() > 0


def test_classifier_filters_sentences(spark, docs):
    windows = sentences.masked_window(sentences.mention_sentences(docs, LEX))
    labelled = windows.withColumn("label", F.contains("window_text", F.lit("lovely")).cast("double"))
    model = classify.fit_windows(labelled)
    classified = classify.classify_windows(windows, model)
    passed = classify.pass_counts(classified).agg(F.sum("n_mentions"), F.sum("n_accepted")).first()
    assert passed[0] == windows.count() and 0 < passed[1] < passed[0]
    right = classified.where(F.col("prediction") == F.contains("window_text", F.lit("lovely")).cast("int"))
    assert right.count() > 0.9 * passed[0]
    fewer = jobs.modifiers_of(docs, LEX, feed="window", model=model)
    assert 0 < fewer.count() < jobs.modifiers_of(docs, LEX, feed="window").count()


def write_files(folder, rows, parts, start=0):
    for k in range(parts):
        with gzip.open(folder / f"part-{start + k:05d}.jsonl.gz", "wt") as f:
            for doc_id, text in rows[k::parts]:
                f.write(json.dumps({"id": doc_id, "text": text}) + "\n")


def run_stream(spark, source, root, checkpoint, max_files=1):
    query = incremental.run_incremental(
        incremental.stream_corpus(spark, str(source), max_files=max_files),
        str(root),
        str(checkpoint),
        lambda d: jobs.modifiers_of(d, LEX, feed="window"),
    )
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("parts", [2, 5])
def test_stream_equals_batch_and_resumes(spark, docs, tmp_path, parts):
    source, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    source.mkdir()
    rows = make_docs(60)
    write_files(source, rows[:40], parts)
    run_stream(spark, source, root, checkpoint)
    first = incremental.progress(spark, str(root))
    assert first.count() == parts and first.agg(F.sum("docs_seen")).first()[0] == 40
    # nothing new: a restart adds nothing
    run_stream(spark, source, root, checkpoint)
    assert incremental.progress(spark, str(root)).agg(F.sum("docs_seen")).first()[0] == 40
    # new files continue from the checkpoint
    write_files(source, rows[40:], 1, start=parts)
    run_stream(spark, source, root, checkpoint)
    assert incremental.progress(spark, str(root)).agg(F.sum("docs_seen")).first()[0] == 60
    assert as_set(incremental.modifier_totals(spark, str(root))) == as_set(window_rows(docs))


def test_retried_batch_replaces_its_partials(spark, docs, tmp_path):
    def extract(d):
        return jobs.modifiers_of(d, LEX, feed="window")

    for _ in range(2):
        incremental.write_batch(docs, 0, str(tmp_path), extract)
    assert as_set(incremental.modifier_totals(spark, str(tmp_path))) == as_set(window_rows(docs))
    assert incremental.progress(spark, str(tmp_path)).collect()[0].docs_seen == 60


def as_totals(spark, root):
    return as_set(incremental.modifier_totals(spark, str(root)))


def test_compaction_counts_every_batch_once(spark, docs, tmp_path, monkeypatch):
    def extract(d):
        return jobs.modifiers_of(d, LEX, feed="window")

    root, parts = str(tmp_path), docs.randomSplit([1.0] * 4, seed=3)
    for i, part in enumerate(parts[:3]):
        incremental.write_batch(part, i, root, extract)
    before = as_totals(spark, root)
    # a crash after the base is written, before it is current: nothing has changed
    monkeypatch.setattr(incremental.tables, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        incremental.compact(spark, root)
    monkeypatch.undo()
    assert as_totals(spark, root) == before
    # a crash after it is current, before the partials are removed: still counted once
    monkeypatch.setattr(incremental.tables, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        incremental.compact(spark, root)
    monkeypatch.undo()
    assert as_totals(spark, root) == before
    # a retried batch that the base counts already is ignored
    incremental.write_batch(parts[2], 2, root, extract)
    assert as_totals(spark, root) == before
    assert incremental.compact(spark, root) == 2 and as_totals(spark, root) == before
    assert not list((tmp_path / incremental.PARTIALS).glob("batch_id=*"))
    incremental.write_batch(parts[3], 3, root, extract)
    assert as_totals(spark, root) == as_set(window_rows(docs))
    assert incremental.compact(spark, root) == 3 and incremental.compact(spark, root) == 3
    assert as_totals(spark, root) == as_set(window_rows(docs))
    plan = incremental.modifier_totals(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # the base alone, however many batches there were


def test_stream_accounts_for_losses(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    source.mkdir()
    write_files(source, make_docs(20), 1)
    with gzip.open(source / "part-00001.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "x", "text": "thon walked."}) + "\n{broken\n\nno json\n")
    whole = gzip.compress(("".join(json.dumps({"id": f"c{i}", "text": f"{i} " * 300}) + "\n" for i in range(4000))).encode())
    (source / "part-00002.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    run_stream(spark, source, root, checkpoint, max_files=2)
    done = incremental.progress(spark, str(root))
    lost = spark.read.parquet(str(root / incremental.LOST)).where(~F.col("file").contains("00002"))
    assert sorted(r.line for r in lost.collect()) == ["no json", "{broken"]
    assert done.agg(F.sum("lines_lost")).first()[0] in (2, 3)
    (cut,) = spark.read.parquet(str(root / incremental.CUT)).collect()
    assert cut.file.endswith("part-00002.jsonl.gz") and 0 < cut.lines < 4000
    assert done.agg(F.sum("docs_seen")).first()[0] >= 21


def test_hot_group_spreads(spark):
    """A group holding most mentions is aggregated per term, and nothing is lost."""
    rows = [(i, f"thon walked w{100 + i % 500} rentable") for i in range(3000)] + [(9999, "ther walked bold")]
    hot = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = counts.clean_counts(window_rows(hot), Lexicon.of(["thon", "ther"]))
    totals = {r.grp: r.n for r in table.groupBy("grp").agg(F.sum("cnt").alias("n")).collect()}
    assert totals == {"thon": 9000, "ther": 2}
