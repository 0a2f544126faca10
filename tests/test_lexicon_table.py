import random

import pytest
from pyspark.sql import functions as F

from epithet.functions import rolling
from epithet.operators import counts, lexicon_table, rules, sentences, tagging
from epithet.operators.lexicon_table import LexiconTable
from epithet.params import Lexicon, local_frame
from epithet.plans import jobs

NAMES = ["thai", "sri lankan", "sri lankan tamil", "lankan", "new york city", "york", "born", "new", "x_y"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = "thai thais sri lankan tamil new york city born newborn x_y x y the of Thai-food Sri-Lankan LANKAN yorks walked rentable".split()
    rows = [
        (i, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!", ","]) for _ in range(rng.randint(0, 60))))
        for i in range(200)
    ]
    rows += [(500, None), (501, ""), (502, "ünï thai é. sri\x00lankan"), (503, "thai " * 3000), (7, "thai thai."), (None, "York born.")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def many(spark, n):
    """The nine terms among ``n`` others that no text holds, as a table."""
    others = spark.range(n).select(F.concat(F.lit("zq"), "id", F.when(F.col("id") % 3 == 0, " zzz").otherwise("")).alias("term"))
    return LexiconTable.of(local_frame(spark, [(t,) for t in NAMES], ("term",)).union(others))


def as_list(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return {n: many(spark, n) for n in (0, 1_000_000)}


@pytest.mark.parametrize("n", [0, 1_000_000])
def test_mention_sentences_equal_the_parameter_path(docs, tables, n):
    expected = sentences.mention_sentences(docs, Lexicon.of(NAMES))
    found = lexicon_table.mention_sentences(docs, tables[n])
    assert as_list(found) == as_list(expected.select(*found.columns)) != []


@pytest.mark.parametrize("n", [0, 1_000_000])
def test_substring_searches_equal_the_parameter_path(docs, tables, n):
    lex = Lexicon.of(NAMES)
    assert as_list(lexicon_table.keyword_sentences(docs, tables[n])) == as_list(sentences.keyword_sentences(docs, lex)) != []
    held = lexicon_table.find_examples(docs, tables[n]).where(~F.col("term").startswith("zq"))
    assert as_list(held) == as_list(tagging.find_examples(docs, lex))


def test_plans_hold_no_terms(docs, tables):
    """Nine terms and a million: the same plan but for the joins that the sizes ask for."""
    plans = {n: lexicon_table.mention_sentences(docs, t)._jdf.queryExecution().executedPlan().toString() for n, t in tables.items()}
    for plan in plans.values():
        assert "thai" not in plan and " IN (" not in plan and "INSET" not in plan
        assert "Join" in plan and "surface" in plan  # the optimizer picks the join from real sizes
    possible = lexicon_table._possible_runs(
        docs.select("doc_id", F.split("text", " ").alias("tokens")), tables[1_000_000].terms
    )._jdf.queryExecution().executedPlan().toString()
    # Every run is tested where its sentence is read: only the filter is exchanged.
    assert possible.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in possible


def test_filter_has_a_bound():
    assert lexicon_table._filter_words(9) == 4
    assert lexicon_table._filter_words(10**12) == lexicon_table.MAX_WORDS


def test_a_filter_too_small_loses_nothing(docs, tables, monkeypatch):
    monkeypatch.setattr(lexicon_table, "MAX_WORDS", 2)
    expected = sentences.mention_sentences(docs, Lexicon.of(NAMES))
    found = lexicon_table.mention_sentences(docs, tables[0])
    assert as_list(found) == as_list(expected.select(*found.columns))
    assert as_list(lexicon_table.keyword_sentences(docs, tables[0])) == as_list(sentences.keyword_sentences(docs, Lexicon.of(NAMES)))


def test_table_spelling(spark):
    table = LexiconTable.of(spark.createDataFrame([(t,) for t in (" Thai ", "thai", "Sri-Lankan", None, "", "chinese", "thais")], "term string"))
    rows = {r.surface: (r.grp, r.n_words, r.exact) for r in table.frame.collect()}
    assert rows == {
        "thai": ("thai", 1, True), "thais": ("thais", 1, True), "sri_lankan": ("sri_lankan", 2, True),
        "sri_lankans": ("sri_lankan", 2, False), "chinese": ("chinese", 1, True), "chineses": ("chinese", 1, False),
    }


def test_jobs_take_a_table(docs, tables):
    table, lex = tables[0], Lexicon.of(NAMES)
    by_table, by_parameter = (counts.modifier_rows(jobs.modifiers_of(docs, x, feed="window")) for x in (table, lex))
    assert as_list(by_table) == as_list(by_parameter) != []
    assert as_list(counts.clean_counts(by_table, table)) == as_list(counts.clean_counts(by_parameter, lex)) != []
    assert as_list(rules.window_modifiers(sentences.mention_sentences(docs, lex))) == as_list(
        rules.window_modifiers(sentences.mention_sentences(docs, lex), lex)
    )


@pytest.mark.parametrize("piece", [3, 64, 1 << 19])
def test_rolling_hashes_find_every_substring(monkeypatch, piece):
    import numpy as np

    monkeypatch.setattr(rolling, "PIECE", piece)
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc\xc3\x00") for _ in range(500))
    needles = {data[i : i + n] for i in (0, 7, 63, 200, 490) for n in (1, 3, 9)} | {b"zzz"}
    known = np.zeros(64, np.uint64)
    for x in needles:
        bit = rolling.whole_hash(x) % (64 * 64)
        known[bit >> 6] |= np.uint64(1 << (bit & 63))
    found = set(rolling.find(data, [1, 3, 9], known))
    every = {(i, len(x)) for x in needles for i in range(len(data)) if data.startswith(x, i)}
    assert every <= found and all(n in (1, 3, 9) and i + n <= len(data) for i, n in found)


def test_few_other_substrings_pass_the_filter(spark, docs):
    """What passes is written, sorted and joined: of a text without terms next to nothing may."""
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2000)) + ("thai" if i == 7 else "")) for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id bigint, low string")
    needles = many(spark, 0).terms.select(F.translate("term", "_", " ").alias("needle"))
    found = lexicon_table._with_substrings(df, "low", needles)
    passed = found.select(F.sum(F.size(F.flatten(F.transform("found", lambda f: f["runs"]))))).first()[0]
    assert 1 <= passed < 1000  # of about 700,000 substrings; one bit among 16 for each term let 18,725 pass


def test_filter_bits_are_those_that_find_asks_for():
    import numpy as np

    known = np.zeros(1 << 12, np.uint64)
    for bit in rolling.bits(rolling.whole_hash(b"thai"), 64 << 12):
        known[bit >> 6] |= np.uint64(1 << (bit & 63))
    assert list(rolling.find(b"a thai, thais", [4], known, twice=True)) == [(2, 4), (8, 4)]
