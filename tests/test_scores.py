import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epithet.functions.quantiles import exact_quantiles
from epithet.functions.student_t import _log_tail, log_p_value, p_text
from epithet.functions.vectors import has_direction, mean_pool
from epithet.operators import counts, logodds, similarity, stats
from epithet.params import Lexicon, taxonomy_frame
from epithet.plans.stages import settle

COUNTS = "grp string, pos string, term string, cnt bigint"


def random_counts(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in "abcd":
        for pos in ("adj", "verb"):
            for t in rng.sample(range(60), 40):
                rows.append((g, pos, f"t{t}", int(rng.paretovariate(0.8))))
    return rows


def brute_log_odds(rows, background="all", alpha=0.01, min_count=5):
    per = defaultdict(Counter)
    everything = defaultdict(Counter)
    for g, pos, t, c in rows:
        per[g, pos][t] += c
        everything[pos][t] += c
    out = {}
    for (g, pos), own in per.items():
        base = Counter(everything[pos])
        if background == "rest":
            base.subtract(own)
        n, n_bg = sum(own.values()), sum(base.values())
        prior_total = alpha * n_bg
        for t, c in own.items():
            if c < min_count:
                continue
            a = alpha * base[t]
            p, q = (c + a) / (n + prior_total), (base[t] + a) / (n_bg + prior_total)
            if not (0 < p < 1 and 0 < q < 1):
                out[g, pos, t] = None
                continue
            delta = math.log(p / (1 - p)) - math.log(q / (1 - q))
            out[g, pos, t] = delta / math.sqrt(1 / (c + a) + 1 / (base[t] + a))
    return out


@pytest.mark.parametrize("background", ["all", "rest"])
def test_weighted_log_odds(spark, background):
    rows = random_counts()
    df = spark.createDataFrame(rows, COUNTS).repartition(5)
    got = {(r.grp, r.pos, r.term): r.score for r in logodds.weighted_log_odds(df, background=background).collect()}
    expected = brute_log_odds(rows, background)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9)


def test_log_odds_ignores_group_names(spark):
    rows = random_counts(2)
    renamed = [("zz" + g, p, t, c) for g, p, t, c in rows]
    scores = [
        sorted(r.score for r in logodds.weighted_log_odds(spark.createDataFrame(x, COUNTS)).collect())
        for x in (rows, renamed)
    ]
    assert scores[0] == pytest.approx(scores[1])


def test_single_term_vocabulary_has_no_score(spark):
    df = spark.createDataFrame([("a", "adj", "only", 9)], COUNTS)
    assert [r.score for r in logodds.weighted_log_odds(df).collect()] == [None]
    assert logodds.top_terms(logodds.weighted_log_odds(df)).collect() == []


def test_top_terms_median_gate(spark):
    schema = "grp string, pos string, term string, cnt bigint, score double"
    rows = [("a", "adj", f"t{i}", 5, s) for i, s in enumerate([3.0, 1.0, 2.0, -1.0, 4.0])]
    rows += [("b", "adj", "n", 5, -2.0), ("c", "adj", "z", 5, 0.0)]
    got = [(r.grp, r.term, r["rank"]) for r in logodds.top_terms(spark.createDataFrame(rows, schema), 2).collect()]
    # gate of a is 2.5; b has no positive score and nothing >= 0; c's zero passes the zero gate
    assert sorted(got) == [("a", "t0", 2), ("a", "t4", 1), ("c", "z", 1)]


def test_joint_top_strings(spark):
    schema = "grp string, pos string, term string, cnt bigint, score double"
    rows = [("a", "adj", "x", 5, 1.0), ("a", "verb", "y", 5, 2.0), ("a", "verb", "z", 5, None)]
    (row,) = logodds.joint_top(spark.createDataFrame(rows, schema)).collect()
    assert (row.top_terms, row.top_pos, row.top_scores) == ("y, x", "verb, adj", "2.000, 1.000")


def test_two_sided_log_odds(spark):
    one, two = Counter(a=30, b=5, c=1), Counter(a=3, b=20, d=7)
    frames = [
        spark.createDataFrame([("noun", t, c) for t, c in x.items()], "pos string, term string, cnt bigint")
        for x in (one, two)
    ]
    scored = logodds.two_sided_log_odds(logodds.corpus_pairs(*frames))
    vocab = set(one) | set(two)
    mass = 0.01 * len(vocab)
    n1, n2 = sum(one.values()), sum(two.values())
    for r in scored.collect():
        c1, c2 = one[r.term] + 0.01, two[r.term] + 0.01
        delta = math.log(c1 / (n1 + mass - c1)) - math.log(c2 / (n2 + mass - c2))
        assert r.score == pytest.approx(delta / math.sqrt(1 / c1 + 1 / c2))
    ends = logodds.both_ends(scored, 1).collect()
    assert [(r.side, r.term) for r in sorted(ends, key=lambda r: r.side)] == [(1, "a"), (2, "b")]


def test_vocabulary_is_not_dealt_out_by_pos(spark):
    """Whatever its size: only the best terms of each task reach the few tasks that rank a pos."""
    terms = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "verb").otherwise("noun").alias("pos"),
        F.sha2(F.col("id").cast("string"), 256).alias("term"),
        (F.col("id") % 7).alias("c1"),
        (F.col("id") % 5).alias("c2"),
    )
    pairs, key = settle(terms), "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(key, "20k")
        scored = logodds.two_sided_log_odds(pairs)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert scored.count() == 20_000
    finally:
        spark.conf.unset(key)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_missing_target_group_is_an_error(spark):
    df = spark.createDataFrame(random_counts(), COUNTS)
    with pytest.raises(ValueError, match="nobody"):
        logodds.target_pairs(df, ["a", "nobody"])
    pairs = logodds.target_pairs(df, ["a", "b"])
    total = pairs.agg(F.sum(F.col("c1") + F.col("c2"))).first()[0]
    assert total == df.agg(F.sum("cnt")).first()[0]


@pytest.mark.parametrize("buckets", [2, 7, 128])
def test_exact_quantiles(spark, buckets):
    rng = np.random.default_rng(0)
    data = {
        "hot": rng.normal(size=5000),
        "ties": rng.integers(0, 4, 301).astype(float),
        "same": np.full(10, 2.5),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("hot", None), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, buckets).collect()}
    assert got.keys() == data.keys()
    for k, values in data.items():
        assert got[k].n == len(values)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_of_a_large_key_refine_their_range(spark):
    """One key with most rows: ranges narrow until a window ranks few values, and nothing is lost."""
    rows = spark.range(200_000).selectExpr("if(id < 199000, 'hot', concat('k', id % 7)) AS k", "cast(pmod(id * 7919, 200003) AS double) AS v")
    probs = {"low": 0.001, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 0.9999}
    got = {r.k: r for r in exact_quantiles(rows, ["k"], "v", probs, buckets=8, few=50).collect()}
    data = {}
    for r in rows.collect():
        data.setdefault(r.k, []).append(r.v)
    assert got.keys() == data.keys()
    for k, values in data.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_contrast_equals_comparing_each_pair(spark):
    rng = np.random.default_rng(1)
    vec = lambda: [float(x) for x in rng.normal(size=5)]
    groups = [(f"g{i}", pos, vec()) for i in range(6) for pos in ("adj", "verb")] + [("g6", "adj", [0.0] * 5), ("g7", "adj", vec())]
    cats = [(f"c{i}", pos, vec()) for i in range(3) for pos in ("adj", "verb")] + [("c3", "adj", [0.0] * 5)]
    members = [(f"g{i}", f"c{i % 4}") for i in range(7)] + [("g7", "none")]
    out = similarity.category_contrast(
        spark.createDataFrame(groups, "grp string, pos string, vector array<double>"),
        spark.createDataFrame(cats, "category string, pos string, vector array<double>"),
        spark.createDataFrame(members, "grp string, category string"),
        salts=3,
    )
    own, known = dict(members), {(c, p) for c, p, _ in cats}
    expected = {}
    for g, pos, a in groups:
        for c, p, b in cats:
            if p == pos and (own[g], pos) in known and any(a) and any(b):
                cos = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
                expected[g, c, "own" if c == own[g] else "other", pos] = cos
    got = {(r.grp, r.category, r.category_type, r.pos): r.cosine_sim for r in out.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_student_t_closed_forms(spark):
    cases = [(1.0, 1, 0.5), (math.sqrt(2), 2, 1 - math.sqrt(2) / 2), (0.0, 5, 1.0)]
    cases += [(t, 1, 1 - 2 / math.pi * math.atan(t)) for t in (0.1, 3.0, 50.0)]
    cases += [(t, 2, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 1.0, 40.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in cases], "t double, df int")
    got = [math.exp(r.lp) for r in df.select(log_p_value(F.col("t"), F.col("df")).alias("lp")).collect()]
    assert got == pytest.approx([p for *_, p in cases], rel=1e-9)
    assert _log_tail(1.96, 1e7) == pytest.approx(math.log(0.0499958), rel=1e-4)
    assert _log_tail(100.0, 1000) < -700
    for df in (1e12, 1e13, 1e15):  # the normal limit
        for t in (0.5, 2.0, 6.0):
            assert _log_tail(t, df) == pytest.approx(math.log(math.erfc(t / math.sqrt(2))), rel=1e-8)
    empty = spark.createDataFrame([(None, 3), (1.0, 0)], "t double, df int")
    assert [r[0] for r in empty.select(log_p_value(F.col("t"), F.col("df"))).collect()] == [None, None]


def test_p_text(spark):
    df = spark.createDataFrame([(math.log(0.0123),), (-math.inf,), (-5000.0,), (None,)], "lp double")
    got = [r[0] for r in df.select(p_text(F.col("lp"))).collect()]
    assert got[0] == "1.23e-2" and got[1] == "< 1e-300" and got[2].endswith("e-2172") and got[3] is None


def test_cosine_and_mean(spark):
    df = spark.createDataFrame(
        [("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("y", [0.0, 0.0])], "k string, vector array<float>"
    )
    pooled = {r.k: r.vector for r in mean_pool(df, ["k"], "vector").collect()}
    assert pooled == {"x": [0.5, 0.5], "y": [0.0, 0.0]}
    sims = similarity.cosine_to(df, mean_pool(df, ["k"], "vector"), "k").collect()
    assert [r.cosine_sim for r in sims] == pytest.approx([math.sqrt(0.5)] * 2)
    assert df.where(has_direction(F.col("vector"))).count() == 2


def contrast_frame(spark):
    rows = [
        ("g", "a", "own", "adj", 0.9), ("g", "b", "other", "adj", 0.2), ("g", "c", "other", "adj", 0.4),
        ("h", "a", "own", "adj", 0.7), ("h", "b", "other", "adj", 0.1), ("h", "c", "other", "adj", 0.1),
        ("i", "b", "own", "adj", 0.5),
    ]
    return spark.createDataFrame(
        rows, "grp string, category string, category_type string, pos string, cosine_sim double"
    )


def test_contrast_tests(spark):
    got = {r.grp: r for r in stats.category_contrast_stats(contrast_frame(spark)).collect()}
    assert got.keys() == {"g", "h"}
    diffs = np.array([0.7, 0.5])
    assert got["g"].t_stat == pytest.approx(diffs.mean() / (diffs.std(ddof=1) / math.sqrt(2)))
    assert got["h"].t_stat is None
    rows = stats.alignment_contrast(contrast_frame(spark)).collect()
    values = np.array([0.9 - 0.3, 0.7 - 0.1])
    assert sorted(r["diff"] for r in rows) == pytest.approx(sorted(values))
    assert {r.n for r in rows} == {2} and {r.own_category for r in rows} == {"a"}


def test_region_reports(spark):
    rows = [("g", "r", "adj", 0.1), ("g", "r", "adj", 0.3), ("h", "r", "adj", 0.5), ("k", None, "adj", 9.0),
            ("l", "s", "adj", 0.4), ("g", "r", "adj", None)]
    regional = spark.createDataFrame(rows, "grp string, region string, pos string, cosine_sim double")
    got = {r.region: r for r in stats.region_stats(regional).collect()}
    x = np.array([0.1, 0.3, 0.5])
    assert got["r"].n == 3 and got["r"].b == 0.3 and got["r"].d == round(x.mean() / x.std(ddof=1), 3)
    assert got["s"].t is None and got["s"].p_text is None
    summary = stats.group_summary(regional)
    assert {(r.grp, r.n_terms) for r in summary.collect()} == {("g", 2), ("h", 1), ("l", 1)}
    assert {r.region: r.n for r in stats.region_group_stats(summary).collect()} == {"r": 2}
    assert [r.n for r in stats.global_group_stats(summary).collect()] == [3]
    order = [(r.grp) for r in stats.group_order(regional.where("region = 'r'")).collect()]
    assert order == ["h", "g"]


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, cosine_sim double")
    (r,) = stats.boxplot_table(df, ["k"]).collect()
    assert (r.n, r.q1, r.median, r.q3) == (5, 2.0, 3.0, 4.0)
    assert (r.whisker_low, r.whisker_high, r.n_outliers) == (1.0, 4.0, 1)


def test_modifier_upsert(spark):
    schema = "doc_id int, sent_id int, grp string, nouns array<string>, verbs array<string>, adjs array<string>"
    unit = ("chinese", ["people"], ["find", "win"], ["cool"])
    rows = [(1, 0, *unit), (2, 0, *unit), (3, 0, "thai", [], ["go"], []), (4, 0, "thai", ["x"], [], [])]
    table = counts.modifier_rows(spark.createDataFrame(rows, schema))
    got = {r.grp: (r.cnt, r.has_dup) for r in table.collect()}
    assert got == {"chinese": (2, True), "thai": (1, False)}
    twice = counts.merge_modifier_rows(table, table)
    assert {r.grp: (r.cnt, r.has_dup) for r in twice.collect()} == {"chinese": (4, True), "thai": (2, True)}


def test_clean_counts_and_maps(spark):
    lex = Lexicon.of(["chinese", "thai"])
    rows = spark.createDataFrame(
        [("asian_indian", ["lovely", "ok"], ["eat"], ["asian"], 3), ("indian", ["lovely"], [], ["kid"], 2)],
        "grp string, adjs array<string>, verbs array<string>, nouns array<string>, cnt bigint",
    )
    cleaned = counts.clean_counts(rows, lex)
    got = {(r.pos, r.term): r.cnt for r in cleaned.collect()}
    assert got == {("adj", "lovely"): 5, ("verb", "eat"): 3, ("noun", "asian"): 3, ("noun", "kid"): 2}
    maps = counts.counter_maps(cleaned, shards=2)
    back = {(r.pos, r.term): r.cnt for r in counts.counter_rows(maps).collect()}
    assert back == got
    through = counts.parse_text_rows(counts.as_text_rows(rows))
    assert {r.grp for r in through.collect()} == {"indian"}
    sizes = {(r.grp, r.pos): r.n_terms for r in counts.vocabulary_sizes(cleaned).collect()}
    assert sizes["*", "noun"] == 2 and sizes["indian", "adj"] == 1


def test_taxonomy_lookup(spark):
    from epithet.params import POPULATION_TAXONOMY

    tax = taxonomy_frame(spark, POPULATION_TAXONOMY)
    df = spark.createDataFrame([("indian",), ("south asian",), ("asian",), ("unknown",)], "grp string")
    got = {r.grp: (r.category, r.region) for r in counts.with_taxonomy(df, tax).collect()}
    assert got == {
        "indian": ("asian", "south asian"), "south asian": ("asian", None),
        "asian": (None, None), "unknown": (None, None),
    }
