from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epithet.llm import mixing

from .conftest import ODD, prose


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight, the excess above the cap given to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    open_, left, out = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > most * sizes[n]}
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = most * sizes[n]
        left -= sum(out[n] for n in over)
        open_ -= over
    return out


def rows():
    out = [(i, prose(i, 20 + i % 37), f"src{i % 4}") for i in range(400)]
    out += [(1000 + i, t, None) for i, t in enumerate([*ODD, prose(1, 60)])]
    out += [(2000 + i, prose(i, 30), "z big") for i in range(900)]
    return out + [(3000, "", "empty source"), (3001, None, "empty source")]


@pytest.fixture(scope="module")
def report(make_docs):
    docs = make_docs(rows(), ["1 AS size", "2 AS target", "3 AS passes", "4 AS shards"])
    return {r.doc_id: r for r in mixing.mixing_report(docs).collect()}


def test_targets_and_taken(report):
    size = {i: len((t or "").encode().split()) for i, t, _ in rows()}
    by_source = defaultdict(int)
    for i, _, s in rows():
        by_source[s] += size[i]
    wanted, taken, largest = targets(by_source), Counter(), Counter()
    for i, _, s in rows():
        r = report[i]
        assert (r.size, r.source_size) == (size[i], by_source[s])
        assert r.target == pytest.approx(wanted[s])
        assert r.size == 0 or r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in wanted:
        assert abs(taken[s] - wanted[s]) <= largest[s]
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(by_source.values()))


def test_reruns_agree(make_docs, report):
    again = mixing.mixing_report(make_docs(rows()[::-1]).repartition(5))
    assert {r.doc_id: r.taken for r in again.collect()} == {i: r.taken for i, r in report.items()}


def test_mix_repeats_rows_as_drawn(make_docs, report):
    docs = make_docs(rows())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = Counter(r.doc_id for r in mixed.collect())
    drawn = {r.doc_id: r.n for r in mixing.draw(docs).select("doc_id", F.size("copies").alias("n")).collect()}
    assert seen == Counter({i: n for i, n in drawn.items() if n})
    assert all(report[i].taken == n * report[i].size for i, n in drawn.items())


def test_blocks_are_disjoint_among_shards(make_docs):
    drawn = mixing.draw(make_docs(rows()), levels=3)
    block = F.shiftright(mixing._slot(F.col("size")), mixing.SLOT_BITS - mixing.BLOCK_BITS)
    copies = drawn.select("source", block.alias("block"), F.explode("copies").alias("c"))
    shards = copies.groupBy("source", "block", "c.pass").agg(F.countDistinct("c.shard").alias("n"))
    assert shards.agg(F.max("n")).first()[0] == 1
    assert {r[0] for r in copies.select("c.shard").distinct().collect()} == set(range(8))


def test_tree_keeps_the_quotas(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 0), (2, 33), (3, 1)], "place int, drawn bigint")
    leaves = [r.quotas for r in mixing.split_quotas(quotas, 4).collect()]
    assert len(leaves) == 16
    assert [sum(x) for x in zip(*leaves)] == [700, 0, 33, 1]
    totals = [sum(x) for x in leaves]
    assert max(totals) - min(totals) <= 1
    # a source's blocks scatter as draws without replacement do, not evenly
    assert 35 < min(x[0] for x in leaves) and len({x[2] for x in leaves}) > 1


def test_small_tables(make_docs):
    assert mixing.mixing_report(make_docs([])).count() == 0
    assert mixing.mix(make_docs([])).count() == 0
    (one,) = mixing.mixing_report(make_docs(["a b c"])).collect()
    assert one.target == 4.5 and one.taken in (3, 6)
    assert [r.taken for r in mixing.mixing_report(make_docs([None, ""])).collect()] == [0, 0]


def test_no_python_in_the_plan(make_docs):
    plan = mixing.mix(make_docs(["a b", "c d"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_user_columns_of_any_name_are_kept(make_docs):
    names = ["size", "source_size", "target", "copies", "slot", "place", "words", "passes", "cut", "drawn", "shards"]
    extra = [f"concat('{n} of ', doc_id) AS {n}" for n in names]
    plain, clashing = make_docs(rows()), make_docs(rows(), extra)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    got = [r.asDict() for r in mixed.collect()]
    assert all(r[n] == (None if r["doc_id"] is None else f"{n} of {r['doc_id']}") for r in got for n in names)
    kept = ("doc_id", "text", "source")
    assert sorted(str([r[c] for c in kept]) for r in got) == sorted(str(list(r)) for r in mixing.mix(plain).select(*kept).collect())
    with pytest.raises(ValueError, match="overwritten"):
        mixing.draw(clashing)
