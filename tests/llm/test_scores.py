import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from epithet.llm import lm_scoring, quality_ranker

from .conftest import ODD, prose

LABELS = "doc_id bigint, quality int, toxic int"


def bad(n):
    text = prose(n, 120)
    return [text.upper().replace(" ", "!! "), text.replace(" ", "*** "), "menu | " * 60, (text[:9] + " ") * 90][n % 4]


def rem(i):
    return zlib.crc32(str(i).encode()) % 5


def test_ranker_separates_held_out_documents(make_docs, spark):
    texts = [bad(i) if i % 5 == 0 else prose(i, 60 + i % 90) for i in range(400)] + ODD
    docs = make_docs(texts, ["9.5D AS score", "'x' AS x"])
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(7, None, 0), (10_000, 1, 0)], LABELS)
    got = {r.doc_id: r for r in quality_ranker.quality_scores(docs, labels).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(400) if rem(i) == 0]
    right = sum(got[i].predicted == int(i % 5 != 0) for i in held)
    assert right >= 0.97 * len(held)
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (rem(i) == 0)
    ranker = quality_ranker.learn(docs, labels)
    kept = quality_ranker.keep_good(docs, ranker)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_labels_of_held_out_rows_are_not_used(make_docs, spark):
    docs = make_docs([bad(i) if i % 3 == 0 else prose(i, 80) for i in range(60)])
    rows = [(i, int(i % 3 != 0), 0) for i in range(60)]
    turned = [(i, 1 - q if rem(i) == 0 else q, t) for i, q, t in rows]
    scores = [
        sorted((r.doc_id, r.score) for r in quality_ranker.quality_scores(docs, spark.createDataFrame(x, LABELS)).collect())
        for x in (rows, turned)
    ]
    assert scores[0] == scores[1]


def test_an_id_on_many_rows_counts_once(make_docs, spark, monkeypatch):
    monkeypatch.setattr(quality_ranker, "MAX_LABELLED", 2)
    a, b = [i for i in range(20) if rem(i) != 0][:2]
    docs = make_docs([(a, prose(i, 80), "s") for i in range(30)] + [(b, bad(0), "s")])
    labels = spark.createDataFrame([(a, 1, 0), (b, 0, 0)], LABELS)
    scores = {r.score for r in quality_ranker.quality_scores(docs, labels).collect()}
    assert scores != {0.5}


def test_ranker_without_pairs(make_docs, spark):
    docs = make_docs(["some text", None])
    for rows in ([], [(0, 1, 0), (1, 1, 0)]):
        labels = spark.createDataFrame(rows, LABELS)
        assert {r.score for r in quality_ranker.quality_scores(docs, labels).collect()} == {0.5}
    assert quality_ranker.quality_scores(docs.limit(0), labels).count() == 0


def test_pairs_are_linear_in_the_rows():
    good, bad_rows = np.ones((100, len(quality_ranker.FEATURES))), np.zeros((7, len(quality_ranker.FEATURES)))
    assert len(quality_ranker.preference_pairs(good, bad_rows)) == 100 * quality_ranker.PAIRS_PER_ROW


# --- language model ------------------------------------------------------------


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter()
    for i, t in rows:
        if i is None or rem(i) != 1:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        yield i, len(own), sum(count[w] > 0 for w in own), n, base


def test_base_score_is_exact(make_docs):
    texts = [*ODD, *[prose(i, 10 + i % 60) for i in range(150)], prose(1, 90), prose(1, 90), "only here twice " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id")]
    docs = make_docs([(*r, "s") for r in rows], ["1 AS word", "2 AS score", "3 AS rare"])
    got = {r.doc_id: r for r in lm_scoring.held_out_scores(docs).collect()}
    assert len(got) == len(rows)
    for i, n_tokens, known, total, base in brute(rows):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.held_out == (i is not None and rem(i) == 1)


def test_model_beats_unigrams_on_held_out_text(make_docs):
    rng = random.Random(1)
    follows = {w: [rng.choice("abcdefghijklmnopqrst") for _ in range(2)] for w in "abcdefghijklmnopqrst"}

    def walk():
        w, out = "a", []
        for _ in range(200):
            w = rng.choice(follows[w])
            out.append(w)
        return " ".join(out)

    rows = lm_scoring.held_out_scores(make_docs([walk() for _ in range(60)])).where("held_out").collect()
    assert rows and all(r.score > r.base_score for r in rows)


def test_slices_change_nothing(make_docs, monkeypatch):
    docs = make_docs([prose(i, 40 * (1 + i % 5)) for i in range(30)])
    whole = {r.doc_id: r.score for r in lm_scoring.held_out_scores(docs).collect()}
    monkeypatch.setattr(lm_scoring, "FLUSH", 11)
    assert {r.doc_id: r.score for r in lm_scoring.held_out_scores(docs).collect()} == pytest.approx(whole)


def test_filter_reads_back_quantised_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    counts = np.ceil(rng.pareto(0.7, len(keys)) + 0.5).astype(np.int64)
    segment = lm_scoring.fill_segment(keys, counts)
    data = np.frombuffer(segment, np.uint8)
    held = lm_scoring.CountFilter(data, np.zeros(1, np.int64), np.array([8 * len(data)]))
    exact = lm_scoring.count_of(lm_scoring.levels_of(counts))
    guess = held.counts(keys)
    assert (guess >= exact).all() and (guess == exact).mean() > 0.95
    strangers = np.setdiff1d(rng.integers(0, 1 << 40, 5000, dtype=np.uint64), keys)
    assert (held.counts(strangers) > 0).mean() < 0.03
    assert (np.abs(exact - counts) <= 0.34 * counts + 0.5).all()


def level_scores(rows, least=1):
    """Scores by exact levels of all words and of the longer n-grams seen ``least`` times or more."""
    level = lambda n: float(lm_scoring.count_of(lm_scoring.levels_of(np.array([n])))[0]) if n else 0.0
    end = "<end>"
    texts = {i: [*(t or "").split(), end] for i, t in rows}
    seen = Counter()
    for i, words in texts.items():
        if rem(i) != 1:
            padded = [end, end, *words]
            for at in range(2, len(padded)):
                seen.update(tuple(padded[at - n : at + 1]) for n in range(3))
    distinct, total = (f(n for g, n in seen.items() if len(g) == 1) for f in (lambda x: len(list(x)), sum))
    count = lambda g: level(seen[g]) if len(g) == 1 or seen[g] >= least else 0.0
    for i, words in texts.items():
        padded, score = [end, end, *words], 0.0
        for at in range(2, len(padded)):
            share = (count((padded[at],)) + 0.5) / (total + 0.5 * (distinct + 1))
            for n in (1, 2):
                own = count(tuple(padded[at - n : at + 1]))
                context = count((end,)) if at == 2 else count(tuple(padded[at - n : at]))
                top = max(own, context)
                kinds = (own > 0) + min(top - own, math.sqrt(top - own))
                share = (max(own - 0.75, 0) + 0.75 * kinds * share) / top if top else share
            score += math.log10(share)
        yield i, score


def test_score_equals_exact_counts(make_docs):
    """Off by what the filter reads too high, about one n-gram in a hundred."""
    rows = [(i, prose(i % 50, 40 + i % 7).lower()) for i in range(120)] + [(500, ""), (501, None), (502, "alone")]
    got = {r.doc_id: r.score for r in lm_scoring.held_out_scores(make_docs([(*r, "s") for r in rows])).collect()}
    exact = dict(level_scores(rows))
    assert got.keys() == exact.keys()
    assert all(x < 0 for x in got.values())
    off = [abs(got[i] - exact[i]) / len((t or "").split() or [1]) for i, t in rows]
    assert max(off) < 0.2 and sorted(off)[len(off) // 2] < 0.02


def test_texts_seen_twice_stand_out(make_docs):
    """Training texts that occur twice score higher per token than nearly all that occur once."""
    rows = [(i, prose(i, 60 + i % 90).lower()) for i in range(400)]
    again = [(1000 + i, t) for i, t in rows[:60]]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.held_out_scores(make_docs([(*r, "s") for r in rows + again])).collect()}
    trained = [i for i, _ in rows if rem(i) != 1]
    twice = [got[i] for i in trained if i < 60 and rem(1000 + i) != 1]
    single = sorted(got[i] for i in trained if i >= 60)
    held = [got[i] for i, _ in rows if i >= 60 and rem(i) == 1]
    limit = single[int(0.95 * len(single))]
    assert sum(s > limit for s in twice) >= 0.9 * len(twice) > 0
    assert max(held) < min(single)


def test_filter_grows_with_the_corpus(make_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1 << 10)
    texts = [prose(i // 10, 60).lower() for i in range(300)]  # ten copies: every bigram is seen often
    got = {r.doc_id: r.score for r in lm_scoring.held_out_scores(make_docs(texts)).collect()}
    for i, score in level_scores(list(enumerate(texts))):
        assert got[i] == pytest.approx(score, abs=3)


def test_bigrams_seen_once_count(make_docs):
    texts = [" ".join(f"{w}{i}" for w in prose(i, 60).lower().split()) for i in range(60)]
    texts += [texts[next(i for i in range(60) if rem(i) != 1)]] * 9  # in training once, if held out elsewhere
    rows = [(i, t) for i, t in enumerate(texts) if i < 60 or rem(i) == 1]
    assert any(i >= 60 for i, _ in rows)
    got = {r.doc_id: r.score for r in lm_scoring.held_out_scores(make_docs([(*r, "s") for r in rows])).collect()}
    for i, score in level_scores(rows, 1):
        assert got[i] == pytest.approx(score, abs=8)
    once = dict(level_scores(rows, 2))
    assert all(got[i] > once[i] + 20 for i, _ in rows if rem(i) != 1)


def test_training_of_its_own(make_docs):
    texts = [prose(i, 30 + i) for i in range(40)]
    held = make_docs([(i, t, "s") for i, t in enumerate(texts) if rem(i) == 1])
    training = make_docs([(i, t, "s") for i, t in enumerate(texts) if rem(i) != 1])
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(held, training).collect()}
    both = lm_scoring.held_out_scores(make_docs(texts)).where("held_out").collect()
    assert got == pytest.approx({r.doc_id: r.score for r in both}) and got


def test_no_probe_above_the_largest_level():
    keys = np.arange(1000, dtype=np.uint64)
    full = np.full(1 << 10, 255, np.uint8)
    held = lm_scoring.CountFilter(full, np.zeros(1, np.int64), np.array([8 * len(full)]), 3)
    assert (held.levels(keys) == 3).all()
    assert lm_scoring.one_segment(keys, np.full(1000, 7)).top == lm_scoring.levels_of(np.array([7]))[0]


def test_small_tables(make_docs):
    assert lm_scoring.held_out_scores(make_docs([])).count() == 0
    (one,) = lm_scoring.held_out_scores(make_docs([(next(i for i in range(99) if rem(i) == 1), "held out alone", "s")])).collect()
    assert one.train_tokens == 0 and one.n_known == 0
