from itertools import combinations

import numpy as np
import pytest

from epithet.llm import ngram_join
from epithet.llm.common import shingle_set

from .conftest import ODD, prose


def grams(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [(i, grams(t)) for i, t in rows]
    root = {n: n for n in range(len(sets))}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(b)] = find(a)
    low = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, len(s), low.get(find(n))) for n, (i, s) in enumerate(sets)), key=str)


def edited(text, every, offset):
    words = text.split(" ")
    return " ".join(w + "q" if i % every == offset else w for i, w in enumerate(words))


def corpus():
    base, other, passage = prose(1, 300), prose(2, 200), prose(3, 60)
    rows = [base, base.upper(), base, other, other + " tail", *ODD]
    rows += [edited(base, e, o) for e in (40, 60, 90, 150) for o in (3, 7, 11)]
    # a chain: each step changes a little, the ends differ
    step = prose(4, 400).split(" ")
    for n in range(6):
        rows.append(" ".join([f"new{n}x{i}" for i in range(18 * n)] + step[18 * n :]))
    # dissimilar texts that share a passage
    rows += [passage + " " + prose(100 + n, 120) for n in range(30)]
    return [(7 * i % 997, t) for i, t in enumerate(rows)]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_equals_comparing_all_pairs(make_docs):
    rows = corpus()
    got = result(ngram_join.jaccard_components(make_docs([(i, t, "s") for i, t in rows])))
    assert got == brute(rows)


def test_threshold_is_exact(make_docs):
    """Overlaps one n-gram above and below 80 of 100."""
    base = [f"w{i}" for i in range(104)]  # 100 n-grams
    rows = []
    for cut in range(9, 14):
        rows.append((cut, " ".join(base[: 104 - cut] + [f"z{cut}_{i}" for i in range(cut)])))
    rows.append((99, " ".join(base)))
    assert result(ngram_join.jaccard_components(make_docs([(*r, "s") for r in rows]))) == brute(rows)


def test_repeated_and_null_ids(make_docs):
    text, near = prose(5, 100), prose(5, 100) + " more"
    rows = [(None, text), (4, text), (4, text), (9, near), (None, None), (2, None)]
    assert result(ngram_join.jaccard_components(make_docs([(*r, "s") for r in rows]))) == brute(rows)


def test_hot_columns_are_salted(make_docs, monkeypatch):
    """Columns above the limit take the other path, with the same result."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    rows = corpus()
    got = result(ngram_join.jaccard_components(make_docs([(i, t, "s") for i, t in rows])))
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(make_docs):
    assert ngram_join.jaccard_components(make_docs([])).count() == 0
    extra = ["1 AS key", "2 AS n", "3 AS gram", "4 AS component_id"]
    docs = make_docs(["one two three four five six"] * 2, extra)
    assert result(ngram_join.jaccard_components(docs)) == [(0, 2, 0), (1, 2, 0)]


def test_keep_one(make_docs):
    text, near = prose(5, 100), prose(5, 100) + " more"
    rows = [(4, near, "s"), (3, text, "s"), (3, text, "s"), (8, "alone", "s"), (None, "no id", "s"), (5, None, "s")]
    kept = ngram_join.keep_one(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("3", text), ("8", "alone"), ("None", "no id"), ("5", None)], key=str
    )


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_meet_for_all_linked_sets(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        base = rng.choice(10_000, n, replace=False)
        other = np.unique(np.concatenate([base[rng.random(n) > 0.15], rng.choice(10_000, int(rng.integers(0, 6)))]))
        overlap = len(np.intersect1d(base, other))
        if 100 * overlap >= 80 * (n + len(other) - overlap):
            first = lambda s: set(np.sort(s)[: ngram_join.prefix_length(len(s))])
            assert first(base) & first(other)


def test_long_texts_hash_in_pieces():
    words = [f"word{i % 977}" for i in range(300_000)]
    whole = shingle_set(" ".join(words).encode())
    assert len(whole) == 977
