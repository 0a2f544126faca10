import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from epithet.llm import lexical_search as ls

from .conftest import ODD, prose

ITEMS = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=10):
    """Every document scored against every item."""
    held = [(d, terms_of(t)) for d, t in docs]
    held = [(d, Counter(ts), len(ts)) for d, ts in held if ts]
    docs_n, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, tf, n in held:
            m = 100 - 90 + (90 * n * docs_n) // total
            score = 0
            for t in terms & tf.keys():
                w = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scored[:top])]
    return sorted(out, key=str)


def found(spark, make_docs, docs, items, extra=None, **kw):
    df = make_docs([(d, t, "s") for d, t in docs], extra)
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS term", "1 AS item") if extra else spark.createDataFrame(items, ITEMS)
    rows = ls.search(df, asked, **kw)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(i, prose(rng.randint(0, 60), rng.randint(1, 120))) for i in range(400)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs += [(2000 + i, prose(7, 40)) for i in range(150)]  # equal texts: ties by id
    docs += [(2000, prose(7, 40)), (None, prose(7, 40)), (None, "kadans")]
    items = [(i, prose(i, 12)) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, "Ünïcödé straße"), (104, "日本語のテキスト"), (105, prose(7, 40)), (None, "word words"), (3, "other words")]
    rng.shuffle(docs)
    return docs, items


def test_equals_scoring_all_pairs(spark, make_docs, corpus):
    docs, items = corpus
    assert found(spark, make_docs, docs, items) == plain(docs, items)


def test_blocks_of_items_give_the_same(spark, make_docs, corpus, monkeypatch):
    docs, items = corpus
    for name, value in (("BLOCK_ITEMS", 20), ("PIECE", 64), ("PAIRS", 100)):
        monkeypatch.setattr(ls, name, value)
    assert found(spark, make_docs, docs, items) == plain(docs, items)
    assert found(spark, make_docs, docs, items[:3], top=1) == plain(docs, items[:3], 1)


def test_clashing_columns(spark, make_docs, corpus):
    docs, items = corpus
    extra = [f"'x' AS {c}" for c in ("n", "terms", "counts", "score", "rank", "item", "item_id", "salt")]
    assert found(spark, make_docs, docs[:50], items, extra) == plain(docs[:50], items)


def test_empty_tables(spark, make_docs):
    assert found(spark, make_docs, [(1, "a")], []) == []
    assert found(spark, make_docs, [], [(1, "a")]) == []
    assert found(spark, make_docs, [(1, None), (2, "--")], [(1, "a")]) == []
    assert found(spark, make_docs, [(1, "b")], [(1, "a")]) == []


def test_terms_end_at_boundaries():
    terms = ls.Terms(["a", "ab", "ba", "é", "b1"])
    total, which, counts = terms.scan("ab a,a-BA b1b b1 É é\x00é aba".encode())
    assert total == 10
    assert dict(zip(which.tolist(), counts.tolist(), strict=True)) == {0: 2, 1: 1, 2: 1, 3: 2, 4: 1}


def test_a_long_text_is_read_in_pieces(spark, make_docs):
    text = "kadan " * 400_000 + "x" * 2_000_000 + " lofel"
    docs = [(1, text), (2, "lofel kadan"), (3, "nothing")]
    assert found(spark, make_docs, docs, [(1, "lofel"), (2, "KADAN lofel")]) == plain(docs, [(1, "lofel"), (2, "KADAN lofel")])


def test_best_rows_with_ties():
    rng = np.random.default_rng(0)
    best, rows = ls._Best(5, 10), []
    for _ in range(30):
        scores, ids = rng.integers(0, 4, (40, 5)), rng.integers(0, 60, 40)
        best.add(scores, ids, np.zeros(40, bool))
        rows += [(s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
    for item in range(5):
        expected = sorted((-s[item], i) for s, i in rows)[:10]
        assert list(zip((-best.scores[:, item]).tolist(), best.ids[:, item].tolist(), strict=True)) == expected
