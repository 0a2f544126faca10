import re
from collections import Counter

import pytest

from epithet.llm import quality_rules, url_filters
from epithet.llm.url_filters import Rule, RuleIndex

from .conftest import ODD, prose

URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com",
    "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/?q", "http://notexample.com/en/1",
    "https://x.net/es/1", "https://net/fr/", "https://x.net/ES/1", "https://x.net?/es/", "ftp://x.org/com/",
    "http://spam-farm.example.org/", "http://spam-farm.example.com/", "http://a.spam-farm.x.net/es/", "x?u=http://y.com/z",
    "http://example.com/" + "a/" * 20_000, "http://é.com/\n/en/",
]


def brute(url):
    """Every rule's own test on every URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = re.split(r"[?#]", rest)[0]
    host, path = (rest[: rest.find("/")], rest[rest.find("/") :]) if "/" in rest else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = {}
    for rule in url_filters.PAGE_RULES:
        name, _, rest = rule.name.partition("/")
        if rule.host_rule and (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits[rule.name] = rule.action
    if fits:
        best = max(fits, key=len)
        return host, path, best, fits[best]
    bad = [r.name for r in url_filters.PAGE_RULES if not r.host_rule]
    hit = any(host.startswith(b) or "." + b in host for b in bad)
    return host, path, None, "block" if hit else "allow"


def test_urls(spark):
    rows = [(i, u, u, u) for i, u in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_pages(pages).collect()}
    assert got == {i: brute(u) for i, u, *_ in rows}
    assert url_filters.judge_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "pattern,literals,hits,misses",
    [
        ("||ads.x^", ["ads", "x"], ["ads.x/", "a.ads.x/b"], ["bads.x/", "ads.xy/"]),
        ("/banner/*/img^", ["banner", "img"], ["h/banner/1/img/", "h/banner/a/b/img"], ["h/banner/img/", "h/banner/1/imgs"]),
        ("track", [], ["my.tracker.x/"], ["x/"]),
    ],
)
def test_patterns(pattern, literals, hits, misses):
    rule = Rule(pattern)
    assert rule.literals() == literals
    index = RuleIndex([rule], {})
    for text in hits + misses:
        host, slash, path = text.partition("/")
        assert (index.judge(host, slash + path)[2] == "block") == (text in hits), text


def test_rules_lie_under_their_rarest_token():
    rules = [Rule("||a.b^"), Rule("||a.c^")]
    index = RuleIndex(rules, {"a": 1, "b": 2, "c": 0})
    assert sorted(index.by_token) == ["a", "c"]


def test_rule_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "MAX_RULE_CHARS", 3)
    with pytest.raises(ValueError, match="split the rule list"):
        url_filters.filter_urls(spark.createDataFrame([(1, "u")], "page_id bigint, url string"), [Rule("||a.b^")])


# --- line-first cleaning ----------------------------------------------------


def measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(make_docs):
    texts = [*ODD, "a b c a b c d", "a b c x a b c", "one two three four", "l.\nl.\n\n l.\nl."]
    texts += [prose(n, 10 * n) + "\n" + prose(n, 30) for n in range(1, 12)] + ["Again and again. " * 100]
    got = {r.doc_id: r for r in quality_rules.quality_report(make_docs(texts, ["7 AS rules", "8 AS clean_text"])).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        expected = measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, text and text[:50]
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_lines_are_removed_before_the_text_is_judged(make_docs):
    good = prose(1, 200)
    menu = "Home | About | News | Contact | Help | Login."
    shout = "BUY NOW AND SAVE MONEY TODAY!!"
    stars = "so *** many &&& signs ### here $$$ now."
    cookies = "This site uses cookies for everything."
    bare = "no sentence ends here at all"
    texts = [good, "\n".join([menu, good, shout, stars, cookies, bare]), good[:300] + "\n" + (shout + "\n") * 90, None, ""]
    docs = make_docs(texts)
    kept = {r.doc_id: r for r in quality_rules.keep_clean(docs).collect()}
    assert sorted(kept) == [0, 1] and {kept[0].text, kept[1].text} == {good}
    assert kept[1].n_chars == len(good)
    assert quality_rules.keep_clean(docs.limit(0)).columns == docs.columns


def test_keep_clean_keeps_user_columns_and_judges_once(make_docs):
    names = ["rules", "clean_text", "kept", "clean", "words", "lines", "size"]
    texts = [prose(i, 80) + "\n### | nothing | here" for i in range(20)] + ODD
    docs = make_docs(texts, [f"concat('{n} of ', doc_id) AS {n}" for n in names])
    out = quality_rules.keep_clean(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(range(20)) <= set(got)
    assert all(r[n] == f"{n} of {i}" for i, r in got.items() for n in names)
    assert all(r.text == texts[i].split("\n###")[0] and r.n_chars == len(r.text) for i, r in got.items() if i < 20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lorem ipsum") == 1
