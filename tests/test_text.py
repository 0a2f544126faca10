import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.operators import annotate, sentences, tagging
from epithet.params import Lexicon

LEX = Lexicon.of(["Sri Lankan", "asian-american", "south east asian", "east asian", "thai"])


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Sri Lankan communities", ["sri_lankan", "communities"]),
        ("Asian-American activists", ["asian_american", "activists"]),
        ("sri lankan sri lankan", ["sri_lankan", "sri_lankan"]),
        ("south east asian food", ["south_east_asian", "food"]),
        ("north east asian food", ["north", "east_asian", "food"]),
        ("east thai asian", ["east", "thai", "asian"]),
        ("sri lankans", ["sri", "lankans"]),
    ],
)
def test_multiword_merge(spark, text, expected):
    rows = sentences.tokenize(docs(spark, text), LEX).collect()
    assert rows[0].tokens == expected


def test_sentences_match_a_plain_split(spark):
    texts = [
        "One. Two!  Three?\n\nfour... five  . . ! x",
        "",
        None,
        "no end",
        "  lead. " + "w " * 120 + ". " + "w " * 121 + ". tail ",
        "a b. c\x85d!",
    ]
    rows = sentences.split_sentences(docs(spark, *texts), 120).orderBy("doc_id", "sent_id").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.sentence)
    for i, t in enumerate(texts):
        parts = [s.strip() for s in re.split(r"[.!?]+", t or "")]
        assert got.get(i, []) == [s for s in parts if s and len(s.split()) <= 120]


def test_clean_term_is_nfkd(spark):
    words = ["naïve", "Crème-Brûlée", "ﬁne", "Ｆｕｌｌ", "Straße", "a--b", "x1_y", "ǅur", "日本", "ñandú", "𝐁old", "½-ton"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", T.clean_term(F.col("w")).alias("c"), T.clean_term(F.col("w"), True).alias("h")
    )
    for r in rows.collect():
        plain = unicodedata.normalize("NFKD", r.w).encode("ascii", "ignore").decode().lower().strip()
        plain = re.sub(r"[^a-z\-]", "", plain)
        assert (r.c, r.h) == (plain, plain.replace("--", "-"))


def test_parse_list_and_group_names(spark):
    assert one(spark, T.parse_list, "['a', 'b']") == ["a", "b"]
    assert one(spark, T.parse_list, '["a"]') == ["a"]
    assert one(spark, T.parse_list, "nonsense") == []
    assert one(spark, T.parse_list, None) == []
    assert one(spark, T.normalize_group, "Asian_Indian") == "indian"
    assert one(spark, T.normalize_group, " native hawaiian ") == "hawaiian"
    assert one(spark, T.normalize_group, "sri_lankan") == "sri lankan"


def test_term_filters(spark):
    rows = spark.createDataFrame(
        [("ok", "chinese"), ("south", "chinese"), ("chinese-style", "chinese"), ("asians", "chinese"),
         ("lovely", "chinese"), ("thai", "chinese"), ("sri lankans", "sri lankan"), ("srilankan", "sri lankan")],
        "term string, grp string",
    )
    drop = T.stopped_term(F.col("term")) | T.names_group(F.col("term"), F.col("grp"), LEX)
    kept = {r.term for r in rows.where(~drop).collect()}
    # a multiword group's joined spelling is not recognised: blanks stay in its name
    assert kept == {"lovely", "srilankan"}


def test_taggers_count_distinct_surfaces(spark):
    df = docs(spark, "Thai thai asian-american Asian American asian  american", "thais", "sri_lankan sri lankan", None)
    tolerant = tagging.span_score(tagging.apply_tagger("lexicon_tolerant", df, LEX)).orderBy("doc_id")
    exact = tagging.span_score(tagging.apply_tagger("lexicon_exact", df, LEX)).orderBy("doc_id")
    assert [r.score for r in tolerant.collect()] == [4.0, 0.0, 2.0, 0.0]
    assert [r.score for r in exact.collect()] == [2.0, 0.0, 1.0, 0.0]
    assert [r.doc_id for r in tagging.mix(tagging.tag_exact(df, LEX)).orderBy("doc_id").collect()] == [0, 2]
    assert tagging.with_attributes(tagging.tag_exact(df, LEX)).count() == 2
    with pytest.raises(KeyError):
        tagging.apply_tagger("unknown", df, LEX)


def test_masked_window_edges(spark):
    for at, lo, hi in ((2, 0, 7), (19, 14, 19)):
        words = [f"w{i}" for i in range(20)]
        words[at] = "thai"
        sents = sentences.mention_sentences(docs(spark, " ".join(words)), LEX)
        (row,) = sentences.masked_window(sents).collect()
        words[at] = "[GROUP]"
        assert row.window_text == " ".join(words[lo : hi + 1])


def test_representative_prefers_multiword_then_position(spark):
    df = docs(spark, "thai and sri lankan", "east asian thai", "thai thai maori")
    rows = sentences.group_mentions(sentences.mention_sentences(df, LEX)).orderBy("doc_id").collect()
    assert [(r.grp, r.n_groups) for r in rows] == [("sri_lankan", 2), ("east_asian", 2), ("thai", 1)]


def test_sentence_budget_keeps_all_keyword_sentences(spark):
    text = ". ".join(["filler one"] * 30 + ["thai word"] * 12 + ["more filler"] * 5)
    rows = sentences.sentence_budget(docs(spark, text), LEX, max_filler=20, max_total=25).collect()
    assert sum(r.is_keyword for r in rows) == 12
    assert [r.sent_id for r in rows if not r.is_keyword] == list(range(13))
    rows = sentences.sentence_budget(docs(spark, text), LEX, max_filler=20, max_total=10).collect()
    assert len(rows) == 12 and all(r.is_keyword for r in rows)


def test_lexicon_plurals():
    lex = Lexicon.of(["thai", "chinese", "swiss"])
    assert lex.groups() == {
        "thai": "thai", "thais": "thai", "chinese": "chinese", "chineses": "chinese", "swiss": "swiss"
    }
    assert "swisss" in Lexicon(lex.terms, always_plural=True).groups()


def test_lexicon_table_and_examples(spark):
    lex = Lexicon.of(["Thai", "sri lankan", " "])
    assert lex.terms == ("sri_lankan", "thai")
    df = docs(spark, "nothing", "first THAI " + "x" * 200, "second thai")
    got = {r.term: r.example for r in tagging.find_examples(df, lex).collect()}
    assert got == {"thai": ("first THAI " + "x" * 200)[:100], "sri_lankan": "no example in data"}


def test_external_annotator_plugs_in(spark):
    sents = sentences.mention_sentences(docs(spark, "Thai food. Other Thai"), LEX)

    def parse(batches):
        for pdf in batches:
            pdf["toks"] = [
                [dict(i=i, text=w, lemma=w.lower(), pos="NOUN", tag="NN", dep="ROOT", head=i, ent="")
                 for i, w in enumerate(s.split())]
                for s in pdf.sentence
            ]
            yield pdf

    annotated = annotate.external_annotate(parse)(sents, LEX)
    assert set(sents.columns) < set(annotated.columns)
    rows = annotate.token_rows(annotated).collect()
    assert sorted(r.text for r in rows) == ["Other", "Thai", "Thai", "food"]


def test_long_sentences_are_whole(spark):
    """No sentence is too long: 5,000 words before a mention change nothing."""
    long = docs(spark, "word " * 5000 + "the thai cook smiled")
    (row,) = sentences.tokenize(long).collect()
    assert len(row.tokens) == 5004
    (mention,) = sentences.mention_sentences(long, LEX).collect()
    assert mention.overlap == ["thai"] and len(mention.tokens) == 5004
    assert sentences.mention_index(sentences.mention_sentences(long, LEX), LEX).first().i == 5001
    assert sentences.split_sentences(long, 120).count() == 0


def test_list_literals(spark):
    texts = ["['a', None]", "['a',]", "['caf\\xe9']", "['x, None, y']", "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(T.parse_list(F.col("c"))).collect()]
    assert got == [["a", None], ["a"], ["café"], ["x, None, y"], []]


def test_clean_lemmas_drop_stop_words_and_digits(spark):
    sents = sentences.mention_sentences(docs(spark, "the thai was cooking 3 dishes"), LEX)
    (row,) = sentences.clean_lemmas(annotate.surface_annotate(sents, LEX), params.FUNCTION_WORDS).collect()
    assert row.lemmas == ["thai", "cook", "dishes"]
