import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epithet.operators import rules, variants
from epithet.operators.annotate import TOKEN_TYPE
from epithet.operators.tree import child_positions, index, inside, spans
from epithet.params import Lexicon

GROUPS = Lexicon.of("filipino korean japanese chinese vietnamese thai maori indian".split())


def parses():
    """Hand-parsed sentences and the modifier sets they should give."""
    block = (Path(__file__).parents[1] / "FIXTURES.md").read_text().split("```")[1]
    name, expected, toks = None, None, []
    for line in [*block.strip().splitlines(), "# end | | expect nouns= verbs= adjs="]:
        if line.startswith("#"):
            if name:
                yield name, expected, toks
            name = line.split()[1]
            found = re.search(r"expect nouns=(\S*) verbs=(\S*) adjs=(\S*)", line).groups()
            expected, toks = [sorted(filter(None, f.split(","))) for f in found], []
        else:
            i, text, lemma, pos, tag, dep, head = line.split(" ")
            toks.append((int(i), text, lemma, pos, tag, dep, int(head), ""))


def sentence(text):
    """Tokens written ``text/lemma/POS/TAG/dep/head``."""
    out = []
    for i, part in enumerate(text.split()):
        word, lemma, pos, tag, dep, head = part.rsplit("/", 5)
        out.append((i, word, lemma, pos, tag, dep, int(head), "NORP" if lemma in GROUPS.terms else ""))
    return out


def frame(spark, *sents):
    rows = [(f"d{n}", 0, toks) for n, toks in enumerate(sents)]
    return spark.createDataFrame(rows, f"doc_id string, sent_id bigint, toks {TOKEN_TYPE}")


@pytest.fixture(scope="module")
def collected(spark):
    rows = [(name, 0, toks) for name, _, toks in parses()]
    df = spark.createDataFrame(rows, f"doc_id string, sent_id bigint, toks {TOKEN_TYPE}")
    return {r.doc_id: [r.nouns, r.verbs, r.adjs] for r in rules.collect_modifiers(df, GROUPS).collect()}


@pytest.mark.parametrize("name,expected", [(n, e) for n, e, _ in parses()])
def test_hand_parsed_sentence(collected, name, expected):
    assert collected[name] == expected


def modifiers(spark, text):
    (row,) = rules.collect_modifiers(frame(spark, sentence(text)), GROUPS).collect()
    return row.nouns, row.verbs, row.adjs


def test_subject_of_embedded_verb_stops_later_rules(spark):
    # the verb is not the root: neither it nor the adjective after the group counts
    text = "koreans/koreans/PROPN/NNPS/nsubj/1 sing/sing/VERB/VBP/ccomp/2 say/say/VERB/VBP/ROOT/2 happy/happy/ADJ/JJ/amod/0"
    assert modifiers(spark, text) == ([], [], [])
    root = text.replace("VBP/ccomp/2", "VBP/ROOT/1")
    assert modifiers(spark, root) == ([], ["sing"], ["happy"])


def test_hyphen_chain_is_read_left_to_right(spark):
    # a-b-c: the first span takes three tokens, so b opens no second span
    text = (
        "well/well/ADV/RB/amod/5 -/-/PUNCT/HYPH/punct/5 made/make/VERB/VBN/amod/5 "
        "-/-/PUNCT/HYPH/punct/5 looking/look/VERB/VBG/amod/5 thai/thai/ADJ/JJ/amod/6 shop/shop/NOUN/NN/ROOT/6"
    )
    assert modifiers(spark, text)[2] == ["look", "wellmade"]


def test_clause_with_its_own_subject_is_rejected(spark):
    text = (
        "thai/thai/ADJ/JJ/amod/1 man/man/NOUN/NN/ROOT/1 nobody/nobody/PRON/NN/nsubj/3 "
        "knew/know/VERB/VBD/relcl/1"
    )
    assert modifiers(spark, text)[1] == []
    assert modifiers(spark, text.replace("nsubj/3", "dobj/3"))[1] == ["know"]


def test_passive_agent_and_participle_predicate(spark):
    agent = (
        "made/make/VERB/VBN/ROOT/0 by/by/ADP/IN/agent/0 thais/thais/PROPN/NNPS/pobj/1"
    )
    assert modifiers(spark, agent)[1] == ["make"]
    progressive = (
        "thais/thais/PROPN/NNPS/nsubj/2 are/be/AUX/VBP/aux/2 charming/charm/VERB/VBG/ROOT/2"
    )
    assert modifiers(spark, progressive)[1] == []


def test_group_own_lexicon_needs_overlap(spark):
    df = frame(spark, sentence("thais/thais/PROPN/NNPS/nsubj/1 sing/sing/VERB/VBP/ROOT/1"))
    with_terms = df.withColumn("overlap", F.array(F.lit("thai")))
    without = df.withColumn("overlap", F.array(F.lit("maori")))
    assert [r.grp for r in rules.collect_modifiers(with_terms).collect()] == ["thai"]
    assert rules.collect_modifiers(without).collect() == []


def test_subject_climb_survives_a_cycle(spark):
    looped = [
        (0, "a", "a", "ADJ", "JJ", "conj", 1, ""),
        (1, "b", "b", "ADJ", "JJ", "conj", 0, ""),
        (2, "thai", "thai", "PROPN", "NNP", "nsubj", 2, "NORP"),
    ]
    assert variants.predicate_subjects(frame(spark, looped)).collect() == []
    got = variants.subtree_adjectives(frame(spark, looped), Lexicon(GROUPS.terms, always_plural=True))
    assert got.collect() == []  # one-letter lemmas are too short


def test_such_listing_and_hyphen_in_counted_adjectives(spark):
    listed = (
        "groups/group/NOUN/NNS/ROOT/0 such/such/ADJ/JJ/amod/2 as/as/ADP/IN/prep/0 "
        "polite/polite/ADJ/JJ/amod/0 thai/thai/ADJ/JJ/amod/0"
    )
    assert variants.count_adjectives(frame(spark, sentence(listed)), GROUPS).collect() == []
    hyphen = (
        "hard/hard/ADJ/JJ/amod/4 -/-/PUNCT/HYPH/punct/4 working/work/VERB/VBG/amod/4 "
        "thai/thai/ADJ/JJ/amod/4 men/man/NOUN/NNS/ROOT/4"
    )
    rows = variants.count_adjectives(frame(spark, sentence(hyphen)), GROUPS).collect()
    assert [(r.grp, r.term, r.cnt) for r in rows] == [("thai", "hard-working", 1)]


def test_relative_clause_and_fallback_verbs(spark):
    lex = Lexicon(GROUPS.terms, always_plural=True)
    clause = (
        "thai/thai/ADJ/JJ/amod/1 men/man/NOUN/NNS/ROOT/1 who/who/PRON/WP/nsubj/3 sing/sing/VERB/VBP/relcl/1"
    )
    rows = variants.subtree_verbs(frame(spark, sentence(clause)), lex).collect()
    assert [(r.grp, r.term, r.cnt) for r in rows] == [("thai", "sing", 1)]
    loose = "thai/thai/ADJ/JJ/dep/1 run/run/VERB/VB/ROOT/1"
    assert variants.subtree_verbs(frame(spark, sentence(loose)), lex).collect() == []
    rows = variants.subtree_verbs(frame(spark, sentence(loose)), lex, use_fallback=True).collect()
    assert [(r.grp, r.term) for r in rows] == [("thai", "run")]


def test_norp_word_test(spark):
    df = frame(spark, sentence("thai/thai/ADJ/JJ/ROOT/0"), sentence("rice/rice/NOUN/NN/ROOT/0"))
    from pyspark.sql import functions as F

    got = df.select("doc_id", variants.holds_norp(F.col("toks")).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [True, False]


def test_document_unit_joins_sentences(spark):
    one = sentence("thais/thais/PROPN/NNPS/nsubj/1 sing/sing/VERB/VBP/ROOT/1")
    two = sentence("thais/thais/PROPN/NNPS/nsubj/1 dance/dance/VERB/VBP/ROOT/1")
    rows = [("d", 0, one), ("d", 1, two)]
    df = spark.createDataFrame(rows, f"doc_id string, sent_id bigint, toks {TOKEN_TYPE}")
    (row,) = rules.fold_documents(rules.collect_modifiers(df, GROUPS)).collect()
    assert (row.grp, row.verbs) == ("thai", ["dance", "sing"])


@pytest.mark.parametrize("feed", ["table", "parser"])
def test_outside_parses_reach_the_modifier_job(spark, feed):
    """Hand-parsed sentences as a token table, and through a parser function, through the job."""
    from epithet.operators import annotate
    from epithet.plans import jobs

    by_name = {name: toks for name, _, toks in parses()}
    rows = [(name, 0, *t) for name, toks in by_name.items() for t in toks]
    fields = "i int, text string, lemma string, pos string, tag string, dep string, head int, ent string"
    table = spark.createDataFrame(rows, f"doc_id string, sent_id bigint, {fields}")
    texts = [(name, " ".join(t[1] for t in toks).rstrip(" .")) for name, toks in by_name.items()]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    names = [f.split()[0] for f in fields.split(", ")]

    def parse(batches):
        for pdf in batches:
            pdf["toks"] = [[dict(zip(names, t)) for t in by_name[d]] for d in pdf.doc_id]
            yield pdf

    annotator = annotate.token_table_annotate(table) if feed == "table" else annotate.external_annotate(parse)
    found = {r.doc_id: [r.nouns, r.verbs, r.adjs] for r in jobs.modifiers_of(docs, GROUPS, annotator=annotator).collect()}
    whole = {n: e for n, e, toks in parses() if n in found}
    assert len(whole) >= 10 and found == whole
    direct = rules.collect_modifiers(annotate.parsed_sentences(table, GROUPS))
    assert {r.doc_id: [r.nouns, r.verbs, r.adjs] for r in direct.collect()} == {n: e for n, e, _ in parses()}


# --- navigation ---------------------------------------------------------------


def heads_frame(spark, *trees):
    rows = [
        (f"d{n}", 0, [(i, f"w{i}", f"w{i}", "NOUN", "NN", "dep", h, "") for i, h in enumerate(heads)])
        for n, heads in enumerate(trees)
    ]
    return spark.createDataFrame(rows, f"doc_id string, sent_id bigint, toks {TOKEN_TYPE}")


def random_heads(rng, n):
    """A forest: every head is a root or leads to one."""
    order = rng.sample(range(n), n)
    heads = list(range(n))
    for k in range(1, n):
        if rng.random() > 0.1:
            heads[order[k]] = order[rng.randrange(k)]
    return heads


def test_index_and_spans_equal_walking_the_heads(spark):
    rng = random.Random(4)
    trees = [random_heads(rng, n) for n in (1, 2, 3, 7, 20, 60) for _ in range(4)] + [list(range(1, 50)) + [49], []]
    df = heads_frame(spark, *trees)
    toks = F.col("toks")
    pairs = F.transform(
        toks,
        lambda a: F.transform(toks, lambda b: inside(F.get(F.col("spans"), a["i"]), F.get(F.col("spans"), b["i"]))),
    )
    kids = F.transform(toks, lambda t: child_positions(F.col("kids"), t["i"]))
    out = df.withColumn("kids", index(toks)).withColumn("spans", spans(toks, F.col("kids")))
    rows = {r.doc_id: r for r in out.select("doc_id", pairs.alias("within"), kids.alias("children")).collect()}
    for n, heads in enumerate(trees):
        up = [[i] for i in range(len(heads))]
        for path in up:
            while heads[path[-1]] != path[-1]:
                path.append(heads[path[-1]])
        row = rows[f"d{n}"]
        assert row.within == [[b in up[a] for b in range(len(heads))] for a in range(len(heads))]
        assert row.children == [[i for i, h in enumerate(heads) if h == k != i] for k in range(len(heads))]


def test_circles_are_in_no_subtree(spark):
    df = heads_frame(spark, [1, 2, 0, 3, 3])
    found = df.withColumn("kids", index(F.col("toks"))).select(spans(F.col("toks"), F.col("kids")).alias("s")).first().s
    assert [s is None for s in found] == [True, True, True, False, False]


def hub(n):
    """A sentence whose root all tokens hang on, every fifth of them a mention."""
    words = [("thai", "PROPN", "NNP", "nsubj"), ("good", "ADJ", "JJ", "dep"), ("man", "NOUN", "NN", "dep"),
             ("of", "ADP", "IN", "dep"), ("he", "PRON", "PRP", "dep")]
    toks = [(i, w, w, pos, tag, dep, 0, "NORP" if w == "thai" else "") for i in range(n) for w, pos, tag, dep in [words[i % 5]]]
    toks[0] = (0, "sings", "sing", "VERB", "VBZ", "ROOT", 0, "")
    toks[1] = (1, "play", "play", "VERB", "VB", "conj", 0, "")
    return toks


def test_mentions_on_one_root_hold_no_copies_of_its_children(spark):
    lex = Lexicon.of(["thai"])
    df = frame(spark, hub(200), hub(800))
    kept = rules.mention_context(df, lex).select(F.octet_length(F.to_json(F.struct("kids", "aux", "ms"))))
    small, large = sorted(r[0] for r in kept.collect())
    assert large < 6 * small, (small, large)
    (row,) = rules.collect_modifiers(frame(spark, hub(4000)), lex).collect()
    assert [row.nouns, row.verbs, row.adjs] == [[], ["play", "sing"], ["good"]]
    assert [tuple(r) for r in variants.count_verbs(frame(spark, hub(4000)), lex).collect()] == [("thai", "sing", 799)]


def test_children_of_unknown_kind_still_count_as_unknown(spark):
    """A clause or participle with such a child is left out: it may have a subject, or be passive."""
    toks = [
        (0, "thai", "thai", "PROPN", "NNP", "amod", 1, ""), (1, "man", "man", "NOUN", "NN", "nsubj", 4, ""),
        (2, "named", "name", "VERB", "VBN", "acl", 1, ""), (3, "x", "x", "NOUN", "NN", None, 2, ""),
        (4, "sings", "sing", "VERB", "VBZ", "ROOT", 4, ""),
    ]
    (row,) = rules.collect_modifiers(frame(spark, toks), GROUPS).collect()
    assert row.verbs == ["sing"]
    (row,) = rules.collect_modifiers(frame(spark, [*toks[:3], (3, "x", "x", "NOUN", "NN", "dep", 2, ""), toks[4]]), GROUPS).collect()
    assert row.verbs == ["name", "sing"]
    toks = [(0, "thai", "thai", "PROPN", "NNP", "nsubj", 1, ""), (1, "singing", "sing", "VERB", "VBG", "ROOT", 1, "")]
    (row,) = rules.collect_modifiers(frame(spark, [*toks, (2, "is", None, "AUX", "VBZ", "aux", 1, "")]), GROUPS).collect()
    assert row.verbs == []


def test_work_is_linear_in_the_sentence(spark):
    """Four times the tokens may take at most about four times as long; a square would take sixteen."""
    lex = Lexicon.of(["thai"])
    took = {}
    for n in (5_000, 20_000):
        rng = random.Random(n)
        words = [("thai", "thai", "PROPN", "NNP", "amod"), ("good", "good", "ADJ", "JJ", "amod"), ("man", "man", "NOUN", "NN", "nsubj"),
                 ("sing", "sing", "VERB", "VBP", "conj"), ("of", "of", "ADP", "IN", "prep")]
        toks = []
        for i in range(n):
            text, lemma, pos, tag, dep = words[i % 5]
            toks.append((i, text, lemma, pos, tag, dep, max(0, i - rng.randint(1, 3)), "NORP" if text == "thai" else ""))
        df = frame(spark, toks).cache()
        df.count()
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            variants.subtree_verbs(df, Lexicon(lex.terms, always_plural=True)).count()
            variants.predicate_subjects(df).count()
            rules.collect_modifiers(df, lex).count()
            runs.append(time.perf_counter() - start)
        took[n] = min(runs)
    assert took[20_000] < 8 * took[5_000], took
