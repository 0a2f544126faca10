"""Modifier extraction: nouns, verbs and adjectives attached to group mentions.

One sentence stays one row.  ``mentions`` is built in stages (context, nouns and
verbs, adjectives), each a projection over the previous one, and folded into one
entry per group; the only row multiplication is the final ``explode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.functions.arrays import let
from epithet.operators.tree import (
    MODIFYING,
    NAMING,
    SUBJECTS,
    child_positions,
    children,
    has_children,
    head,
    index,
    is_subject_of,
    lemmas,
    low,
    maybe,
    only_if,
    token,
)
from epithet.params import Lexicon


def _lexicon_group(lemma: Column, lexicon: Lexicon | None) -> Column:
    """Group of a lemma: the whole lexicon, or the row's ``overlap`` when none is given."""
    if lexicon is not None:
        return T.group_of(lemma, lexicon)
    return T.group_in(lemma, F.col("overlap"))


# Every rule that looks at children asks for one of these.
LINKS = (*MODIFYING, *SUBJECTS, "attr", "acomp", "conj", "acl", "relcl")


def mention_context(annotated: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """Adds ``kids`` and ``aux``, indexes of the children by ``LINKS`` and of auxiliary ``be``, and
    ``ms``: per mention its token ``e``, its head ``h`` and the head's head ``hh``.

    Children are looked up where a rule asks for them, and never kept per mention: most tokens of a
    long sentence may hang on one root, and so may its mentions.  Without a lexicon the row's
    ``overlap`` terms are the lexicon.
    """
    toks = F.col("toks")
    found = F.filter(
        F.transform(
            toks,
            lambda t: F.struct(t.alias("e"), _lexicon_group(low(t["lemma"]), lexicon).alias("grp")),
        ),
        lambda m: m["grp"].isNotNull(),
    )

    def context(m: Column) -> Column:
        e = m["e"]
        h = head(toks, e)
        return F.struct(
            m["grp"].alias("grp"),
            e.alias("e"),
            h.alias("h"),
            head(toks, h).alias("hh"),
            (h["pos"].isin(*NAMING) & e["dep"].isin(*MODIFYING)).alias("mod"),
        )

    return annotated.select(
        "*",
        index(toks, lambda t: maybe(t["dep"].isin(*LINKS))).alias("kids"),
        index(toks, lambda t: maybe((t["pos"] == "AUX") & (t["lemma"] == "be"))).alias("aux"),
        F.transform(found, context).alias("ms"),
    )


def _noun_rules(m: Column, toks: Column, kids: Column) -> Column:
    e, h = m["e"], m["h"]
    modified = only_if(m["mod"], F.array(low(h["lemma"])))
    attached = lemmas(
        children(toks, kids, e["i"], lambda c: c["pos"].isin(*NAMING) & c["dep"].isin(*MODIFYING))
    )
    predicated = only_if(
        (e["dep"] == "nsubj") & (h["lemma"] == "be"),
        lemmas(children(toks, kids, h["i"], lambda c: (c["dep"] == "attr") & c["pos"].isin(*NAMING))),
    )
    return F.concat(modified, attached, predicated)


def _conjuncts(tokens: Column, pos: str) -> Column:
    return F.filter(tokens, lambda c: (c["dep"] == "conj") & (c["pos"] == pos))


def _copula_adjectives(m: Column, toks: Column, kids: Column) -> Column:
    """Predicate adjectives of the copula whose subject the group modifies."""
    copular = m["mod"] & (m["h"]["dep"] == "nsubj") & (m["hh"]["lemma"] == "be")
    return children(toks, kids, F.when(copular, m["hh"]["i"]), lambda a: (a["dep"] == "acomp") & (a["pos"] == "ADJ"))


def _under(toks: Column, kids: Column, parents: Column) -> Column:
    """Children of any of ``parents``."""
    return F.flatten(F.transform(parents, lambda p: children(toks, kids, p["i"])))


def _stops(m: Column) -> Column:
    """The mention is the subject of a verb that is not the root: later rules are off."""
    return (
        m["e"]["dep"].isin(*SUBJECTS) & (m["h"]["pos"] == "VERB") & (m["h"]["dep"] != "ROOT")
    )


def _verb_rules(m: Column, joined: Column, toks: Column, kids: Column, aux: Column) -> Column:
    e, h, hh = m["e"], m["h"], m["hh"]

    def conjuncts_of(verb: Column) -> Column:
        return lemmas(_conjuncts(children(toks, kids, verb["i"]), "VERB"))

    governs = m["mod"] & (h["dep"] == "nsubj") & (hh["pos"] == "VERB")
    active = only_if(
        governs, F.concat(F.array(low(hh["lemma"])), conjuncts_of(hh))
    )
    after_adjective = lemmas(_conjuncts(joined, "VERB"))
    clauses = children(
        toks,
        kids,
        h["i"],
        lambda c: (c["pos"] == "VERB")
        & c["dep"].isin("acl", "relcl")
        & ~F.exists(children(toks, kids, c["i"]), lambda g: g["dep"].isin(*SUBJECTS)),
    )
    clausal = only_if(m["mod"], lemmas(clauses))
    is_subject = e["dep"].isin(*SUBJECTS) & (h["pos"] == "VERB") & (h["dep"] == "ROOT")
    participle = low(h["text"]).endswith("ing") & has_children(aux, h["i"])
    own = only_if(
        is_subject & ~participle,
        F.concat(F.array(low(h["lemma"])), conjuncts_of(h)),
    )
    agent = only_if(
        ~_stops(m) & (e["dep"] == "pobj") & (h["dep"] == "agent") & (hh["pos"] == "VERB"),
        F.array(low(hh["lemma"])),
    )
    return F.concat(active, after_adjective, clausal, own, agent)


def _copula_adjective_rule(acomps: Column, joined: Column) -> Column:
    return F.concat(lemmas(acomps), lemmas(_conjuncts(joined, "ADJ")))


def _may_be_adjective(t: Column, toks: Column, lexicon: Lexicon | None) -> Column:
    """Gates every adjective candidate passes, whatever the mention."""
    lemma = low(t["lemma"])
    # Cheap and selective first: only these can pass, or open a hyphen span.
    possible = t["pos"].isin("ADJ", "VERB") | (F.get(toks, t["i"] + 1)["text"] == "-")
    return (
        F.coalesce(possible, F.lit(False))
        & ~t["pos"].isin(*params.NEVER_ADJECTIVE_POS)
        & _lexicon_group(lemma, lexicon).isNull()
        & ~lemma.isin(*params.INTENSIFIERS, *params.CATEGORY_WORDS)
        & ~low(t["text"]).isin(*params.ORDINAL_SUFFIXES)
    )


def _free_for(t: Column, m: Column, toks: Column) -> Column:
    """Not the mention itself, and not on a noun other than the mention and its head."""
    th = head(toks, t)
    on_other_noun = (
        (th["pos"] == "NOUN")
        & ~((th["dep"] == "attr") & (th["head"] == m["h"]["i"]))
        & ~th["i"].isin(m["e"]["i"], m["h"]["i"])
    )
    return (t["i"] != m["e"]["i"]) & ~on_other_noun


def _adjective_marks(toks: Column, lexicon: Lexicon | None) -> Column:
    """What the adjective rules ask of a sentence, once for all mentions.

    ``gate``: the tokens that may be adjectives; ``openers``: those that open a hyphen span; ``stops``:
    a letter for each token, ``x`` for verbs and nouns.
    """
    letters = F.transform(toks, lambda t: F.when(t["pos"].isin("VERB", "NOUN"), "x").otherwise("."))

    def marks(gate: Column) -> Column:
        openers = F.filter(toks, lambda t: F.get(gate, t["i"]) & _opens_hyphen(t, toks))
        return F.struct(gate.alias("gate"), openers.alias("openers"), F.array_join(letters, "").alias("stops"))

    return let(F.transform(toks, lambda t: _may_be_adjective(t, toks, lexicon)), marks)


def _opens_hyphen(t: Column, toks: Column) -> Column:
    """Token, hyphen, adjective-like token."""
    dash, right = token(toks, t["i"] + 1), token(toks, t["i"] + 2)
    return F.coalesce(
        t["pos"].isin("ADJ", "ADV", "PROPN")
        & (dash["text"] == "-")
        & (
            (right["pos"] == "ADJ")
            | right["tag"].isin("VBG", "VBN")
            | low(right["text"]).endswith("ing")
        ),
        F.lit(False),
    )


def _hyphen_starts(openers: Column) -> Column:
    """Positions of accepted hyphen spans, left to right without overlap."""
    return F.aggregate(
        F.transform(openers, lambda t: t["i"]),
        F.array().cast("array<int>"),
        lambda taken, i: F.when(F.try_element_at(taken, F.lit(-1)) >= i - 2, taken).otherwise(
            F.array_append(taken, i)
        ),
    )


def _predicates(t: Column, e: Column, toks: Column) -> Column:
    """``t`` is the adjectival complement of a copula whose subject is ``e``."""
    return (t["dep"] == "acomp") & (head(toks, t)["lemma"] == "be") & is_subject_of(e, t["head"])


def _hyphen_rule(e: Column, starts: Column, toks: Column) -> Column:
    def linked(i: Column) -> Column:
        t = token(toks, i)
        copula = head(toks, head(toks, t))
        return ((copula["lemma"] == "be") & is_subject_of(e, copula["i"])) | (t["head"] == e["i"])

    def joined(i: Column) -> Column:
        both = F.concat(token(toks, i)["text"], token(toks, i + 2)["text"])
        return low(F.replace(both, F.lit("-"), F.lit("")))

    return F.transform(F.filter(starts, linked), joined)


def _plain_rule(m: Column, starts: Column, marks: Column, toks: Column, kids: Column) -> Column:
    """Only tokens that a link or the text can tie to the mention are looked at."""
    e, h = m["e"], m["h"]
    # The first verb or noun after the mention ends the fragment that begins with it.
    found = F.call_function("locate", F.lit("x"), marks["stops"], e["i"] + 2)
    end = F.when(found > 0, found - 1).otherwise(F.size(toks) - 1)

    def consumed(t: Column) -> Column:
        return F.exists(starts, lambda s: t["i"].between(s, s + 2))

    def adjective_like(t: Column) -> Column:
        participle = (t["pos"] == "VERB") & t["tag"].isin("VBG", "VBN")
        linked = ((t["dep"] == "amod") & (t["head"] == e["i"])) | (
            (e["dep"] == "nsubj") & (t["dep"] == "acomp")
        )
        return (t["pos"] == "ADJ") | (participle & linked)

    def attached(t: Column) -> Column:
        th = head(toks, t)
        coordinated = (t["dep"] == "conj") & (th["pos"] == "ADJ") & _predicates(th, e, toks)
        attributive = (t["dep"] == "amod") & t["head"].isin(h["i"], e["i"])
        fragment = t["i"].between(e["i"] + 1, end)
        return _predicates(t, e, toks) | coordinated | attributive | fragment

    beside = child_positions(kids, h["i"])
    below = F.flatten(
        F.transform(children(toks, kids, h["i"], lambda t: t["dep"] == "acomp"), lambda t: child_positions(kids, t["i"]))
    )
    after = F.when(end > e["i"], F.sequence(e["i"] + 1, end)).otherwise(F.array().cast("array<int>"))
    near = F.concat(child_positions(kids, e["i"]), F.array(h["i"]), beside, below, after)
    passing = F.filter(F.array_distinct(near), lambda i: F.get(marks["gate"], i))
    kept = F.filter(
        F.transform(passing, lambda i: F.get(toks, i)),
        lambda t: _free_for(t, m, toks) & adjective_like(t) & ~consumed(t) & attached(t),
    )
    return F.transform(kept, lambda t: T.clean_term(low(t["lemma"])))


KINDS = ("nouns", "verbs", "adjs")


def collect_modifiers(
    annotated: DataFrame, lexicon: Lexicon | None = None, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """(doc_id, sent_id, grp, nouns, verbs, adjs): distinct modifiers per sentence and group.

    Without a lexicon each sentence uses its own ``overlap`` terms (and their
    plurals) as lexicon.  Rules of kinds not asked for don't run; their lists are empty.
    """
    toks, kids, aux = F.col("toks"), F.col("kids"), F.col("aux")
    ctx = mention_context(annotated, lexicon).select("doc_id", "sent_id", "toks", "kids", "aux", "ms", *_overlap(lexicon))
    none = F.array().cast("array<string>")

    def adjectives(m: Column, acomps: Column, joined: Column, marks: Column) -> Column:
        openers = F.filter(marks["openers"], lambda t: _free_for(t, m, toks))

        def rules(starts: Column) -> Column:
            return F.concat(_hyphen_rule(m["e"], starts, toks), _plain_rule(m, starts, marks, toks, kids))

        free = F.when(_stops(m), none).otherwise(let(_hyphen_starts(openers), rules))
        return F.concat(_copula_adjective_rule(acomps, joined), free)

    def collected(m: Column, marks: Column) -> Column:
        def lists(acomps: Column, joined: Column) -> Column:
            found = {
                "nouns": lambda: _noun_rules(m, toks, kids),
                "verbs": lambda: _verb_rules(m, joined, toks, kids, aux),
                "adjs": lambda: adjectives(m, acomps, joined, marks),
            }
            return F.struct(m["grp"].alias("grp"), *[(F.array_distinct(found[k]()) if k in kinds else none).alias(k) for k in KINDS])

        if tuple(kinds) == ("nouns",):
            return lists(none, none)
        return let(_copula_adjectives(m, toks, kids), lambda acomps: let(_under(toks, kids, acomps), lambda j: lists(acomps, j)))

    marks = _adjective_marks(toks, lexicon) if "adjs" in kinds else F.lit(None)
    hits = let(marks, lambda s: F.transform("ms", lambda m: collected(m, s)))
    return fold_by_group(ctx.select("doc_id", "sent_id", hits.alias("hits")))


def _overlap(lexicon: Lexicon | None) -> list[str]:
    return [] if lexicon is not None else ["overlap"]


def fold_by_group(hits: DataFrame) -> DataFrame:
    """Union of the mentions' word sets per group, inside the row, then one row per group."""

    def union_of(grp: Column, field: str) -> Column:
        same = F.filter("hits", lambda m: m["grp"] == grp)
        words = F.flatten(F.transform(same, lambda m: m[field]))
        return F.array_sort(F.array_distinct(words)).alias(field)

    groups = F.array_distinct(F.transform("hits", lambda m: m["grp"]))
    folded = F.transform(
        groups,
        lambda g: F.struct(
            g.alias("grp"), union_of(g, "nouns"), union_of(g, "verbs"), union_of(g, "adjs")
        ),
    )
    return hits.select("doc_id", "sent_id", F.explode(folded).alias("u")).select(
        "doc_id", "sent_id", "u.*"
    )


def window_modifiers(
    sents: DataFrame, lexicon: Lexicon | None = None, window: int = params.WINDOW
) -> DataFrame:
    """Same output from plain context windows: content words near each mention.

    Words longer than two letters that are not function words, classed by suffix.  Without a lexicon the
    row's ``overlap`` terms are the lexicon.
    """
    toks = F.col("tokens")
    named = lambda t: T.is_term(t, lexicon) if lexicon else F.array_contains("overlap", t)
    at = F.filter(
        F.transform(toks, lambda t, i: F.struct(i.alias("i"), F.when(named(t), t).alias("grp"))),
        lambda m: m["grp"].isNotNull(),
    )

    def near(m: Column) -> Column:
        start = F.greatest(F.lit(0), m["i"] - window)
        left = F.slice(toks, start + 1, m["i"] - start)
        right = F.slice(toks, m["i"] + 2, F.lit(window))
        content = F.filter(
            F.concat(left, right),
            lambda w: (F.length(w) > 2) & ~w.isin(list(params.FUNCTION_WORDS)),
        )
        return F.struct(m["grp"].alias("grp"), content.alias("words"))

    def by_class(m: Column, pos: str) -> Column:
        return F.filter(m["words"], lambda w: word_class(w) == pos)

    hits = sents.select("doc_id", "sent_id", "tokens", at.alias("at")).select(
        "doc_id", "sent_id", F.transform("at", near).alias("near")
    )
    hits = hits.select(
        "doc_id",
        "sent_id",
        F.transform(
            "near",
            lambda m: F.struct(
                m["grp"].alias("grp"),
                by_class(m, "noun").alias("nouns"),
                by_class(m, "verb").alias("verbs"),
                by_class(m, "adj").alias("adjs"),
            ),
        ).alias("hits"),
    )
    return fold_by_group(hits)


def word_class(w: Column) -> Column:
    """verb, adj, adverb or noun from the suffix alone."""
    n = F.length(w)
    return (
        F.when((n > 4) & (w.endswith("ing") | w.endswith("ed")), "verb")
        .when((n > 3) & w.endswith("ly"), "adverb")
        .when((n > 3) & w.endswith("ble"), "adj")
        .otherwise("noun")
    )


def modifier_terms(modifiers: DataFrame) -> DataFrame:
    """Long form (doc_id, sent_id, grp, pos, term) of collected modifiers."""

    def labelled(pos: str, column: str) -> Column:
        return F.transform(column, lambda t: F.struct(F.lit(pos).alias("pos"), t.alias("term")))

    every = F.concat(labelled("noun", "nouns"), labelled("verb", "verbs"), labelled("adj", "adjs"))
    return modifiers.select("doc_id", "sent_id", "grp", F.explode(every).alias("x")).select(
        "doc_id", "sent_id", "grp", "x.pos", "x.term"
    )


def fold_documents(modifiers: DataFrame) -> DataFrame:
    """Union of the sentence sets per document and group (unit = document)."""

    def union_of(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)

    return modifiers.groupBy("doc_id", "grp").agg(
        union_of("nouns"), union_of("verbs"), union_of("adjs")
    )
