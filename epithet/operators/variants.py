"""Earlier collectors: counted modifiers, subtree links, entity-based counts, edges.

All read annotated sentences and count with one aggregation on (group, term).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.functions.arrays import let
from epithet.operators.rules import mention_context
from epithet.operators.tree import (
    MODIFYING,
    NAMING,
    children,
    head,
    index,
    inside,
    is_child,
    is_subject_of,
    lemmas,
    low,
    only_if,
    spans,
    subject_index,
    subjects_of_predicate,
    token,
)
from epithet.params import Lexicon


def _pairs(grp: Column, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(grp.alias("grp"), t.alias("term")))


def _count_pairs(df: DataFrame, pairs: Column) -> DataFrame:
    """Counts of (grp, term) over arrays of such pairs."""
    return (
        df.select(F.explode(pairs).alias("x"))
        .groupBy(F.col("x.grp").alias("grp"), F.col("x.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _count_per_mention(annotated: DataFrame, lexicon: Lexicon, terms) -> DataFrame:
    ctx = mention_context(annotated, lexicon)
    per_mention = F.transform("ms", lambda m: _pairs(m["grp"], terms(m)))
    return _count_pairs(ctx, F.flatten(per_mention))


def count_nouns(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Nouns a group modifies or is modified by, once per mention."""

    def nouns(m: Column) -> Column:
        attached = children(
            F.col("toks"),
            F.col("kids"),
            m["e"]["i"],
            lambda c: c["pos"].isin(*NAMING) & c["dep"].isin(*MODIFYING),
        )
        return F.concat(only_if(m["mod"], F.array(low(m["h"]["lemma"]))), lemmas(attached))

    return _count_per_mention(annotated, lexicon, nouns)


def count_verbs(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Verbs whose active subject is the group or a noun it modifies."""

    def verbs(m: Column) -> Column:
        e, h, hh = m["e"], m["h"], m["hh"]
        through = m["mod"] & (h["dep"] == "nsubj") & (hh["pos"] == "VERB")
        direct = (e["dep"] == "nsubj") & (h["pos"] == "VERB")
        return F.concat(
            only_if(through, F.array(low(hh["lemma"]))), only_if(direct, F.array(low(h["lemma"])))
        )

    return _count_per_mention(annotated, lexicon, verbs)


def count_adjectives(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adjectives that modify the group's head or predicate over the group."""
    toks, kids = F.col("toks"), F.col("kids")
    ctx = mention_context(annotated, lexicon)

    def above_such(tree: Column) -> Column:
        """The spans of all tokens, and of those that read ``such``."""
        such = F.transform(F.filter(toks, lambda t: low(t["text"]) == "such"), lambda t: F.get(tree, t["i"]))
        return F.struct(tree.alias("all"), such.alias("such"))

    holds_such = F.exists(toks, lambda t: low(t["text"]) == "such")
    enumerating = F.when(holds_such, let(index(toks), lambda every: let(spans(toks, every), above_such)))

    def listed(t: Column, tree: Column) -> Column:
        th = head(toks, t)
        in_list = (t["dep"] == "conj") & th["pos"].isin("NOUN", "ADJ")
        over = F.exists(tree["such"], lambda s: inside(s, F.get(tree["all"], th["i"])))
        return in_list | ((th["pos"] == "NOUN") & F.coalesce(over, F.lit(False)))

    def hyphenated(t: Column) -> Column:
        dash, right = token(toks, t["i"] + 1), token(toks, t["i"] + 2)
        return F.coalesce(
            (dash["text"] == "-") & right["pos"].isin("ADJ", "VERB"), F.lit(False)
        )

    def applies(t: Column, e: Column) -> Column:
        modifies = (t["dep"] == "amod") & (t["head"] == e["head"])
        predicates = t["dep"].isin("acomp", "attr") & is_subject_of(e, t["head"])
        return modifies | predicates

    def kept(m: Column, tree: Column) -> Column:
        e = m["e"]
        # Whatever applies hangs on the head of the mention, or is that head.
        return F.filter(
            F.concat(F.array(m["h"]), children(toks, kids, m["h"]["i"])),
            lambda t: (t["pos"] == "ADJ")
            & (t["i"] != e["i"])
            & (t["ent"] != "NORP")
            & ~low(t["lemma"]).isin(*params.COUNTED_INTENSIFIERS, *params.COUNTED_CATEGORY_WORDS)
            & ~low(t["lemma"]).isin(list(lexicon.surfaces))
            & ~listed(t, tree)
            & applies(t, e),
        )

    def spelled(t: Column) -> Column:
        joined = F.concat(low(t["text"]), F.lit("-"), low(token(toks, t["i"] + 2)["text"]))
        plain = T.clean_term(low(t["lemma"]), collapse_hyphens=True)
        return F.when(hyphenated(t), joined).otherwise(plain)

    def pairs(tree: Column) -> Column:
        return F.flatten(F.transform("ms", lambda m: _pairs(m["grp"], F.transform(kept(m, tree), spelled))))

    return _count_pairs(ctx, let(enumerating, pairs))


# ---------------------------------------------------------------------------
# Subtree links
# ---------------------------------------------------------------------------


def _with_mention_spans(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``spans``, and ``mp``: per mention (by surface form) its group and its span."""
    toks = F.col("toks")
    found = F.filter(
        F.transform(
            toks, lambda t: F.struct(t["i"].alias("i"), T.group_of(low(t["text"]), lexicon).alias("grp"))
        ),
        lambda m: m["grp"].isNotNull(),
    )

    def of_sentence(tree: Column) -> Column:
        mentions = F.transform(
            found, lambda m: F.struct(m["grp"].alias("grp"), F.get(tree, m["i"]).alias("span"))
        )
        return F.struct(tree.alias("spans"), mentions.alias("mp"))

    both = let(index(toks), lambda kids: let(spans(toks, kids), of_sentence))
    staged = annotated.select("doc_id", "sent_id", "toks", both.alias("_tree"))
    return staged.select("doc_id", "sent_id", "toks", "_tree.spans", "_tree.mp")


def _predicates(df: DataFrame, test) -> DataFrame:
    """Adds ``preds``: the tokens passing ``test`` with their subjects' positions."""
    toks = F.col("toks")

    def found(subjects: Column) -> Column:
        return F.transform(
            F.filter(toks, test),
            lambda t: F.struct(
                t["i"].alias("i"),
                low(t["lemma"]).alias("lemma"),
                t["dep"].alias("dep"),
                t["head"].alias("head"),
                subjects_of_predicate(subjects, t).alias("subs"),
            ),
        )

    return df.select("*", let(subject_index(toks), found).alias("preds"))


def _below(position: Column, lemma: Column) -> Column:
    """(group, lemma) for every mention in the subtree of a position."""
    within = F.filter("mp", lambda m: inside(m["span"], F.get(F.col("spans"), position)))
    return F.transform(within, lambda m: F.struct(m["grp"].alias("grp"), lemma.alias("term")))


def _below_subjects(p: Column) -> Column:
    return F.flatten(F.transform(p["subs"], lambda s: _below(s, p["lemma"])))


def _groups(df: DataFrame) -> Column:
    return F.array_distinct(F.transform("mp", lambda m: m["grp"]))


def _every_group(p: Column) -> Column:
    return F.transform("groups", lambda g: F.struct(g.alias("grp"), p["lemma"].alias("term")))


def _first_filled(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _linked_and_rest(df: DataFrame) -> DataFrame:
    linked = F.transform(
        "preds", lambda p: F.struct(p.alias("p"), _below_subjects(p).alias("linked"))
    )
    return df.select("mp", "spans", _groups(df).alias("groups"), linked.alias("ps"))


def subtree_adjectives(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adjectives counted for every group mention under the predicate's subjects.

    Where no subject leads to a group, every group of the sentence gets the word.
    """

    def countable(t: Column) -> Column:
        lemma = low(t["lemma"])
        return (
            (t["pos"] == "ADJ")
            & (F.length(lemma) > 2)
            & ~T.is_directional(lemma)
            & (t["ent"] != "NORP")
        )

    df = _linked_and_rest(_predicates(_with_mention_spans(annotated, lexicon), countable))
    pairs = F.transform("ps", lambda x: _first_filled(x["linked"], _every_group(x["p"])))
    return _count_pairs(df, F.flatten(pairs))


def subtree_verbs(annotated: DataFrame, lexicon: Lexicon, use_fallback: bool = False) -> DataFrame:
    """Verbs counted for group mentions under their subjects, or under the noun a
    relative or reduced clause hangs on.
    """

    def countable(t: Column) -> Column:
        return (
            t["pos"].isin("VERB", "AUX")
            & ~low(t["lemma"]).isin(*params.SKIPPED_VERBS)
            & t["tag"].isin(*params.VERB_TAGS)
        )

    df = _linked_and_rest(_predicates(_with_mention_spans(annotated, lexicon), countable))

    def pairs_of(x: Column) -> Column:
        p = x["p"]
        clause = p["dep"].isin("relcl", "acl", "acl:relcl")
        rest = _first_filled(x["linked"], _every_group(p))
        alone = F.size("groups") == 1
        main = F.when(alone, rest).otherwise(x["linked"]) if use_fallback else x["linked"]
        return F.when(clause, _below(p["head"], p["lemma"])).otherwise(main)

    return _count_pairs(df, F.flatten(F.transform("ps", pairs_of)))


def predicate_subjects(annotated: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pred, subject) positions for adjectives, verbs and auxiliaries."""
    df = _predicates(annotated, lambda t: t["pos"].isin("ADJ", "VERB", "AUX"))
    every = F.flatten(
        F.transform(
            "preds",
            lambda p: F.transform(
                p["subs"], lambda s: F.struct(p["i"].alias("pred"), s.alias("subject"))
            ),
        )
    )
    return df.select("doc_id", "sent_id", F.explode(every).alias("x")).select(
        "doc_id",
        "sent_id",
        F.col("x.pred").cast("bigint").alias("pred"),
        F.col("x.subject").cast("bigint").alias("subject"),
    )


# ---------------------------------------------------------------------------
# Entity-based collectors
# ---------------------------------------------------------------------------


def mention_cache(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, sent_id, i, grp) of the tokens that name a group by their text, else by their lemma."""

    def named(t: Column) -> Column:
        return F.coalesce(T.group_of(low(t["text"]), lexicon), T.group_of(low(t["lemma"]), lexicon))

    toks = F.transform("toks", lambda t: F.struct(t["i"].cast("bigint").alias("i"), named(t).alias("grp")))
    mentions = F.filter(toks, lambda m: m["grp"].isNotNull())
    return annotated.select("doc_id", "sent_id", F.explode(mentions).alias("m")).select("doc_id", "sent_id", "m.*")


def first_modified_nouns(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Count, over sentences, of the first noun modified by a group or NORP word."""
    toks = F.col("toks")

    def group_word(c: Column) -> Column:
        return c["dep"].isin(*MODIFYING) & (
            (c["ent"] == "NORP") | T.is_term(low(c["text"]), lexicon)
        )

    heads = F.transform(
        F.filter(toks, lambda c: group_word(c) & is_child(c, c["head"])), lambda c: F.get(toks, c["head"])
    )
    positions = F.transform(F.filter(heads, lambda t: t["pos"] == "NOUN"), lambda t: t["i"])
    first = F.transform(
        F.slice(F.sort_array(positions), 1, 1), lambda i: low(F.get(toks, i)["lemma"])
    )
    return (
        annotated.select(F.explode(first).alias("noun"))
        .groupBy("noun")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _named(annotated: DataFrame, lexicon: Lexicon) -> Column:
    """NORP tokens whose text is a lexicon term."""
    return F.filter("toks", lambda t: (t["ent"] == "NORP") & T.is_term(low(t["text"]), lexicon))


def holds_norp(toks: Column) -> Column:
    """True where any token is tagged as a nationality, religious or political group."""
    return F.exists(toks, lambda t: t["ent"] == "NORP")


def _count_per_name(annotated: DataFrame, lexicon: Lexicon, terms) -> DataFrame:
    """Counts of ``terms(e, kids)`` over the named groups ``e`` of all sentences."""

    def pairs(kids: Column) -> Column:
        return F.flatten(
            F.transform(_named(annotated, lexicon), lambda e: _pairs(low(e["text"]), terms(e, kids)))
        )

    return _count_pairs(annotated, let(index(F.col("toks")), pairs))


def norp_verbs(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Verbs that govern a named group or hang on it."""
    toks = F.col("toks")

    def verbs(e: Column, kids: Column) -> Column:
        h = head(toks, e)
        governed = only_if(
            (h["pos"] == "VERB") & h["tag"].isin(*params.VERB_TAGS), F.array(low(h["lemma"]))
        )
        return F.concat(governed, lemmas(children(toks, kids, e["i"], lambda c: c["pos"] == "VERB")))

    return _count_per_name(annotated, lexicon, verbs)


def norp_adjectives(annotated: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adjectives that modify a named group or predicate over it."""
    toks = F.col("toks")

    def adjectives(e: Column, kids: Column) -> Column:
        def usable(c: Column, *deps: str) -> Column:
            return (c["pos"] == "ADJ") & c["dep"].isin(*deps) & ~T.is_directional(low(c["lemma"]))

        h = head(toks, e)
        attributive = children(toks, kids, e["i"], lambda c: usable(c, "amod"))
        predicative = only_if(
            h["pos"].isin("AUX", "VERB") & is_subject_of(e, h["i"]),
            lemmas(children(toks, kids, h["i"], lambda c: usable(c, "acomp", "attr"))),
        )
        return F.concat(lemmas(attributive), predicative)

    return _count_per_name(annotated, lexicon, adjectives)


def entity_counts(annotated: DataFrame, lexicon: Lexicon, top: int | None = 6) -> DataFrame:
    """Named entities that are lexicon terms, most frequent first."""
    named = F.transform(_named(annotated, lexicon), lambda e: low(e["text"]))
    counted = (
        annotated.select(F.explode(named).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    ordered = counted.orderBy(F.desc("cnt"), "entity")
    return ordered.limit(top) if top else ordered


# ---------------------------------------------------------------------------
# Dependency patterns
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EdgePattern:
    """A head by part of speech, and a child by dependency and/or part of speech."""

    name: str
    head_pos: str
    child_deps: tuple[str, ...] = ()
    child_pos: str | None = None


PATTERNS = (
    EdgePattern("verb_subject", "VERB", ("nsubj", "nsubjpass")),
    EdgePattern("verb_agent", "VERB", ("agent",)),
    EdgePattern("adjective_verb", "ADJ", (), "VERB"),
    EdgePattern("adjective_noun", "ADJ", (), "NOUN"),
)


def match_edges(annotated: DataFrame, patterns: Iterable[EdgePattern] = PATTERNS) -> DataFrame:
    """Counts of (pattern, head lemma, child lemma) over all dependency edges."""
    toks = F.col("toks")

    def matches(p: EdgePattern) -> Column:
        def hit(c: Column) -> Column:
            test = is_child(c, c["head"]) & (head(toks, c)["pos"] == p.head_pos)
            if p.child_deps:
                test = test & c["dep"].isin(*p.child_deps)
            return test & (c["pos"] == p.child_pos) if p.child_pos else test

        return F.transform(
            F.filter(toks, hit),
            lambda c: F.struct(
                F.lit(p.name).alias("pattern"),
                low(head(toks, c)["lemma"]).alias("head_lemma"),
                low(c["lemma"]).alias("child_lemma"),
            ),
        )

    every = F.concat(*[matches(p) for p in patterns])
    return (
        annotated.select(F.explode(every).alias("x"))
        .groupBy("x.pattern", "x.head_lemma", "x.child_lemma")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
