"""Navigation in a sentence's token array (``toks``, see ``annotate``).

Heads are array positions, so a parent is one ``get``.  ``index`` sorts the positions by head once per
sentence, like a sparse matrix by rows: the children of a token are a slice.  ``spans`` numbers the
tokens by one walk around the trees, so "in the subtree of" is two comparisons.  Nothing here needs a
join or a shuffle, and the work grows with the sentence, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epithet.functions.arrays import let

SUBJECTS = ("nsubj", "nsubjpass")
NAMING = ("NOUN", "PROPN")
MODIFYING = ("amod", "compound")

# Two numbers in one: the upper half is the sort key, the lower half what it leads to.
HALF = 32
LOWER = (1 << HALF) - 1


def low(c: Column) -> Column:
    return F.lower(c)


def token(toks: Column, i: Column) -> Column:
    return F.get(toks, i)


def head(toks: Column, t: Column) -> Column:
    return F.get(toks, t["head"])


def is_child(c: Column, of: Column) -> Column:
    """``c`` hangs on position ``of``; a root is not its own child."""
    return (c["head"] == of) & (c["i"] != of)


def is_subject_of(t: Column, of: Column) -> Column:
    return is_child(t, of) & t["dep"].isin(*SUBJECTS)


def maybe(test: Column) -> Column:
    """False only where the test is: a null may not drop what a later test has to see."""
    return F.coalesce(test, F.lit(True))


def lemmas(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: low(t["lemma"]))


def only_if(condition: Column, values: Column) -> Column:
    """``values`` where the condition holds, else an empty array of strings."""
    return F.when(condition, values).otherwise(F.array().cast("array<string>"))


def _pair(key: Column, value: Column) -> Column:
    return F.shiftleft(key.cast("bigint"), HALF) + value


def _key(pair: Column) -> Column:
    return F.shiftright(pair, HALF).cast("int")


def _value(pair: Column) -> Column:
    return pair.bitwiseAND(LOWER).cast("int")


def _hangs(t: Column) -> Column:
    """False for a root; null for a token without a head."""
    return t["head"] != t["i"]


# ---------------------------------------------------------------------------
# Children
# ---------------------------------------------------------------------------


def index(toks: Column, test=None) -> Column:
    """struct<order, starts>: positions by head, and where each head's run begins.

    Each head has an entry of its own (value 0) before those of its children (position + 1).  With a
    ``test`` only the tokens that pass are listed.
    """
    listed = F.filter(toks, lambda t: _hangs(t) & test(t) if test else _hangs(t))
    entries = F.transform(listed, lambda t: _pair(t["head"], t["i"] + 1))
    heads = F.transform(F.sequence(F.lit(0), F.size(toks)), lambda i: _pair(i, F.lit(0)))

    def with_starts(order: Column) -> Column:
        places = F.transform(order, lambda x, j: F.when(_value(x) == 0, j))
        starts = F.filter(places, lambda j: j.isNotNull())
        return F.struct(order.alias("order"), starts.alias("starts"))

    return let(F.sort_array(F.concat(entries, heads)), with_starts)


def child_positions(idx: Column, of: Column) -> Column:
    start = F.get(idx["starts"], of)
    n = F.get(idx["starts"], of + 1) - start - 1
    run = F.transform(F.slice(idx["order"], start + 2, n), lambda x: _value(x) - 1)
    return F.coalesce(run, F.array().cast("array<int>"))


def children(toks: Column, idx: Column, of: Column, test=None) -> Column:
    """Tokens that hang on position ``of``, in order."""
    found = F.transform(child_positions(idx, of), lambda i: F.get(toks, i))
    return F.filter(found, test) if test else found


def has_children(idx: Column, of: Column) -> Column:
    """Whether anything listed hangs on position ``of``, from the starts alone."""
    return F.coalesce(F.get(idx["starts"], of + 1) - F.get(idx["starts"], of) > 1, F.lit(False))


# ---------------------------------------------------------------------------
# Subtrees
# ---------------------------------------------------------------------------


def _follow(links: Column, size: Column, step) -> Column:
    """``links`` after as many rounds of ``step`` as double a path of one link to ``size``."""
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)
    return F.aggregate(rounds, links, lambda now, _r: F.transform(now, lambda x: step(now, x)))


def spans(toks: Column, idx: Column) -> Column:
    """array<struct<enter, leave>> per token; a subtree's spans lie within that of its top.

    A walk goes down into a token and up out of it, twice as many stops as tokens.  Each stop knows
    the next one from the index; doubling the links in rounds gives every stop its distance to the
    walk's end.  A token whose heads run in a circle has no end to reach: its span is null.
    """
    order, starts = idx["order"], idx["starts"]
    down = lambda i: 2 * i
    up = lambda i: 2 * i + 1

    def listed_after(j: Column) -> Column:
        """Position listed at place ``j + 1`` of the order, or null where a run ends."""
        following = _value(F.get(order, j + 1))
        return F.when(following > 0, following - 1)

    def walk(places: Column) -> Column:
        def stops(t: Column) -> Column:
            i = t["i"]
            first = listed_after(F.get(starts, i))
            into = F.coalesce(down(first), up(i))
            sibling = listed_after(F.get(places, i) - 1)
            back = F.coalesce(down(sibling), up(t["head"]))
            # A root's way up is an end: it leads to itself and adds no distance.
            out = F.when(_hangs(t), _pair(back, F.lit(1))).otherwise(_pair(up(i), F.lit(0)))
            return F.array(_pair(into, F.lit(1)), out)

        return F.flatten(F.transform(toks, stops))

    # Place in the order + 1 of each token, 0 for those not listed (roots), sorted by token.
    listed = F.filter(
        F.transform(order, lambda x, j: F.when(_value(x) > 0, _pair(_value(x) - 1, j + 1))),
        lambda x: x.isNotNull(),
    )
    roots = F.transform(F.filter(toks, lambda t: ~F.coalesce(_hangs(t), F.lit(False))), lambda t: _pair(t["i"], F.lit(0)))
    places = F.transform(F.sort_array(F.concat(listed, roots)), _value)

    def step(now: Column, x: Column) -> Column:
        return F.get(now, _key(x)) + x.bitwiseAND(LOWER)

    def named(ends: Column) -> Column:
        def span(t: Column) -> Column:
            at_down, at_up = F.get(ends, down(t["i"])), F.get(ends, up(t["i"]))
            top = _key(at_up)
            ended = F.get(ends, top) == _pair(top, F.lit(0))
            whole = F.struct(
                top.alias("top"), (-_value(at_down)).alias("enter"), (-_value(at_up)).alias("leave")
            )
            return F.when(ended, whole)

        return F.transform(toks, span)

    def counted(links: Column) -> Column:
        return let(_follow(links, 2 * F.size(toks), step), named)

    return let(places, lambda p: let(walk(p), counted))


def inside(low_span: Column, high_span: Column) -> Column:
    """True where the first token is in the subtree of the second (or is the second)."""
    within = (low_span["enter"] >= high_span["enter"]) & (low_span["leave"] <= high_span["leave"])
    return F.coalesce((low_span["top"] == high_span["top"]) & within, F.lit(False))


# ---------------------------------------------------------------------------
# Subjects
# ---------------------------------------------------------------------------


def subject_index(toks: Column) -> Column:
    """struct<order, starts, found>: the index of subjects alone, and where a climb ends.

    The climb goes through heads that are conj, acomp, attr or AUX until one has subjects.  Links of
    all tokens are doubled in rounds, so a climb is one lookup; one that runs in a circle finds none.
    """

    def with_found(idx: Column) -> Column:
        def link(t: Column) -> Column:
            has = F.size(child_positions(idx, t["i"])) > 0
            passes = t["dep"].isin("conj", "acomp", "attr") | (t["pos"] == "AUX")
            return F.when(~has & passes, t["head"]).otherwise(t["i"])

        found = _follow(F.transform(toks, link), F.size(toks), lambda now, x: F.get(now, x))
        return F.struct(idx["order"].alias("order"), idx["starts"].alias("starts"), found.alias("found"))

    return let(index(toks, lambda t: t["dep"].isin(*SUBJECTS)), with_found)


def subjects_of_predicate(subjects: Column, pred: Column) -> Column:
    """Positions of a predicate's subjects: its own, else the nearest found by climbing."""
    own = child_positions(subjects, pred["i"])
    climbed = child_positions(subjects, F.get(subjects["found"], pred["head"]))
    return F.when(F.size(own) > 0, own).otherwise(climbed)
