"""Token annotation: parses of an outside parser, as a function or as a table of tokens.

``surface_annotate`` is no parser: it fills the token schema from word shapes, as feed for tests
and for the registered queries.

A sentence row carries ``toks``: array<struct<i, text, lemma, pos, tag, dep, head,
ent>>, heads being positions in the same array (a root points to itself).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.functions.arrays import unnest
from epithet.params import Lexicon

TOKEN_TYPE = (
    "array<struct<i:int,text:string,lemma:string,pos:string,tag:string,"
    "dep:string,head:int,ent:string>>"
)


def _pos(w: Column, lexicon: Lexicon) -> Column:
    n = F.length(w)
    return (
        F.when(w.isin(list(lexicon.surfaces)), "PROPN")
        .when(w.isin(list(params.DETERMINERS)), "DET")
        .when(w.isin(list(params.AUXILIARIES)), "AUX")
        .when(w.isin(list(params.CONJUNCTIONS)), "CCONJ")
        .when(w.isin(list(params.ADPOSITIONS)), "ADP")
        .when(w.isin(list(params.PRONOUNS)), "PRON")
        .when(w.rlike("^[0-9]+$"), "NUM")
        .when((n > 4) & (w.endswith("ing") | w.endswith("ed")), "VERB")
        .when((n > 3) & w.endswith("ly"), "ADV")
        .when((n > 3) & w.endswith("ble"), "ADJ")
        .otherwise("NOUN")
    )


def _at(values: Column, i: Column) -> Column:
    """Element at a position, or the empty string beyond either end."""
    return F.coalesce(F.get(values, i), F.lit(""))


def _tag(w: Column, pos: Column, next_pos: Column) -> Column:
    tags = {
        "PROPN": "NNP", "DET": "DT", "AUX": "VBZ", "CCONJ": "CC", "ADP": "IN",
        "PRON": "PRP", "NUM": "CD", "ADV": "RB", "ADJ": "JJ", "NOUN": "NN",
    }
    out = F.when((pos == "VERB") & w.endswith("ing"), "VBG")
    out = out.when((pos == "VERB") & (next_pos == "NOUN"), "VBN").when(pos == "VERB", "VBD")
    for name, tag in tags.items():
        out = out.when(pos == name, tag)
    return out


def _lemma(w: Column, pos: Column) -> Column:
    n = F.length(w)
    return (
        F.when(pos == "AUX", "be")
        .when((pos == "VERB") & w.endswith("ing"), F.substring(w, F.lit(1), n - 3))
        .when(pos == "VERB", F.substring(w, F.lit(1), n - 2))
        .otherwise(w)
    )


def _attach(x: Column, root: Column) -> Column:
    """struct<dep, head> of token ``x`` from its two neighbours on either side."""
    i, p, t = x["i"], x["p"], x["t"]
    p1, p2, b1, b2 = x["p1"], x["p2"], x["b1"], x["b2"]
    predicate_next = (p1 == "AUX") | ((p1 == "VERB") & (x["t1"] != "VBG"))
    name = p == "PROPN"

    def edge(dep: str, head: Column) -> Column:
        return F.struct(F.lit(dep).alias("dep"), head.cast("int").alias("head"))

    modifier = (
        F.when(p1 == "NOUN", edge("amod", i + 1))
        .when(~name & (p1 == "PROPN") & (p2 == "NOUN"), edge("amod", i + 2))
        .when(~name & (p1 == "PROPN"), edge("amod", i + 1))
        .when(name & predicate_next, edge("nsubj", i + 1))
        .when(name & (x["w1"] == "by") & (b2 == "VERB"), edge("pobj", i - 1))
        .when((p == "ADJ") & (b1 == "AUX"), edge("acomp", i - 1))
    )
    other = (
        F.when((p == "NOUN") & predicate_next, edge("nsubj", i + 1))
        .when((p == "NOUN") & (b1 == "AUX"), edge("attr", i - 1))
        .when((t == "VBG") & (b1 == "NOUN"), edge("acl", i - 1))
        .when((x["w"] == "by") & (b1 == "VERB"), edge("agent", i - 1))
    )
    joined = F.when((b1 == "CCONJ") & (b2 == p), edge("conj", i - 2)).otherwise(edge("dep", root))
    return F.when(i == root, edge("ROOT", root)).otherwise(
        F.coalesce(F.when(p.isin("PROPN", "ADJ") | (t == "VBN"), modifier).otherwise(other), joined)
    )


def surface_annotate(sents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Deterministic annotation from word shape and neighbours; no model, no shuffle.

    Input: ``tokens`` array per sentence.  A stand-in for a parser: it fills the
    token schema so that the collectors can run on any text.
    """
    keep = sents.columns
    pos, tag = F.col("_pos"), F.col("_tag")
    staged = sents.select(*keep, F.transform("tokens", lambda w: _pos(w, lexicon)).alias("_pos"))
    tags = F.transform("tokens", lambda w, i: _tag(w, F.get(pos, i), _at(pos, i + 1)))
    staged = staged.select("*", tags.alias("_tag"))
    finite = F.transform(
        pos, lambda p, i: p.isin("AUX", "VERB") & ~F.get(tag, i).isin("VBN", "VBG")
    )
    root = F.greatest(F.lit(0), (F.array_position(finite, F.lit(True)) - 1).cast("int"))
    around = F.transform(
        "tokens",
        lambda w, i: F.struct(
            i.alias("i"),
            w.alias("w"),
            F.get(pos, i).alias("p"),
            F.get(tag, i).alias("t"),
            _at(pos, i + 1).alias("p1"),
            _at(tag, i + 1).alias("t1"),
            _at(pos, i + 2).alias("p2"),
            _at(pos, i - 1).alias("b1"),
            _at(pos, i - 2).alias("b2"),
            _at(F.col("tokens"), i - 1).alias("w1"),
        ),
    )
    staged = staged.select(*keep, root.alias("_root"), around.alias("_around"))
    attached = F.transform(
        "_around", lambda x: F.struct(x.alias("x"), _attach(x, F.col("_root")).alias("e"))
    )
    toks = F.transform(
        attached,
        lambda a: F.struct(
            a["x"]["i"].alias("i"),
            a["x"]["w"].alias("text"),
            _lemma(a["x"]["w"], a["x"]["p"]).alias("lemma"),
            a["x"]["p"].alias("pos"),
            a["x"]["t"].alias("tag"),
            a["e"]["dep"].alias("dep"),
            a["e"]["head"].alias("head"),
            F.when(a["x"]["p"] == "PROPN", "NORP").otherwise("").alias("ent"),
        ),
    )
    return staged.select(*keep, toks.alias("toks"))


def external_annotate(
    parse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
) -> Callable[[DataFrame, Lexicon], DataFrame]:
    """An annotator for jobs from a user's parser.

    ``parse`` gets Arrow batches with all columns of the mention sentences (``sentence`` among them)
    and yields them with a column ``toks``; load the model once at the top of the generator.
    """

    def annotate(sents: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
        plain = sents.drop("toks")
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
        return plain.mapInPandas(parse, ", ".join([*fields, f"toks {TOKEN_TYPE}"]))

    return annotate


SENTENCE = ("doc_id", "sent_id")


def write_token_table(tokens: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save parsed tokens by sentence: bucketed by (doc_id, sent_id) and sorted within the buckets.

    Whoever gathers sentences from this table, or joins it by sentence, reads the buckets as they lie:
    the tokens are not shuffled again.  Choose ``buckets`` so that one fits a task.
    """
    spread = tokens.repartition(buckets, *SENTENCE)
    writer = spread.write.mode("overwrite").bucketBy(buckets, *SENTENCE).sortBy(*SENTENCE, "i")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return tokens.sparkSession.table(table)


def token_table_annotate(tokens: DataFrame) -> Callable[[DataFrame, Lexicon], DataFrame]:
    """An annotator for jobs from a table of parsed tokens, best one of ``write_token_table``.

    ``tokens`` has one row per token: doc_id, sent_id, i, text, lemma, pos, tag, dep, head, ent.
    A sentence's tokens are put in one row; sentences without parses drop out.
    """
    fields = ("i", "text", "lemma", "pos", "tag", "dep", "head", "ent")
    of_type = F.sort_array(F.collect_list(F.struct(*fields))).cast(TOKEN_TYPE)
    parsed = tokens.groupBy(*SENTENCE).agg(of_type.alias("toks"))

    def annotate(sents: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
        return sents.drop("toks").join(parsed, list(SENTENCE))

    return annotate


def parsed_sentences(tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Annotated mention sentences from a table of parsed tokens alone, ready for the collectors.

    ``overlap`` lists the lexicon's terms among a sentence's lower-case texts and lemmas.
    """
    sents = token_table_annotate(tokens)(tokens.select("doc_id", "sent_id").distinct(), lexicon)
    forms = F.concat(
        F.transform("toks", lambda t: T.normalize_form(t["text"])),
        F.transform("toks", lambda t: T.normalize_form(t["lemma"])),
    )
    groups = F.transform(forms, lambda w: T.group_of(w, lexicon))
    overlap = F.array_distinct(F.filter(groups, lambda g: g.isNotNull()))
    lowered = F.transform("toks", lambda t: T.normalize_form(t["text"]))
    return sents.select(
        "doc_id", "sent_id", F.array_join(F.transform("toks", lambda t: t["text"]), " ").alias("sentence"),
        lowered.alias("tokens"), overlap.alias("overlap"), "toks",
    ).where(F.size("overlap") > 0)


def token_rows(annotated: DataFrame) -> DataFrame:
    """Exploded view: one row per token."""
    return annotated.select("doc_id", "sent_id", unnest("toks").alias("t")).select(
        "doc_id", "sent_id", "t.*"
    )
