"""One statement per registered query."""

from __future__ import annotations

from epithet import params
from epithet.params import TEST_LEXICON as LEX
from oracles import (
    SPACE,
    COMPASS,
    MODIFYING,
    MULTI,
    NAMING,
    SUBJ,
    SURFACES,
    TERMS,
    assemble,
    box,
    child,
    cleaned,
    log_p,
    names,
    one_sample,
    same,
    stopped,
    text,
    word_class,
)

KEYWORD = " OR ".join(
    f"contains(translate(lower(sentence), '-_', '  '), {text(t.replace('_', ' '))})" for t in LEX.terms
)
SINGLE = names(t for t in LEX.terms if "_" not in t)
_EDGE = r"[^\p{L}\p{N}_]"


def tag_score(gap: str) -> str:
    """Distinct single words plus distinct phrases; separators doubled so that matches may touch."""
    spelled = "|".join(
        (gap.join(t.split("_"))) for t in LEX.multiword
    )
    doubled = f"regexp_replace(lower(coalesce(text, '')), '({_EDGE})', '\\1\\1', 'g')"
    phrases = f"regexp_extract_all({doubled}, '(?:^|{_EDGE})({spelled})(?:$|{_EDGE})', 1)"
    words = f"regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')"
    return f"""CAST(len(list_distinct(list_filter({words}, lambda w: w IN {SINGLE})))
        + len(list_distinct({phrases})) AS DOUBLE)"""


TOLERANT, EXACT = tag_score(r"[-_\s]+"), tag_score("  ")

ROWS_TEXT = """SELECT grp, CAST(to_json(adjs) AS VARCHAR) AS adjs, CAST(to_json(verbs) AS VARCHAR) AS verbs,
    CAST(to_json(nouns) AS VARCHAR) AS nouns, cnt, cnt > 1 AS has_dup FROM """
ROWS_PIPED = """array_to_string(adjs, '|') AS adjs, array_to_string(verbs, '|') AS verbs,
    array_to_string(nouns, '|') AS nouns"""
REP = "arg_min(tok, CASE WHEN contains(tok, '_') THEN i ELSE i + 1000000 END)"
WINDOWS = f"""
    SELECT doc_id, sent_id, grp, string_agg(CASE WHEN i = anchor THEN {text(params.MASK)} ELSE tok END, ' ' ORDER BY i)
        AS window_text
    FROM (SELECT t.*, r.grp, (SELECT min(z.i) FROM mtok z WHERE {same('z', 't')} AND z.tok = r.grp) AS anchor
          FROM mtok t JOIN (SELECT doc_id, sent_id, {REP} AS grp FROM mtok WHERE tok IN {TERMS}
                            GROUP BY doc_id, sent_id) r ON {same('r', 't')})
    WHERE i BETWEEN anchor - {params.WINDOW} AND anchor + {params.WINDOW} GROUP BY doc_id, sent_id, grp"""


def rows_from(units: str) -> str:
    return f"""(SELECT grp, adjs, verbs, nouns, count(*) AS cnt FROM {units}
        WHERE len(verbs) + len(adjs) > 0 GROUP BY ALL)"""


def mod_counts(pos: str) -> str:
    return f"SELECT grp, term, count(*) AS cnt FROM x WHERE pos = '{pos}' GROUP BY grp, term"


def both_ends(pairs: str, k: int) -> str:
    a = 0.01
    scored = f"""
        SELECT pos, term, c1, c2,
          (ln((c1 + {a}) / (n1 + {a} * v - c1 - {a})) - ln((c2 + {a}) / (n2 + {a} * v - c2 - {a})))
            / sqrt(1 / (c1 + {a}) + 1 / (c2 + {a})) AS score
        FROM (SELECT *, sum(c1) OVER (PARTITION BY pos) AS n1, sum(c2) OVER (PARTITION BY pos) AS n2,
                count(*) OVER (PARTITION BY pos) AS v FROM ({pairs}))"""
    ends = [
        f"""SELECT CAST({side} AS BIGINT) AS side, *,
            row_number() OVER (PARTITION BY pos ORDER BY score {way}, term) AS rank FROM ({scored})"""
        for side, way in ((1, "DESC"), (2, "ASC"))
    ]
    return f"""SELECT side, pos, rank, term, c1, c2, round(score, 4) AS score
        FROM ({ends[0]} UNION ALL {ends[1]}) WHERE rank <= {k}"""


def words_of(tokens: str, n: str) -> str:
    other = "c2" if n == "c1" else "c1"
    return f"""SELECT tok AS term, count(*) AS {n}, 0 AS {other} FROM {tokens} GROUP BY tok"""


TWO_CORPORA = f"""
    SELECT {word_class('term')} AS pos, term, CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2
    FROM ({words_of('tok0', 'c1')} UNION ALL BY NAME {words_of('c_tok0', 'c2')}) GROUP BY term"""

TARGET_PAIRS = """
    SELECT pos, term, CAST(coalesce(sum(cnt) FILTER (WHERE grp IN ('thon', 'than')), 0) AS BIGINT) AS c1,
        CAST(coalesce(sum(cnt) FILTER (WHERE grp NOT IN ('thon', 'than')), 0) AS BIGINT) AS c2
    FROM cc WHERE pos IN (SELECT pos FROM cc WHERE grp IN ('thon', 'than') GROUP BY pos
                          HAVING count(DISTINCT grp) = 2)
    GROUP BY pos, term"""

EDGES = [
    ("verb_subject", f"h.pos = 'VERB' AND c.dep IN {SUBJ}"),
    ("verb_agent", "h.pos = 'VERB' AND c.dep = 'agent'"),
    ("adjective_verb", "h.pos = 'ADJ' AND c.pos = 'VERB'"),
    ("adjective_noun", "h.pos = 'ADJ' AND c.pos = 'NOUN'"),
]

STATEMENTS = {
    # scans, lexicon, tagging
    "corpus_scan": """
        SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM documents GROUP BY source""",
    "lexicon": f"""
        SELECT s.surface, s.grp, CAST(len(string_split(s.grp, '_')) AS BIGINT) AS n_words,
            count(t.tok) AS cnt
        FROM (VALUES {", ".join(f"({text(a)}, {text(b)})" for a, b in sorted(LEX.groups().items()))}) AS s(surface, grp)
            LEFT JOIN tok t ON t.tok = s.surface GROUP BY s.surface, s.grp""",
    "taxonomy": f"""
        SELECT t.term, category, region, count(r.grp) AS n_sentences FROM tax t LEFT JOIN
            (SELECT replace({REP}, '_', ' ') AS grp FROM mtok WHERE tok IN {TERMS} GROUP BY doc_id, sent_id) r
            ON r.grp = t.term GROUP BY t.term, category, region""",
    "doc_tag_score": f"SELECT doc_id, {TOLERANT} AS score FROM documents",
    "doc_tag_score_exact": f"SELECT doc_id, {EXACT} AS score FROM documents",
    "doc_mix": f"SELECT * FROM (SELECT doc_id, text, {TOLERANT} AS score FROM documents) WHERE score > 0",
    "attr_profile": f"""
        SELECT source, count(*) AS n_records, count(*) FILTER (WHERE {TOLERANT} > 0) AS n_with_attributes
        FROM documents GROUP BY source""",
    "example_finder": f"""
        SELECT t.term, coalesce(min_by(substr(d.text, 1, 100), d.doc_id), 'no example in data') AS example
        FROM (VALUES {", ".join(f"({text(t)})" for t in LEX.terms)}) AS t(term)
            LEFT JOIN documents d ON contains(lower(d.text), t.term) GROUP BY t.term""",
    # text preparation
    "sentence_split": f"""
        SELECT doc_id, sent_id, sentence FROM sent
        WHERE len(regexp_extract_all(sentence, {text(f'[{SPACE}]+')})) < {params.MAX_SENTENCE_WORDS}""",
    "tokens": """
        SELECT s.doc_id, s.sent_id, coalesce(string_agg(t.tok, ' ' ORDER BY t.i), '') AS tokens,
            count(t.tok) AS n_tokens
        FROM sent s LEFT JOIN tok t ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id
        GROUP BY s.doc_id, s.sent_id""",
    "multiword_merge": f"""
        SELECT doc_id, sent_id, string_agg(tok, ' ' ORDER BY i) AS tokens FROM tok
        GROUP BY doc_id, sent_id HAVING bool_or(tok IN {MULTI})""",
    "keyword_sentences": f"SELECT doc_id, sent_id, sentence FROM sent WHERE {KEYWORD}",
    "sentence_budget": f"""
        SELECT doc_id, sent_id, sentence, is_keyword FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, is_keyword ORDER BY sent_id) AS rn,
            count(*) FILTER (WHERE is_keyword) OVER (PARTITION BY doc_id) AS n_kw
          FROM (SELECT *, ({KEYWORD}) AS is_keyword FROM sent))
        WHERE is_keyword OR rn <= greatest(0, least({params.MAX_FILLER_SENTENCES}, {params.MAX_DOC_SENTENCES} - n_kw))""",
    "group_mentions": f"""
        SELECT doc_id, sent_id, {REP} AS grp, count(DISTINCT tok) AS n_groups FROM mtok
        WHERE tok IN {TERMS} GROUP BY doc_id, sent_id""",
    "mention_index": f"""
        SELECT doc_id, sent_id, i, CASE WHEN tok IN {TERMS} THEN tok ELSE tok[:-2] END AS grp
        FROM mtok WHERE tok IN {SURFACES}""",
    "mention_cache": f"""
        SELECT doc_id, sent_id, i, CASE WHEN form IN {TERMS} THEN form ELSE form[:-2] END AS grp
        FROM (SELECT *, CASE WHEN text IN {SURFACES} THEN text ELSE lemma END AS form FROM ann)
        WHERE form IN {SURFACES}""",
    "masked_window": WINDOWS,
    "clean_lemmas": f"""
        SELECT doc_id, sent_id, coalesce(string_agg(lemma, ' ' ORDER BY i) FILTER
            (WHERE regexp_full_match(text, '\\p{{L}}+') AND text NOT IN {names(params.FUNCTION_WORDS)}), '') AS lemmas
        FROM ann GROUP BY doc_id, sent_id""",
    "clean_terms": f"""
        SELECT term, {cleaned('term')} AS cleaned, regexp_matches(term, '{COMPASS}') AS is_directional,
            {stopped('term')} AS is_stopped
        FROM (SELECT DISTINCT tok AS term FROM tok0)""",
    "parse_lists": f"SELECT replace(grp, '_', ' ') AS grp, {ROWS_PIPED}, cnt FROM wrows",
    "annotate": "SELECT doc_id, sent_id, i, text, lemma, pos, tag, dep, head, ent FROM ann",
    # extraction
    "mod_nouns": mod_counts("noun"),
    "mod_verbs": mod_counts("verb"),
    "mod_adjs": mod_counts("adj"),
    "sentence_modifiers": ROWS_TEXT + rows_from("unit"),
    "document_modifiers": ROWS_TEXT + rows_from("docunit"),
    # earlier collectors
    "pos_noun_counts": f"""
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT grp, hlemma AS term FROM ma WHERE mod
          UNION ALL SELECT m.grp, c.lemma FROM ma m JOIN ann c ON {child('c', 'm', 'm.ei')}
            WHERE c.pos IN {NAMING} AND c.dep IN {MODIFYING}) GROUP BY grp, term""",
    "pos_verb_counts": """
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT grp, hhlemma AS term FROM ma WHERE mod AND hdep = 'nsubj' AND hhpos = 'VERB'
          UNION ALL SELECT grp, hlemma FROM ma WHERE edep = 'nsubj' AND hpos = 'VERB') GROUP BY grp, term""",
    "pos_adj_counts": f"""
        SELECT m.grp, replace({cleaned('t.lemma')}, '--', '-') AS term, count(*) AS cnt
        FROM ma m JOIN ann t ON {same('t', 'm')} JOIN ann th ON {same('th', 't')} AND th.i = t.head
        WHERE t.pos = 'ADJ' AND t.i <> m.ei AND t.ent <> 'NORP' AND t.lemma NOT IN {SURFACES}
          AND t.lemma NOT IN {names([*params.COUNTED_INTENSIFIERS, *params.COUNTED_CATEGORY_WORDS])}
          AND NOT (t.dep = 'conj' AND th.pos IN ('NOUN', 'ADJ'))
          AND ((t.dep = 'amod' AND t.head = m.ehead)
            OR (t.dep IN ('acomp', 'attr') AND m.ehead = t.head AND m.ei <> m.ehead AND m.edep IN {SUBJ}))
        GROUP BY ALL""",
    "subject_of": "SELECT doc_id, sent_id, pred, subject FROM ps",
    "subtree_adj_counts": f"""
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT grp, lemma AS term FROM adjlink
          UNION ALL SELECT g.grp, p.lemma FROM adjp p JOIN sgroups g ON {same('g', 'p')}
            WHERE NOT EXISTS (SELECT 1 FROM adjlink l WHERE {same('l', 'p')} AND l.i = p.i))
        GROUP BY grp, term""",
    "subtree_verb_counts": f"""
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT grp, lemma AS term FROM verblink
          UNION ALL SELECT n.grp, p.lemma FROM verbp p JOIN anc n ON {same('n', 'p')} AND n.a = p.head
            WHERE p.dep IN ('relcl', 'acl', 'acl:relcl')
          UNION ALL SELECT g.grp, p.lemma FROM verbp p JOIN sgroups g ON {same('g', 'p')}
            WHERE p.dep NOT IN ('relcl', 'acl', 'acl:relcl')
              AND NOT EXISTS (SELECT 1 FROM verblink l WHERE {same('l', 'p')} AND l.i = p.i)
              AND (SELECT count(*) FROM sgroups k WHERE {same('k', 'p')}) = 1)
        GROUP BY grp, term""",
    "first_modified_noun": f"""
        SELECT noun, count(*) AS cnt FROM (
          SELECT arg_min(t.lemma, t.i) AS noun FROM ann t JOIN ann c ON {child('c', 't', 't.i')}
          WHERE t.pos = 'NOUN' AND c.dep IN {MODIFYING} AND (c.ent = 'NORP' OR c.text IN {TERMS})
          GROUP BY t.doc_id, t.sent_id) GROUP BY noun""",
    "norp_verb_counts": f"""
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT e.text AS grp, h.lemma AS term FROM ann e JOIN ann h ON {same('h', 'e')} AND h.i = e.head
            WHERE e.ent = 'NORP' AND e.text IN {TERMS} AND h.pos = 'VERB' AND h.tag IN {names(params.VERB_TAGS)}
          UNION ALL SELECT e.text, c.lemma FROM ann e JOIN ann c ON {child('c', 'e', 'e.i')}
            WHERE e.ent = 'NORP' AND e.text IN {TERMS} AND c.pos = 'VERB') GROUP BY grp, term""",
    "norp_adj_counts": f"""
        SELECT grp, term, count(*) AS cnt FROM (
          SELECT e.text AS grp, c.lemma AS term FROM ann e JOIN ann c ON {child('c', 'e', 'e.i')}
            WHERE e.ent = 'NORP' AND e.text IN {TERMS} AND c.pos = 'ADJ' AND c.dep = 'amod'
          UNION ALL SELECT e.text, c.lemma FROM ann e JOIN ann h ON {same('h', 'e')} AND h.i = e.head
              JOIN ann c ON {child('c', 'e', 'h.i')}
            WHERE e.ent = 'NORP' AND e.text IN {TERMS} AND h.pos IN ('AUX', 'VERB') AND e.dep IN {SUBJ}
              AND e.i <> h.i AND c.pos = 'ADJ' AND c.dep IN ('acomp', 'attr'))
        WHERE NOT regexp_matches(term, '{COMPASS}') GROUP BY grp, term""",
    "entity_counts": f"""
        SELECT text AS entity, count(*) AS cnt FROM ann WHERE ent = 'NORP' AND text IN {TERMS}
        GROUP BY text ORDER BY cnt DESC, entity LIMIT 6""",
    "edge_match": "SELECT pattern, head_lemma, child_lemma, count(*) AS cnt FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS pattern, h.lemma AS head_lemma, c.lemma AS child_lemma
            FROM ann c JOIN ann h ON {same('h', 'c')} AND h.i = c.head AND c.i <> h.i WHERE {test}"""
        for name, test in EDGES
    )
    + ") GROUP BY ALL",
    # classification
    "mention_pass_counts": f"""
        SELECT grp, count(*) AS n_mentions,
            count(*) FILTER (WHERE len(string_split(window_text, ' ')) >= 6) AS n_accepted
        FROM ({WINDOWS}) GROUP BY grp""",
    "window_classify": f"""
        WITH win AS ({WINDOWS}),
        gram AS (
          SELECT *, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM (SELECT *, list_filter(string_split(window_text, ' '), lambda x: x <> '') AS w FROM win)),
        train AS (SELECT g, quality AS y FROM gram JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
        cnt AS (
          SELECT gram, sum(y) AS c1, sum(1 - y) AS c0 FROM (SELECT unnest(g) AS gram, y FROM train) GROUP BY gram),
        tot AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM cnt),
        weight AS (
          SELECT gram, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS weight FROM cnt, tot),
        bias AS (SELECT ln(sum(y) / sum(1 - y)) AS b FROM train),
        score AS (
          SELECT doc_id, sent_id, sum(weight) AS s FROM
            (SELECT doc_id, sent_id, unnest(g) AS gram FROM gram) JOIN weight USING (gram) GROUP BY doc_id, sent_id)
        SELECT doc_id, sent_id, grp, window_text FROM win LEFT JOIN score USING (doc_id, sent_id), bias
        WHERE round(coalesce(s, 0) + b, 9) > 0""",
    # counts
    "doc_freq_counts": "SELECT grp, pos, term, count(DISTINCT doc_id) AS cnt FROM wx GROUP BY grp, pos, term",
    "upsert_counts": """
        SELECT grp, pos, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM cc UNION ALL SELECT * FROM c_cc)
        GROUP BY grp, pos, term""",
    "merge_modifiers": f"""
        SELECT grp, {ROWS_PIPED}, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) > 1 AS has_dup
        FROM (SELECT * FROM wrows UNION ALL SELECT * FROM c_wrows) AS u(grp, adjs, verbs, nouns, cnt, has_dup)
        GROUP BY u.grp, u.adjs, u.verbs, u.nouns""",
    "clean_counts": "SELECT grp, pos, term, cnt FROM cc",
    "global_counts": "SELECT pos, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM cc GROUP BY pos, term",
    "max_adj_count": f"""
        SELECT g.grp, coalesce(max(c.cnt), 0) AS max_cnt
        FROM (VALUES {", ".join(f"({text(t.replace('_', ' '))})" for t in LEX.terms)}) AS g(grp)
            LEFT JOIN cc c ON c.grp = g.grp AND c.pos = 'adj' GROUP BY g.grp""",
    "vocab_size": """
        SELECT grp, pos, count(DISTINCT term) AS n_terms FROM cc GROUP BY grp, pos
        UNION ALL SELECT '*', pos, count(DISTINCT term) FROM cc GROUP BY pos""",
    "group_counters": """
        SELECT grp, pos, shard, string_agg(term || ':' || cnt, ' ' ORDER BY term) AS counter FROM (
          SELECT *, ('0x' || substr(md5(term), 1, 8))::BIGINT
            % 8 AS shard FROM cc)
        GROUP BY grp, pos, shard""",
    "taxonomy_join": """
        SELECT c.grp, t.category, t.region, c.pos, c.term, c.cnt FROM cc c LEFT JOIN tax t ON t.term = c.grp""",
    "syntactic_counts": "SELECT grp, pos, term, cnt FROM scc",
    # log-odds
    "syntactic_log_odds": "SELECT grp, pos, term, cnt, round(score, 4) AS score FROM ssc",
    "weighted_log_odds": "SELECT grp, pos, term, cnt, round(score, 4) AS score FROM sc",
    "rest_log_odds": "SELECT grp, pos, term, cnt, round(score, 4) AS score FROM sc_rest",
    "top_log_odds": "SELECT grp, pos, term, cnt, round(score, 4) AS score, rank FROM top",
    "top5_combined": """
        SELECT grp, string_agg(term, ', ' ORDER BY rn) AS top_terms, string_agg(pos, ', ' ORDER BY rn) AS top_pos,
            string_agg(printf('%.3f', score), ', ' ORDER BY rn) AS top_scores
        FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos, term) AS rn
              FROM sc WHERE score IS NOT NULL) WHERE rn <= 5 GROUP BY grp""",
    "two_corpus_log_odds": both_ends(TWO_CORPORA, 25),
    "groups_vs_rest": both_ends(TARGET_PAIRS, 10),
    # similarity
    "mean_pool": """
        SELECT CAST(label AS BIGINT) AS label, unnest(range(len(vec))) AS dim,
            unnest(list_transform(vec, lambda v: round(v, 6))) AS value FROM lmean""",
    "cosine_pairs": "SELECT vec_id, CAST(label AS BIGINT) AS label, round(cosine_sim, 6) AS cosine_sim FROM lsim",
    "term_category_sim": "SELECT grp, category, pos, term, round(cosine_sim, 6) AS cosine_sim FROM sim",
    "pseudo_docs": """
        SELECT 'group' AS kind, grp AS name, pos, array_to_string(terms, ' ') AS text FROM gdocs
        UNION ALL SELECT 'category', category, pos, array_to_string(terms, ' ') FROM cdocs""",
    "category_contrast_vals": """
        SELECT grp, category, category_type, pos, round(cosine_sim, 6) AS cosine_sim FROM contrast""",
    # statistics
    "category_contrast_stats": f"""
        SELECT grp, pos, round(mean_own, 6) AS mean_own, round(mean_other, 6) AS mean_other,
            round(t, 4) AS t_stat, round(exp({log_p('t', 'n_other')}), 6) AS p_value, n_other
        FROM (SELECT *, CASE WHEN sd > 0 THEN (mean_own - mean_other) / (sd / sqrt(n_other)) END AS t FROM (
          SELECT grp, pos, avg(cosine_sim) FILTER (WHERE category_type = 'own') AS mean_own,
            avg(cosine_sim) FILTER (WHERE category_type = 'other') AS mean_other,
            stddev_samp(cosine_sim) FILTER (WHERE category_type = 'other') AS sd,
            count(*) FILTER (WHERE category_type = 'other') AS n_other
          FROM contrast GROUP BY grp, pos)
        WHERE mean_own IS NOT NULL AND n_other > 0)""",
    "alignment_contrast": f"""
        SELECT grp, own_category, pos, round(sim_own, 6) AS sim_own, round(sim_other, 6) AS sim_other,
            round(sim_own - sim_other, 6) AS diff, round(t, 4) AS t_stat,
            round(exp({log_p('t', 'n')}), 6) AS p_value, n
        FROM (SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t FROM (
          SELECT *, count(*) OVER w AS n, avg(sim_own - sim_other) OVER w AS mean,
            stddev_samp(sim_own - sim_other) OVER w AS sd
          FROM diffs WINDOW w AS (PARTITION BY pos)))""",
    "group_sim_agg": """
        SELECT grp, region, pos, round(mean_sim, 6) AS mean_sim, round(sd_sim, 6) AS sd_sim, n_terms FROM gsum""",
    "group_order": """
        SELECT pos, grp, round(avg(cosine_sim), 6) AS mean_sim,
            row_number() OVER (PARTITION BY pos ORDER BY avg(cosine_sim) DESC, grp) AS place
        FROM regional GROUP BY pos, grp""",
    "region_stats": one_sample("region, pos", "cosine_sim", "(SELECT * FROM regional WHERE region IS NOT NULL)"),
    "region_group_stats": one_sample("region, pos", "mean_sim", "gsum", least=2),
    "global_group_stats": one_sample("pos", "mean_sim", "gsum"),
    "label_stats": one_sample(
        "region, pos", "cosine_sim", "(SELECT 'label ' || label AS region, 'adj' AS pos, cosine_sim FROM lsim)"
    ),
    "boxplot_stats": box("category, pos", "sim"),
    "boxplot_labels": box("label", "(SELECT CAST(label AS BIGINT) AS label, cosine_sim FROM lsim)"),
}
# Lexicons as tables give what lexicons as parameters give.
STATEMENTS |= {
    "table_mentions": STATEMENTS["group_mentions"],
    "table_keywords": STATEMENTS["keyword_sentences"],
    "table_examples": STATEMENTS["example_finder"],
}


def sql() -> dict[str, str]:
    return {name: assemble(body) for name, body in STATEMENTS.items()}
