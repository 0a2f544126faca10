"""DuckDB SQL that states what every registered query must return.

Written in relational form (token rows, windows, self joins), not in the form of the
Spark code, so that agreement means something.  ``sql()`` assembles each statement
from the common table expressions it needs.
"""

from __future__ import annotations

import re

from epithet import params
from epithet.params import TEST_LEXICON as LEX

# Written out here, so that a mistake in the code's patterns does not hide itself.
# Code points that count as white space: controls, blanks, line and paragraph separators.
BLANK_CODES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLANKS = "".join(map(chr, BLANK_CODES))
SPACE = "".join(f"\\x{{{code:X}}}" for code in BLANK_CODES)
WORDS = r"[\p{L}\p{N}_]+"

NAMING = "('NOUN','PROPN')"
MODIFYING = "('amod','compound')"
SUBJ = "('nsubj','nsubjpass')"
SAME = "{0}.doc_id = {1}.doc_id AND {0}.sent_id = {1}.sent_id"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


TERMS, SURFACES, MULTI = names(LEX.terms), names(LEX.surfaces), names(LEX.multiword)
OLD_PLURALS = names(t + "s" for t in LEX.terms)
PLURALS = names(LEX.plurals)
FUNCTION_WORDS = names(params.FUNCTION_WORDS)
COMPASS = "|".join(params.COMPASS_WORDS)


def same(a: str, b: str) -> str:
    return SAME.format(a, b)


def sentence_ctes(p: str, source: str) -> dict[str, str]:
    """Sentences, tokens and mention sentences of one corpus, names prefixed by ``p``."""
    over = "OVER (PARTITION BY doc_id, sent_id ORDER BY i)"
    return {
        f"{p}sent": f"""
            SELECT doc_id, sent_id, sentence FROM (
              SELECT doc_id, unnest(range(len(r))) AS sent_id, unnest(r) AS sentence FROM (
                SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'),
                  lambda part: trim(part, {text(BLANKS)})), lambda part: part <> '') AS r
                FROM {source}))
            """,
        f"{p}tok0": f"""
            SELECT doc_id, sent_id, unnest(range(len(w))) AS i, unnest(w) AS tok FROM (
              SELECT doc_id, sent_id, regexp_extract_all(lower(sentence), {text(WORDS)}) AS w
              FROM {p}sent)""",
        f"{p}tok": f"""
            SELECT doc_id, sent_id, row_number() {over} - 1 AS i, tok FROM (
              SELECT doc_id, sent_id, i, CASE WHEN starts THEN tok || '_' || nxt ELSE tok END AS tok,
                     lag(starts, 1, false) {over} AS eaten
              FROM (SELECT *, coalesce(tok || '_' || nxt IN {MULTI}, false) AS starts
                    FROM (SELECT *, lead(tok) {over} AS nxt FROM {p}tok0)))
            WHERE NOT eaten""",
        f"{p}mtok": f"""
            SELECT t.* FROM {p}tok t SEMI JOIN
              (SELECT doc_id, sent_id FROM {p}tok WHERE tok IN {TERMS}) m USING (doc_id, sent_id)""",
        # context windows
        f"{p}wx": f"""
            SELECT DISTINCT doc_id, sent_id, grp, pos, term FROM (
              SELECT m.doc_id, m.sent_id, m.tok AS grp, {word_class('t.tok')} AS pos, t.tok AS term
              FROM {p}mtok m JOIN {p}mtok t ON {same('m', 't')}
                AND t.i BETWEEN m.i - {params.WINDOW} AND m.i + {params.WINDOW} AND t.i <> m.i
              WHERE m.tok IN {TERMS} AND length(t.tok) > 2 AND t.tok NOT IN {FUNCTION_WORDS})
            WHERE pos <> 'adverb'""",
        f"{p}wunit": sets_per("doc_id, sent_id, grp", f"{p}wx"),
        f"{p}wrows": rows_of(f"{p}wunit"),
        f"{p}cc": counts_of(f"{p}wrows"),
    }


def counts_of(rows: str) -> str:
    return f"""
        SELECT grp, pos, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
          SELECT replace(grp, '_', ' ') AS grp, 'adj' AS pos, unnest(adjs) AS term, cnt FROM {rows}
          UNION ALL SELECT replace(grp, '_', ' '), 'verb', unnest(verbs), cnt FROM {rows}
          UNION ALL SELECT replace(grp, '_', ' '), 'noun', unnest(nouns), cnt FROM {rows})
        WHERE pos = 'noun' OR NOT ({dropped_term()})
        GROUP BY ALL"""


def word_class(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND (suffix({w}, 'ing') OR suffix({w}, 'ed')) THEN 'verb'
        WHEN length({w}) > 3 AND suffix({w}, 'ly') THEN 'adverb'
        WHEN length({w}) > 3 AND suffix({w}, 'ble') THEN 'adj' ELSE 'noun' END"""


def stopped(term: str) -> str:
    return f"(length({term}) <= 2 OR {term} IN {names([*params.DIRECTION_STOP, *params.NOISE_STOP])})"


def dropped_term() -> str:
    bare = "replace(lower(term), '_', '')"
    marks = " OR ".join(f"contains({bare}, {text(s)})" for s in params.GROUP_SUBSTRINGS)
    own = f"contains({bare}, replace(lower(grp), '_', ''))"
    return f"{stopped('term')} OR {own} OR {marks} OR term IN {TERMS}"


def cleaned(c: str) -> str:
    return f"regexp_replace(lower(strip_accents({c})), '[^a-z\\-]', '', 'g')"


def sets_per(key: str, source: str) -> str:
    def one(pos: str) -> str:
        return f"coalesce(list_sort(list(DISTINCT term) FILTER (WHERE pos = '{pos}')), []::VARCHAR[])"

    return f"""SELECT {key}, {one('noun')} AS nouns, {one('verb')} AS verbs, {one('adj')} AS adjs
        FROM {source} GROUP BY {key}"""


def rows_of(units: str) -> str:
    return f"""SELECT grp, adjs, verbs, nouns, count(*) AS cnt, count(*) > 1 AS has_dup FROM {units}
        WHERE len(verbs) + len(adjs) > 0 GROUP BY grp, adjs, verbs, nouns"""


def _pos_case() -> str:
    classes = [
        (params.DETERMINERS, "DET"), (params.AUXILIARIES, "AUX"), (params.CONJUNCTIONS, "CCONJ"),
        (params.ADPOSITIONS, "ADP"), (params.PRONOUNS, "PRON"),
    ]
    listed = " ".join(f"WHEN tok IN {names(words)} THEN '{pos}'" for words, pos in classes)
    return f"""CASE WHEN tok IN {SURFACES} THEN 'PROPN' {listed}
        WHEN regexp_full_match(tok, '[0-9]+') THEN 'NUM'
        WHEN length(tok) > 4 AND (suffix(tok, 'ing') OR suffix(tok, 'ed')) THEN 'VERB'
        WHEN length(tok) > 3 AND suffix(tok, 'ly') THEN 'ADV'
        WHEN length(tok) > 3 AND suffix(tok, 'ble') THEN 'ADJ' ELSE 'NOUN' END"""


def _edge(dep: str, head: str) -> str:
    return f"struct_pack(dep := '{dep}', head := {head})"


ANNOTATION = {
    "a1": f"SELECT *, {_pos_case()} AS pos FROM mtok",
    "a2": """
        SELECT *, CASE WHEN pos = 'VERB' AND suffix(tok, 'ing') THEN 'VBG'
            WHEN pos = 'VERB' AND lead(pos) OVER w = 'NOUN' THEN 'VBN' WHEN pos = 'VERB' THEN 'VBD'
            WHEN pos = 'PROPN' THEN 'NNP' WHEN pos = 'DET' THEN 'DT' WHEN pos = 'AUX' THEN 'VBZ'
            WHEN pos = 'CCONJ' THEN 'CC' WHEN pos = 'ADP' THEN 'IN' WHEN pos = 'PRON' THEN 'PRP'
            WHEN pos = 'NUM' THEN 'CD' WHEN pos = 'ADV' THEN 'RB' WHEN pos = 'ADJ' THEN 'JJ'
            WHEN pos = 'NOUN' THEN 'NN' END AS tag
        FROM a1 WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY i)""",
    "a3": """
        SELECT *, lead(pos, 1, '') OVER w AS p1, lead(pos, 2, '') OVER w AS p2, lead(tag, 1, '') OVER w AS t1,
            lag(pos, 1, '') OVER w AS b1, lag(pos, 2, '') OVER w AS b2, lag(tok, 1, '') OVER w AS w1,
            coalesce(min(CASE WHEN pos IN ('AUX','VERB') AND tag NOT IN ('VBN','VBG') THEN i END)
                     OVER (PARTITION BY doc_id, sent_id), 0) AS r
        FROM a2 WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY i)""",
    "ann": f"""
        SELECT doc_id, sent_id, i, tok AS text,
            CASE WHEN pos = 'AUX' THEN 'be' WHEN pos = 'VERB' AND suffix(tok, 'ing') THEN tok[:-4]
                 WHEN pos = 'VERB' THEN tok[:-3] ELSE tok END AS lemma,
            pos, tag, e.dep AS dep, e.head AS head, CASE WHEN pos = 'PROPN' THEN 'NORP' ELSE '' END AS ent
        FROM (SELECT *, CASE
            WHEN i = r THEN {_edge('ROOT', 'r')}
            WHEN (pos IN ('PROPN','ADJ') OR tag = 'VBN') AND p1 = 'NOUN' THEN {_edge('amod', 'i + 1')}
            WHEN (pos = 'ADJ' OR tag = 'VBN') AND p1 = 'PROPN' AND p2 = 'NOUN' THEN {_edge('amod', 'i + 2')}
            WHEN (pos = 'ADJ' OR tag = 'VBN') AND p1 = 'PROPN' THEN {_edge('amod', 'i + 1')}
            WHEN pos IN ('PROPN','NOUN') AND (p1 = 'AUX' OR (p1 = 'VERB' AND t1 <> 'VBG'))
                THEN {_edge('nsubj', 'i + 1')}
            WHEN pos = 'PROPN' AND w1 = 'by' AND b2 = 'VERB' THEN {_edge('pobj', 'i - 1')}
            WHEN pos = 'ADJ' AND b1 = 'AUX' THEN {_edge('acomp', 'i - 1')}
            WHEN pos = 'NOUN' AND b1 = 'AUX' THEN {_edge('attr', 'i - 1')}
            WHEN tag = 'VBG' AND b1 = 'NOUN' THEN {_edge('acl', 'i - 1')}
            WHEN tok = 'by' AND b1 = 'VERB' THEN {_edge('agent', 'i - 1')}
            WHEN b1 = 'CCONJ' AND b2 = pos THEN {_edge('conj', 'i - 2')}
            ELSE {_edge('dep', 'r')} END AS e FROM a3)""",
}


def child(c: str, m: str, of: str) -> str:
    """Join condition: ``c`` is a child of position ``of`` in the sentence of ``m``."""
    return f"{same(c, m)} AND {c}.head = {of} AND {c}.i <> {of}"


def _mentions(source: str) -> str:
    return f"""
        SELECT e.doc_id, e.sent_id, e.grp, e.i AS ei, e.dep AS edep, e.head AS ehead,
            h.i AS hi, h.text AS htext, h.lemma AS hlemma, h.pos AS hpos, h.dep AS hdep,
            hh.i AS hhi, hh.lemma AS hhlemma, hh.pos AS hhpos,
            h.pos IN {NAMING} AND e.dep IN {MODIFYING} AS mod,
            e.dep IN {SUBJ} AND h.pos = 'VERB' AND h.dep <> 'ROOT' AS stops
        FROM {source} e JOIN ann h ON {same('h', 'e')} AND h.i = e.head
            JOIN ann hh ON {same('hh', 'e')} AND hh.i = h.head"""


KEY = "m.doc_id, m.sent_id, m.grp"
PRED = f"t.dep = 'acomp' AND th.lemma = 'be' AND m.ehead = t.head AND m.ei <> m.ehead AND m.edep IN {SUBJ}"
PRED_UP = f"th.dep = 'acomp' AND thh.lemma = 'be' AND m.ehead = th.head AND m.ei <> m.ehead AND m.edep IN {SUBJ}"

RULES = {
    "em": f"""
        SELECT a.*, o.term AS grp FROM ann a JOIN
            (SELECT DISTINCT doc_id, sent_id, tok AS term FROM mtok WHERE tok IN {TERMS}) o ON {same('o', 'a')}
            AND (a.lemma = o.term OR (a.lemma = o.term || 's' AND NOT suffix(o.term, 's')))""",
    "m": _mentions("em"),
    "acomps": f"""
        SELECT {KEY}, a.i AS ai, a.lemma FROM m JOIN ann a ON {child('a', 'm', 'm.hhi')}
        WHERE m.mod AND m.hdep = 'nsubj' AND m.hhlemma = 'be' AND a.dep = 'acomp' AND a.pos = 'ADJ'""",
    "x": f"""
        SELECT {KEY}, 'noun' AS pos, hlemma AS term FROM m WHERE mod
        UNION SELECT {KEY}, 'noun', c.lemma FROM m JOIN ann c ON {child('c', 'm', 'm.ei')}
            WHERE c.pos IN {NAMING} AND c.dep IN {MODIFYING}
        UNION SELECT {KEY}, 'noun', c.lemma FROM m JOIN ann c ON {child('c', 'm', 'm.hi')}
            WHERE m.edep = 'nsubj' AND m.hlemma = 'be' AND c.dep = 'attr' AND c.pos IN {NAMING}
        UNION SELECT {KEY}, 'verb', hhlemma FROM m WHERE mod AND hdep = 'nsubj' AND hhpos = 'VERB'
        UNION SELECT {KEY}, 'verb', c.lemma FROM m JOIN ann c ON {child('c', 'm', 'm.hhi')}
            WHERE m.mod AND m.hdep = 'nsubj' AND m.hhpos = 'VERB' AND c.dep = 'conj' AND c.pos = 'VERB'
        UNION SELECT {KEY}, CASE s.pos WHEN 'VERB' THEN 'verb' ELSE 'adj' END, s.lemma
            FROM acomps m JOIN ann s ON {child('s', 'm', 'm.ai')}
            WHERE s.dep = 'conj' AND s.pos IN ('VERB', 'ADJ')
        UNION SELECT {KEY}, 'adj', lemma FROM acomps m
        UNION SELECT {KEY}, 'verb', c.lemma FROM m JOIN ann c ON {child('c', 'm', 'm.hi')}
            WHERE m.mod AND c.pos = 'VERB' AND c.dep IN ('acl', 'relcl') AND NOT EXISTS
            (SELECT 1 FROM ann g WHERE {child('g', 'c', 'c.i')} AND g.dep IN {SUBJ})
        UNION SELECT {KEY}, 'verb', unnest([hlemma]) FROM m WHERE edep IN {SUBJ} AND hpos = 'VERB'
            AND hdep = 'ROOT' AND NOT (suffix(htext, 'ing') AND EXISTS
            (SELECT 1 FROM ann c WHERE {child('c', 'm', 'm.hi')} AND c.pos = 'AUX' AND c.lemma = 'be'))
        UNION SELECT {KEY}, 'verb', c.lemma FROM m JOIN ann c ON {child('c', 'm', 'm.hi')}
            WHERE m.edep IN {SUBJ} AND m.hpos = 'VERB' AND m.hdep = 'ROOT' AND c.dep = 'conj' AND c.pos = 'VERB'
            AND NOT (suffix(htext, 'ing') AND EXISTS
            (SELECT 1 FROM ann b WHERE {child('b', 'm', 'm.hi')} AND b.pos = 'AUX' AND b.lemma = 'be'))
        UNION SELECT {KEY}, 'verb', hhlemma FROM m
            WHERE NOT stops AND edep = 'pobj' AND hdep = 'agent' AND hhpos = 'VERB'
        UNION SELECT {KEY}, 'adj', {cleaned('t.lemma')}
            FROM m JOIN ann t ON {same('t', 'm')} JOIN ann th ON {same('th', 't')} AND th.i = t.head
              JOIN ann thh ON {same('thh', 't')} AND thh.i = th.head
            WHERE NOT m.stops AND t.pos NOT IN {names(params.NEVER_ADJECTIVE_POS)} AND t.i <> m.ei
              AND NOT EXISTS (SELECT 1 FROM em z WHERE {same('z', 't')} AND z.i = t.i)
              AND t.lemma NOT IN {names([*params.INTENSIFIERS, *params.CATEGORY_WORDS])}
              AND t.text NOT IN {names(params.ORDINAL_SUFFIXES)}
              AND NOT (th.pos = 'NOUN' AND NOT (th.dep = 'attr' AND th.head = m.hi) AND th.i NOT IN (m.ei, m.hi))
              AND (t.pos = 'ADJ' OR (t.pos = 'VERB' AND t.tag IN ('VBG', 'VBN') AND
                   ((t.dep = 'amod' AND t.head = m.ei) OR (m.edep = 'nsubj' AND t.dep = 'acomp'))))
              AND (({PRED}) OR (t.dep = 'conj' AND th.pos = 'ADJ' AND {PRED_UP})
                   OR (t.dep = 'amod' AND t.head IN (m.hi, m.ei))
                   OR (m.ei < t.i AND NOT EXISTS (SELECT 1 FROM ann b WHERE {same('b', 't')}
                        AND b.i > m.ei AND b.i < t.i AND b.pos IN ('VERB', 'NOUN'))))""",
    "unit": sets_per("doc_id, sent_id, grp", "x"),
    "docunit": sets_per("doc_id, grp", "x"),
    # whole lexicon, by lemma
    "em_all": f"""
        SELECT *, CASE WHEN lemma IN {TERMS} THEN lemma ELSE lemma[:-2] END AS grp
        FROM ann WHERE lemma IN {TERMS} OR lemma IN {PLURALS}""",
    "ma": _mentions("em_all"),
    # mentions by surface form, every term pluralised
    "ms": f"""
        SELECT *, CASE WHEN text IN {TERMS} THEN text ELSE text[:-2] END AS grp
        FROM ann WHERE text IN {TERMS} OR text IN {OLD_PLURALS}""",
    "anc": f"""
        SELECT doc_id, sent_id, i, grp, i AS a FROM ms
        UNION SELECT p.doc_id, p.sent_id, p.i, p.grp, t.head FROM anc p JOIN ann t
            ON {same('t', 'p')} AND t.i = p.a""",
    "subj": f"SELECT doc_id, sent_id, i, head FROM ann WHERE dep IN {SUBJ} AND i <> head",
    "climb": f"""
        SELECT p.doc_id, p.sent_id, p.i AS pred, p.head AS cur FROM ann p
            WHERE p.pos IN ('ADJ', 'VERB', 'AUX')
              AND NOT EXISTS (SELECT 1 FROM subj s WHERE {same('s', 'p')} AND s.head = p.i)
        UNION SELECT c.doc_id, c.sent_id, c.pred, t.head FROM climb c JOIN ann t
            ON {same('t', 'c')} AND t.i = c.cur
            WHERE NOT EXISTS (SELECT 1 FROM subj s WHERE {same('s', 'c')} AND s.head = c.cur)
              AND (t.dep IN ('conj', 'acomp', 'attr') OR t.pos = 'AUX') AND t.head <> t.i""",
    "ps": f"""
        SELECT p.doc_id, p.sent_id, p.i AS pred, s.i AS subject FROM ann p JOIN subj s
            ON {same('s', 'p')} AND s.head = p.i WHERE p.pos IN ('ADJ', 'VERB', 'AUX')
        UNION SELECT c.doc_id, c.sent_id, c.pred, s.i FROM climb c JOIN subj s
            ON {same('s', 'c')} AND s.head = c.cur""",
    "sgroups": "SELECT DISTINCT doc_id, sent_id, grp FROM ms",
    "adjp": f"""
        SELECT * FROM ann WHERE pos = 'ADJ' AND length(lemma) > 2 AND ent <> 'NORP'
            AND NOT regexp_matches(lemma, '{COMPASS}')""",
    "adjlink": f"""
        SELECT p.doc_id, p.sent_id, p.i, p.lemma, n.grp FROM adjp p
        JOIN ps ON {same('ps', 'p')} AND ps.pred = p.i JOIN anc n ON {same('n', 'p')} AND n.a = ps.subject""",
    "verbp": f"""
        SELECT * FROM ann WHERE pos IN ('VERB', 'AUX') AND lemma NOT IN {names(params.SKIPPED_VERBS)}
            AND tag IN {names(params.VERB_TAGS)}""",
    "verblink": f"""
        SELECT p.doc_id, p.sent_id, p.i, p.lemma, n.grp FROM verbp p
        JOIN ps ON {same('ps', 'p')} AND ps.pred = p.i JOIN anc n ON {same('n', 'p')} AND n.a = ps.subject
        WHERE p.dep NOT IN ('relcl', 'acl', 'acl:relcl')""",
}
RECURSIVE = {"anc", "climb"}


# --- scores ------------------------------------------------------------------

TAX = "(VALUES " + ", ".join(
    "(" + ", ".join("NULL::VARCHAR" if v is None else text(v) for v in row) + ")" for row in params.TEST_TAXONOMY
) + ") AS tax(term, category, region)"


def score_cte(background: str, min_count: int, source: str = "cc") -> str:
    own = 0 if background == "all" else 1
    a = 0.01
    return f"""
        SELECT grp, pos, term, cnt,
            (CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END - CASE WHEN q > 0 AND q < 1 THEN ln(q / (1 - q)) END)
            / sqrt(1 / (cnt + {a} * g) + CASE WHEN g > 0 THEN 1 / (g + {a} * g) END) AS score
        FROM (SELECT *, (cnt + {a} * g) / (n + {a} * nb) AS p,
                CASE WHEN nb > 0 THEN (g + {a} * g) / (nb + {a} * nb) END AS q
              FROM (SELECT c.*, sum(cnt) OVER (PARTITION BY pos, term)::DOUBLE - {own} * cnt AS g,
                        sum(cnt) OVER (PARTITION BY grp, pos)::DOUBLE AS n,
                        sum(cnt) OVER (PARTITION BY pos)::DOUBLE - {own} * sum(cnt) OVER (PARTITION BY grp, pos) AS nb
                    FROM {source} c))
        WHERE cnt >= {min_count}"""


def top_cte(scores: str, k: int = 50) -> str:
    return f"""
        SELECT * FROM (
          SELECT s.*, row_number() OVER (PARTITION BY grp, pos ORDER BY score DESC, term) AS rank
          FROM {scores} s LEFT JOIN (SELECT grp, pos, median(score) AS gate FROM {scores} WHERE score > 0
                                     GROUP BY grp, pos) g USING (grp, pos)
          WHERE score >= coalesce(gate, 0))
        WHERE rank <= {k}"""


def vector_of(c: str) -> str:
    return f"""(('0x' || substr(md5({c}), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def pooled(key: str, source: str) -> str:
    """Mean vector per key of (key, vec) rows."""
    return f"""
        SELECT {key}, list(v ORDER BY d) AS vec FROM (
          SELECT {key}, d, avg(v) AS v FROM (
            SELECT {key}, unnest(range(len(vec))) AS d, unnest(vec) AS v FROM {source}) GROUP BY {key}, d)
        GROUP BY {key}"""


SCORES = {
    "sc": score_cte("all", 5),
    "sc_rest": score_cte("rest", 5),
    "sc2": score_cte("all", 2),
    "srows": rows_of("unit"),
    "scc": counts_of("srows"),
    "ssc": score_cte("all", 2, "scc"),
    "top": top_cte("sc"),
    "top2": top_cte("sc2"),
    "emb": "SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings",
    "tax": f"SELECT * FROM {TAX}",
    "member": "SELECT DISTINCT term AS grp, category FROM tax WHERE category IS NOT NULL",
    "lmean": pooled("label", "emb"),
    "lsim": f"""
        SELECT vec_id, e.label, {cosine('e.vec', 'l.vec')} AS cosine_sim FROM emb e JOIN lmean l USING (label)
        WHERE list_sum(list_transform(e.vec, lambda x: x * x)) > 0
          AND list_sum(list_transform(l.vec, lambda x: x * x)) > 0""",
    "sim": f"""
        SELECT t.grp, c.category, t.pos, t.term, {cosine('v.vec', 'w.vec')} AS cosine_sim
        FROM top2 t JOIN member c USING (grp) JOIN emb v ON v.vec_id = {vector_of('t.term')}
            JOIN emb w ON w.vec_id = {vector_of('c.category')}""",
    "gdocs": "SELECT grp, pos, list(term ORDER BY rank) AS terms FROM top2 GROUP BY grp, pos",
    "cdocs": """
        SELECT category, pos, flatten(list(terms ORDER BY grp)) AS terms
        FROM gdocs JOIN member USING (grp) GROUP BY category, pos""",
    "gword": f"""
        SELECT grp, pos, e.vec FROM (SELECT grp, pos, unnest(terms) AS term FROM gdocs) t
            JOIN emb e ON e.vec_id = {vector_of('t.term')}""",
    "cword": f"""
        SELECT category, pos, e.vec FROM (SELECT category, pos, unnest(terms) AS term FROM cdocs) t
            JOIN emb e ON e.vec_id = {vector_of('t.term')}""",
    "gvec": pooled("grp, pos", "gword"),
    "cvec": pooled("category, pos", "cword"),
    "contrast": f"""
        SELECT g.grp, c.category, CASE WHEN c.category = m.category THEN 'own' ELSE 'other' END AS category_type,
            g.pos, {cosine('g.vec', 'c.vec')} AS cosine_sim
        FROM gvec g JOIN member m USING (grp) JOIN cvec c ON c.pos = g.pos
        WHERE EXISTS (SELECT 1 FROM cvec k WHERE k.category = m.category AND k.pos = g.pos)""",
    "regional": """
        SELECT s.*, t.region FROM sim s LEFT JOIN tax t ON t.term = s.grp WHERE s.category = 'alpha'""",
    "gsum": """
        SELECT grp, region, pos, avg(cosine_sim) AS mean_sim, stddev_samp(cosine_sim) AS sd_sim,
            count(cosine_sim) AS n_terms
        FROM regional WHERE region IS NOT NULL GROUP BY grp, region, pos""",
    "diffs": """
        SELECT * FROM (
          SELECT grp, pos, max(category) FILTER (WHERE category_type = 'own') AS own_category,
            avg(cosine_sim) FILTER (WHERE category_type = 'own') AS sim_own,
            avg(cosine_sim) FILTER (WHERE category_type = 'other') AS sim_other
          FROM contrast GROUP BY grp, pos)
        WHERE sim_own IS NOT NULL AND sim_other IS NOT NULL""",
}


def log_p(t: str, n: str) -> str:
    """log of the two-sided Student-t p value: power series of the incomplete beta function."""
    a = f"(({n} - 1) / 2.0)"
    lx = f"(-ln(1 + {t} * {t} / ({n} - 1.0)))"
    ly = f"(2 * ln(abs({t})) - ln({n} - 1.0 + {t} * {t}))"
    series = f"""list_sum(list_transform(range(0, 100000), lambda k: exp((k + 1) * {lx}
        + lgamma({a} + k + 1.5) - lgamma({a} + 0.5) - lgamma({a} + k + 2) + lgamma({a} + 1))))"""
    front = f"{a} * {lx} + 0.5 * {ly} - ln({a}) - lgamma({a}) - lgamma(0.5) + lgamma({a} + 0.5)"
    return f"CASE WHEN {t} IS NOT NULL AND {n} > 1 THEN {front} + ln(1 + {series}) END"


def one_sample(key: str, value: str, source: str, least: int = 1) -> str:
    """Report of a one-sample test per key."""
    p10 = "lp / ln(10)"
    return f"""
        SELECT {key}, round(mean, 4) AS b, round(se, 4) AS se, round(t, 2) AS t, round(exp(lp), 6) AS p,
            CASE WHEN lp IS NOT NULL THEN
              printf('%.2f', pow(10, {p10} - floor({p10}))) || 'e' || floor({p10})::BIGINT END AS p_text,
            round(d, 3) AS d, n
        FROM (SELECT *, {log_p('t', 'n')} AS lp FROM (
          SELECT {key}, n, mean, sd / sqrt(n) AS se, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t,
            CASE WHEN sd > 0 THEN mean / sd END AS d
          FROM (SELECT {key}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd
                FROM {source} GROUP BY {key}) WHERE n >= {least}))"""


def box(key: str, source: str) -> str:
    return f"""
        SELECT {key}, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median,
            round(any_value(q3), 6) AS q3,
            round(min(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_low,
            round(max(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_high,
            count(*) FILTER (WHERE NOT x BETWEEN lo AND hi) AS n_outliers
        FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
          SELECT *, cosine_sim AS x, count(*) OVER w AS n, quantile_cont(cosine_sim, 0.25) OVER w AS q1,
            median(cosine_sim) OVER w AS md, quantile_cont(cosine_sim, 0.75) OVER w AS q3
          FROM {source} WINDOW w AS (PARTITION BY {key}))) GROUP BY {key}"""


CTES = {
    "turns": "SELECT conv_id || ':' || turn AS doc_id, text FROM conversations",
    **sentence_ctes("", "documents"),
    **sentence_ctes("c_", "turns"),
    **ANNOTATION,
    **RULES,
    **SCORES,
}


def assemble(body: str) -> str:
    """Prefix a SELECT with the expressions it refers to, in dependency order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\b(?:FROM|JOIN)\s+\(?(\w+)", sql)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    if not parts:
        return body
    keyword = "WITH RECURSIVE" if needed & RECURSIVE else "WITH"
    # A statement with expressions of its own goes on from the shared ones.
    own = body.lstrip()
    joined = ",\n" + own.removeprefix("WITH ") if own.startswith("WITH ") else "\n" + body
    return f"{keyword} " + ",\n".join(parts) + joined
