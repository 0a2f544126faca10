"""Parameters: lexicons, taxonomies and word lists.

All of these are configuration of a known, small size.  They enter plans either
as literals (hashed ``IN`` sets) or as local relations whose size Catalyst knows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "[GROUP]"
WINDOW = 5
MAX_SENTENCE_WORDS = 120
MAX_FILLER_SENTENCES = 20
MAX_DOC_SENTENCES = 250
SHARD_RECORDS = 500_000


# ---------------------------------------------------------------------------
# Word lists that decide which terms count.
# ---------------------------------------------------------------------------

INTENSIFIERS = (
    "super", "very", "really", "quite", "so", "too", "extremely", "highly",
    "fairly", "slightly", "rather", "especially", "incredibly", "most", "more",
)

CATEGORY_WORDS = (
    "ethnic", "certain", "such", "various", "many", "several", "some", "other",
    "only", "own", "different", "separate", "this", "that", "these", "those",
    "most",
)

# The counted variant uses its own lists.
COUNTED_INTENSIFIERS = (
    "super", "very", "really", "quite", "so", "too", "extremely", "highly",
    "fairly", "slightly", "pretty", "rather", "especially", "incredibly",
)

COUNTED_CATEGORY_WORDS = (
    "ethnic", "certain", "such", "various", "many", "several", "some", "other",
    "only", "own", "different", "separate", "this", "that", "these", "those",
)

NEVER_ADJECTIVE_POS = (
    "DET", "AUX", "CCONJ", "SCONJ", "ADP", "PART", "INTJ", "SYMBOL", "NUM",
    "PUNCT", "SPACE", "PRON",
)

ORDINAL_SUFFIXES = ("st", "nd", "rd", "th")

COMPASS_WORDS = ("north", "south", "east", "west", "central")

SKIPPED_VERBS = ("be", "have", "do", "orient")

VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")

# Term filter, first list (directions).
DIRECTION_STOP = (
    "north", "south", "east", "west", "northern", "northeast", "southern",
    "eastern", "western", "northward", "southward", "easternly", "westernly",
    "-", "mainland", "inner",
)

# Term filter, second list (noise).
NOISE_STOP = (
    "white", "black", "latino", "tibetan", "nepali", "nb", "spanish",
    "mexican", "canadian", "american", "caribbean", "african", "eyelid",
    "TRUE", "british", "australian", "timorese", "russian", "german",
    "mandopop", "sinhalese", "hispanic", "turkish", "dutch", "endangered",
    "european", "economic", "carolinian", "akaye", "somali", "latin", "iraqi",
    "eaff", "royal", "french", "irish", "imperial", "unified", "prime",
    "deputy", "surname", "militant", "former", "pastoral", "national",
    "military", "roman", "siberian", "yapese", "projecttarget", "pohnpeian",
    "cofa", "base", "nativehawaiian", "vast", "blue",
)

# Substrings that mark a term as naming a group rather than describing one.
GROUP_SUBSTRINGS = ("asian", "pacific")

GROUP_ALIASES = (("asian indian", "indian"), ("native hawaiian", "hawaiian"))

# Two-level taxonomy: term, category, region.
POPULATION_TAXONOMY = (
    ("asian", None, None),
    ("asian american", None, None),
    ("asian american pacific islander", None, None),
    ("aapi", None, None),
    ("pacific islander", None, None),
    ("south asian", "asian", None),
    ("east asian", "asian", None),
    ("central asian", "asian", None),
    ("southeast asian", "asian", None),
    ("western asian", "asian", None),
    ("melanesian", "pacific islander", None),
    ("micronesian", "pacific islander", None),
    ("polynesian", "pacific islander", None),
    ("chinese", "asian", "east asian"),
    ("korean", "asian", "east asian"),
    ("japanese", "asian", "east asian"),
    ("mongolian", "asian", "east asian"),
    ("taiwanese", "asian", "east asian"),
    ("indian", "asian", "south asian"),
    ("bangladeshi", "asian", "south asian"),
    ("nepalese", "asian", "south asian"),
    ("sri lankan", "asian", "south asian"),
    ("pakistani", "asian", "south asian"),
    ("bhutanese", "asian", "south asian"),
    ("afghan", "asian", "south asian"),
    ("sikh", "asian", "south asian"),
    ("asian indian", "asian", "south asian"),
    ("kazakh", "asian", "central asian"),
    ("kyrgyz", "asian", "central asian"),
    ("tajik", "asian", "central asian"),
    ("uzbek", "asian", "central asian"),
    ("indonesian", "asian", "southeast asian"),
    ("malaysian", "asian", "southeast asian"),
    ("filipino", "asian", "southeast asian"),
    ("laotian", "asian", "southeast asian"),
    ("thai", "asian", "southeast asian"),
    ("singaporean", "asian", "southeast asian"),
    ("vietnamese", "asian", "southeast asian"),
    ("hmong", "asian", "southeast asian"),
    ("mien", "asian", "southeast asian"),
    ("cambodian", "asian", "southeast asian"),
    ("burmese", "asian", "southeast asian"),
    ("hawaiian", "pacific islander", "polynesian"),
    ("native hawaiian", "pacific islander", "polynesian"),
    ("maori", "pacific islander", "polynesian"),
    ("samoan", "pacific islander", "polynesian"),
    ("tahitian", "pacific islander", "polynesian"),
    ("tongan", "pacific islander", "polynesian"),
    ("chamorro", "pacific islander", "micronesian"),
    ("palauan", "pacific islander", "micronesian"),
    ("guamanian", "pacific islander", "micronesian"),
    ("marshallese", "pacific islander", "micronesian"),
    ("chuukese", "pacific islander", "micronesian"),
    ("fijian", "pacific islander", "melanesian"),
)


# ---------------------------------------------------------------------------
# Word classes of the surface annotator.
# ---------------------------------------------------------------------------

DETERMINERS = ("the", "a", "this", "that")
AUXILIARIES = ("is", "are", "was", "be")
CONJUNCTIONS = ("and", "or")
ADPOSITIONS = ("of", "to", "in", "for", "on", "with", "by", "from", "at", "as")
PRONOUNS = ("it", "he")
FUNCTION_WORDS = DETERMINERS + AUXILIARIES + CONJUNCTIONS + ADPOSITIONS + PRONOUNS


# ---------------------------------------------------------------------------
# Lexicon and taxonomy for the generated test tables (invented words).
# ---------------------------------------------------------------------------

TEST_TERMS = (
    "thon", "than", "ther", "thor", "erin", "attion", "worthless",
    "eriner_thanea",
)

TEST_TAXONOMY = (
    ("alpha", None, None),
    ("thon", "alpha", "alpha east"),
    ("than", "alpha", "alpha east"),
    ("ther", "alpha", "alpha south"),
    ("thor", "alpha", "alpha south"),
    ("erin", "beta", "beta north"),
    ("attion", "beta", "beta north"),
    ("eriner thanea", "beta", None),
    ("worthless", "gamma", "gamma west"),
)


def normalize_term(term: str) -> str:
    return term.strip().lower().replace("-", "_").replace(" ", "_")


@dataclass(frozen=True)
class Lexicon:
    """Lower-case group terms; the words of a multiword term are joined by ``_``.

    A parameter, written into plans.  A lexicon that is a table is a ``LexiconTable``.
    """

    terms: tuple[str, ...]
    always_plural: bool = False  # also add ``s`` to terms that already end in it

    @classmethod
    def of(cls, terms: Iterable[str], always_plural: bool = False) -> Lexicon:
        names = {normalize_term(t) for t in terms if t.strip()}
        return cls(tuple(sorted(names)), always_plural)

    @property
    def multiword(self) -> tuple[str, ...]:
        """Multiword terms, longest first."""
        many = [t for t in self.terms if "_" in t]
        return tuple(sorted(many, key=lambda t: (-t.count("_"), t)))

    @property
    def plurals(self) -> tuple[str, ...]:
        return tuple(t + "s" for t in self.terms if self.always_plural or not t.endswith("s"))

    @property
    def surfaces(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.terms) | set(self.plurals)))

    def groups(self) -> dict[str, str]:
        """Surface form -> group; an exact term wins over a plural."""
        out = {t: t[:-1] for t in self.plurals}
        out.update({t: t for t in self.terms})
        return out


TEST_LEXICON = Lexicon.of(TEST_TERMS)


def local_frame(spark: SparkSession, rows, names: tuple[str, ...]) -> DataFrame:
    """Small string table as a local relation, so joins see its real size."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), pa.string()) for c in columns]
    return spark.createDataFrame(pa.table(arrays, names=list(names)))


def taxonomy_frame(spark: SparkSession, rows=TEST_TAXONOMY) -> DataFrame:
    return local_frame(spark, rows, ("term", "category", "region"))


def lexicon_frame(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """Surface form, group and number of words of every lexicon entry."""
    rows = sorted(lexicon.groups().items())
    return local_frame(spark, rows, ("surface", "grp")).withColumn(
        "n_words", F.size(F.split("grp", "_")).cast("bigint")
    )
