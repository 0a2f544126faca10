import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "ti", "vo") for b in ("dan", "fel", "gor", "hum", "jis")]


def prose(seed: int, n: int) -> str:
    """Sentences of invented words, the same for the same seed."""
    import random

    rng = random.Random(seed)
    out = []
    while n > 0:
        size = min(n, rng.randint(5, 12))
        out.append(" ".join(rng.choice(WORDS) + rng.choice(("", "s", "er", "um")) for _ in range(size)).capitalize() + ".")
        n -= size
    lines = [" ".join(out[i : i + 3]) for i in range(0, len(out), 3)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text, source) rows; null texts and ids are allowed."""

    def make(rows, extra=None):
        full = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        df = spark.createDataFrame(
            [(i, t, "en", s, None if t is None else len(t)) for i, t, s in full], DOCS
        )
        return df.selectExpr("*", *extra) if extra else df

    return make


# Null, empty, blank, one word, few words, control characters, symbols, other scripts, one long word.
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "word", "four words are here", "\x00\x1c odd\x85 \xa0 blanks",
    "### || && $$$ %%%", "日本語のテキスト と 少し", "Ünïcödé ÄÖÜ ßtraße", "x" * 20_000, "a b " * 5000, "\n\n\n",
]
