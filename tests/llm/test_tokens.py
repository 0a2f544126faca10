import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from epithet.llm import byte_bpe, chat_format, token_counts
from epithet.llm.byte_bpe import ByteBpe, PerfectHash

from .conftest import ODD, prose

TEXTS = [
    *ODD, prose(1, 400), "don't WON'T we'll", "<|endoftext|> is text", "\U0001f600\U0001f468\u200d\U0001f469" * 9,
    " " * 3000, "!?" * 2000, "a" * 5000, "\r\n\t mixed \r\n", "naïve café", "1234567890" * 30, "\ufffd\u0000",
]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load()


@pytest.fixture(scope="module")
def library(bpe):
    ranks = {t: i for i, t in enumerate(bpe.tokens)}
    return tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect(bpe):
    assert all(bpe.lookup.slot(t) == i for i, t in enumerate(bpe.tokens))
    assert sorted(bpe.lookup.slots) == list(range(len(bpe.tokens)))
    few = PerfectHash([b"a", b"b", b"c"])
    assert [few.slot(k) for k in (b"a", b"b", b"c")] == [0, 1, 2]


def test_ids_are_the_librarys(bpe, library):
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab é\n'.9東🙂") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for text in [t or "" for t in TEXTS] + noise:
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_memory_is_bounded(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 8)
    monkeypatch.setattr(byte_bpe, "PROBES", 8)
    small = ByteBpe(bpe.tokens, bpe.pattern)
    for n in range(5):
        assert small.encode(prose(n, 60)) == library.encode_ordinary(prose(n, 60))
    assert len(small.memory) < 80 and len(small.probes) <= 8


def test_round_trip_frames(make_docs, library):
    docs = make_docs(TEXTS + TEXTS[:5], ["1 AS ids", "2 AS n_tokens"])
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, text in enumerate(TEXTS + TEXTS[:5]):
        ids = library.encode_ordinary(text or "")
        expected = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == expected
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS + TEXTS[:5])}
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


# --- chat formatting ---------------------------------------------------------


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = ["\\", "[INST]", "[/INST]", "</s>", "<s>", "<", "s>", "[", "INST]", "<<SYS>>", "x", "<|im_end|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert chat_format.unescape(chat_format.escape(text)) == text


def test_conversations(spark):
    rows = [
        (1, 1, "user", "</s>[INST] ok"), (1, 2, "assistant", "\\</s>"), (1, 0, "system", "[/INST]"), (1, 3, "user", None),
        (2, 0, None, "who"), (2, 1, "assistant", ""), (2, 2, "assistant", "x" * 9000), (2, 3, "[INST]", "role"),
        (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, None, "assistant", "lost"),
    ]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} \\[INST]") for t in range(300)]
    turns = spark.createDataFrame([(*r, "e", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string, mask int")
    got = {r.conv_id: r for r in chat_format.conversation_report(turns).collect()}
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or 0)]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss)
        marks = sum(len(m) for m in chat_format.MARKERS)
        assert r.formatted_chars == sum(marks + len(chat_format.escape(a)) + len(chat_format.escape(b)) for a, b in own)
    assert len(got) == len({r[0] for r in rows})
    only = chat_format.conversation_report(turns.limit(0)).collect()
    assert [r.conv_id for r in only] == [-7]


def test_mask_covers_assistant_texts_alone(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general greeting")], "conv_id bigint, turn bigint, role string, text string")
    bpe = ByteBpe.load()
    rows = chat_format.format_turns(turns, bpe).orderBy("turn").collect()
    assert not any(rows[0].mask)
    under = [i for i, m in zip(rows[1].ids, rows[1].mask) if m]
    assert bpe.decode(under) == b"general greeting"


# --- token counts ------------------------------------------------------------


def brute_counts(tokens, end):
    at = np.flatnonzero(tokens == end)
    starts = np.concatenate([[0], at + 1])
    counts = [(int(e - s), True) for s, e in zip(starts, at)]
    rest = len(tokens) - (int(at[-1]) + 1 if len(at) else 0)
    return counts + ([(rest, False)] if rest else [])


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_flat_files(spark, tmp_path, block_bytes):
    rng = np.random.default_rng(block_bytes)
    expected = {}
    for n, share in enumerate([0.5, 0.1, 0.01, 0.0, 1.0]):
        tokens = np.where(rng.random(200) < share, 9, rng.integers(10, 60_000, 200)).astype("<u2")
        tokens.tofile(tmp_path / f"f{n}.bin")
        expected[f"f{n}.bin"] = brute_counts(tokens, 9)
    np.zeros(0, "<u2").tofile(tmp_path / "none.bin")
    blocks = token_counts.flat_blocks(token_counts.listed(spark, str(tmp_path)), block_bytes=block_bytes)
    got = {}
    for r in token_counts.count_tokens(blocks, separator=9).orderBy("file", "ordinal").collect():
        rows = got.setdefault(r.file.rsplit("/", 1)[1], [])
        assert r.ordinal == len(rows)
        rows.append((r.n_tokens, r.ended))
    assert got == expected


def test_documents_as_flat_files(make_docs, monkeypatch):
    monkeypatch.setattr(token_counts.flat_blocks, "__defaults__", (token_counts.DTYPE, 64))
    texts = [*ODD, *[prose(n, 7 * n) for n in range(40)]]
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(make_docs(texts, ["1 AS ends", "2 AS file"])).collect()}
    assert got == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert token_counts.document_token_counts(make_docs([])).count() == 0


def test_ids_of_any_type_and_repeated_rows(spark):
    for kind in ("string", "double", "date"):
        docs = spark.sql(f"SELECT CAST(x AS {kind}) AS doc_id, t AS text FROM VALUES ('2024-01-05', 'a b'), ('2024-01-05', 'a b'), (NULL, 'c') AS v(x, t)" if kind != "double" else "SELECT x AS doc_id, t AS text FROM VALUES (1.5D, 'a b'), (1.5D, 'a b'), (NULL, 'c') AS v(x, t)")
        got = sorted((r.doc_id is None, r.n_tokens) for r in token_counts.document_token_counts(docs).collect())
        assert got == [(False, 2), (False, 2), (True, 1)]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """A sparse file beyond 2 GB is read in ranges, by several tasks."""
    path, size = tmp_path / "large.bin", 3 << 30
    with open(path, "wb") as f:
        f.truncate(size)
        for at in (10, (2 << 30) + 20, size - 2):
            f.seek(at)
            f.write(np.array([7], "<u2").tobytes())
    blocks = token_counts.flat_blocks(token_counts.listed(spark, str(path)), block_bytes=16 << 20)
    rows = token_counts.count_tokens(blocks, separator=7).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.ended) for r in rows] == [(5, True), ((1 << 30) + 10 - 6, True), (size // 2 - 1 - (1 << 30) - 11, True)]
    tasks = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3
