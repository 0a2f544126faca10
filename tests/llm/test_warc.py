import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from epithet.llm import warc

PAGES = "page_id bigint, url string, html string"
LONG = "<p>payload</p>" * 100


def expected(rows):
    """page_id -> rows of (bytes, digest, type, refers_to), by comparing all payloads."""
    bodies = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for page, body in bodies:
        same = [p for p, b in bodies if b == body and p is not None] if len(body) >= 1000 else []
        holder = max(same, default=page)
        revisit = holder != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, extra=(), schema=PAGES):
    df = spark.createDataFrame(rows, schema).selectExpr("*", *extra)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in names) for r in warc.round_trip(df).collect()), key=str)


def test_round_trip_equals_comparing_all_payloads(spark):
    rows = [
        (1, "https://a.example/x", LONG), (2, "https://a.example/y", LONG), (9, None, LONG), (None, "u", LONG),
        (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "日本語" * 400), (8, "u", "日本語" * 400),
        (10, "bad\r\nWARC-Type: warcinfo\r\n\r\n", "x" * 999), (11, "u", "x" * 999), (12, "u", "x" * 1000), (13, "u", "x" * 1000),
        (14, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (15, "u", "z" * 3_000_000), (9, "again", LONG), (2, "again", LONG),
        (16, "", "\x00\x01" * 800),
    ]
    assert round_trip(spark, rows) == expected(rows)
    clash = [f"'x' AS {c}" for c in ("payload", "key", "holder", "n", "refers_to", "page", "path", "sound", "record_id")]
    assert round_trip(spark, rows, clash) == expected(rows)


def test_a_third_of_all_pages_equal(spark):
    rows = [(i, "u", LONG if i % 3 == 0 else f"{i} " * 400) for i in range(3000)]
    assert round_trip(spark, rows) == expected(rows)


def test_empty_table_and_other_ids(spark):
    assert round_trip(spark, []) == []
    rows = [("a b>+%", "u", LONG), ("é\n", "u", LONG), ("a", "u", "")]
    assert round_trip(spark, rows, schema="page_id string, url string, html string") == expected(rows)


def archives(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_archives(df, str(tmp_path / "archives"))
    return manifest, [Path(r["path"]) for r in manifest.collect()]


def test_every_member_is_one_record(spark, tmp_path):
    rows = [(i, f"https://h.example/{i}", f"<p>{i}</p>" * (i * 37)) for i in range(40)]
    manifest, paths = archives(spark, tmp_path, rows)
    found = {}
    for path in paths:
        data, members = path.read_bytes(), 0
        while data:  # the members by the library, one at a time
            inflater = zlib.decompressobj(31)
            text, data, members = inflater.decompress(data), inflater.unused_data, members + 1
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and inflater.eof
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            assert len(rest) == int(fields[b"Content-Length"]) + 4
            if fields[b"WARC-Type"] == b"response":
                found[int(fields[b"WARC-Record-ID"][12:-1])] = rest[:-4].partition(b"\r\n\r\n")[2].decode()
        assert members == next(r["records"] for r in manifest.collect() if r["path"] == str(path)) + 1
    assert found == {i: h for i, _, h in rows}
    assert sum(r["records"] for r in manifest.collect()) == 40
    read = warc.read_archives(manifest, payloads=True).where("record_type = 'response'").collect()
    assert {int(warc.name_of(r["record_id"])): r["payload"].decode() for r in read} == found
    assert {r["target_uri"] for r in read} == {u for _, u, _ in rows}


def made(payload=b"hello", **changed):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    sha = lambda b: warc.digest_field(hashlib.sha1(b).digest())
    fields = {
        "WARC-Type": "response", "WARC-Record-ID": "<urn:x-page:1>", "WARC-Payload-Digest": sha(payload),
        "WARC-Block-Digest": sha(block), "Content-Type": "application/http; msgtype=response",
    } | changed
    return warc.record(list(fields.items()), block)


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
def test_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    payloads = [b"", b"a" * 5000, b"\r\n\r\n" * 50, bytes(range(256)) * 9]
    data = b"".join(made(p) for p in payloads)
    assert [(r["payload"], r["sound"]) for r in warc.read_records(io.BytesIO(data), True)] == [(p, True) for p in payloads]
    offsets = [r["offset"] for r in warc.read_records(io.BytesIO(data))]
    assert offsets == [sum(len(made(p)) for p in payloads[:i]) for i in range(len(payloads))]


def test_digests_in_hex_and_of_other_kinds():
    hexed = "SHA1:" + hashlib.sha1(b"hello").hexdigest().upper()
    (one,) = warc.read_records(io.BytesIO(made(**{"WARC-Payload-Digest": hexed})))
    (two,) = warc.read_records(io.BytesIO(made(**{"WARC-Payload-Digest": "md5:xyz"})))
    assert one["sound"] and two["sound"] and two["payload_digest"] == hashlib.sha1(b"hello").hexdigest()


def test_wrong_digest_cut_file_and_wrong_length(spark, tmp_path):
    wrong = made(**{"WARC-Payload-Digest": warc.digest_field(bytes(20))})
    assert [r["sound"] for r in warc.read_records(io.BytesIO(wrong))] == [False]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(made(b"x" * 9999)[:-9])))
    for text in (b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"nothing"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(text))))
    path = tmp_path / "wrong.warc.gz"
    path.write_bytes(wrong)
    files = spark.createDataFrame([(str(path),)], "path string")
    with pytest.raises(PySparkException, match="digest of"):
        warc.pages_of(warc.read_archives(files)).collect()


def test_files_are_closed_at_their_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MAX_FILE", 900)
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(50)]
    manifest, paths = archives(spark, tmp_path, rows)
    assert len(paths) > 10
    assert warc.pages_of(warc.read_archives(manifest)).count() == 50
