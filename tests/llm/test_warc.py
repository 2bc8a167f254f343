from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest

from codeloom.llm import warc

from .helpers import rows

PAGES = "page_id long, url string, html string"


def test_round_trip_of_the_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = warc.round_trip(pages)
    assert rows(out.select("page_id", "url", "html")) == rows(pages.select("page_id", "url", "html"))
    assert out.where("NOT digest_ok OR problem IS NOT NULL").count() == 0


def test_nulls_empty_long_repeated_rows_and_other_columns(spark):
    data = [(1, "http://a/", "<p>ü</p>"), (1, "http://a/", "<p>ü</p>"), (None, None, None), (2, "", ""), (-3, "http://b/\r\n%41", "x\r\n\r\ny" * 300_000), (4, None, "WARC/1.0\r\n\r\n")]
    pages = spark.createDataFrame(data, PAGES)
    clashing = pages.selectExpr("*", "'w' AS payload", "'w' AS headers", "'w' AS digest_ok", "'w' AS record_id")
    assert rows(warc.round_trip(clashing).select("page_id", "url", "html")) == sorted(data, key=repr)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_members_agree_with_gzip_at_every_chunk_size(monkeypatch):
    blocks = [b"a" * 70_000, b"", b"xyz", bytes(range(256)) * 999]
    data = b"".join(gzip.compress(b) for b in blocks) + b"\0" * 10
    for chunk in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [m for _, m, _ in warc.members(io.BytesIO(data))] == blocks
        if chunk == 1:
            monkeypatch.setattr(warc, "CHUNK", 4096)


def test_offsets_name_the_members():
    one = warc.record("<urn:1>", "http://a/", b"one")
    two = warc.record("<urn:2>", "http://b/", b"two")
    found = list(warc.members(io.BytesIO(one + two)))
    assert [at for at, _, _ in found] == [0, len(one)]


def test_broken_members_have_a_problem():
    one = warc.record("<urn:1>", "http://a/", b"one" * 999)
    truncated = list(warc.members(io.BytesIO(one + one[:-30])))
    assert [p for _, _, p in truncated] == [None, "truncated member"]
    assert "not a gzip member" in list(warc.members(io.BytesIO(one + b"garbage")))[-1][2]


@pytest.mark.parametrize("chunk", [50, 4096, 1 << 20])
def test_reading_goes_on_after_a_broken_member(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    good = [warc.record(f"<urn:{i}>", "http://a/", bytes(range(256)) * 40) for i in range(4)]
    flipped = bytearray(good[1])
    flipped[len(flipped) // 2] ^= 0xFF
    for broken in (bytes(flipped), good[1][:-40], b"garbage", good[1][:5], b"\x1f\x8b\x08" * 9):
        data = good[0] + broken + good[2] + good[3]
        found = list(warc.members(io.BytesIO(data)))
        offsets = {at: p for at, _, p in found}
        for at in (0, len(good[0]) + len(broken), len(data) - len(good[3])):
            assert at in offsets and offsets[at] is None, (broken[:9], offsets)
        assert any(offsets.values())


def test_long_payloads_come_in_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "PART_BYTES", 1000)
    payload = bytes(range(256)) * 20
    (tmp_path / "a.warc.gz").write_bytes(warc.record("<urn:1>", "http://a/", payload) + warc.record("<urn:2>", "http://a/", b"x"))
    got = list(warc.records(str(tmp_path / "a.warc.gz")))
    names = [f.split()[0] for f in warc.SCHEMA.split(", ")]
    got = [dict(zip(names, r)) for r in got]
    assert b"".join(r["payload"] for r in got[:-1]) == payload and [r["part"] for r in got] == [0, 1, 2, 3, 4, 5, 0]
    assert [r["digest_ok"] for r in got] == [None] * 5 + [True, True] and not any(r["problem"] for r in got)


def test_files_without_compression(tmp_path):
    blocks = [warc.record(f"<urn:{i}>", "http://a/", b"x" * i) for i in range(3)]
    plain = [gzip.decompress(b) for b in blocks]
    (tmp_path / "a.warc").write_bytes(plain[0] + b"junk\r\n" + plain[1] + plain[2])
    got = list(warc.records(str(tmp_path / "a.warc")))
    assert [(r[2], r[-1]) for r in got if r[2]] == [("<urn:0>", None), ("<urn:1>", None), ("<urn:2>", None)]
    assert sum(r[-1] is not None for r in got) == 1


def test_waiting_files_are_left_out(spark, tmp_path):
    (tmp_path / "_waiting").mkdir()
    for where in (tmp_path, tmp_path / "_waiting"):
        (where / "a.warc.gz").write_bytes(warc.record("<urn:1>", "http://a/", b"x"))
    assert warc.read_warc(spark, str(tmp_path)).count() == 1


def test_text_ids(spark):
    data = [("a b%\r\nü", "http://a/", "x"), ("", None, ""), (None, "u", None)]
    assert rows(warc.round_trip(spark.createDataFrame(data, "page_id string, url string, html string")).select("page_id", "url", "html")) == sorted(data, key=repr)


@pytest.mark.parametrize("algorithm", ["sha1", "md5", "sha256"])
def test_digests_in_base_32_and_hexadecimal(algorithm):
    hexadecimal = f"{algorithm}:{hashlib.new(algorithm, b'block').hexdigest()}"
    for claimed in (warc.digest_of(b"block", algorithm), hexadecimal, hexadecimal.upper().replace(algorithm.upper(), algorithm)):
        head = f"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Block-Digest: {claimed}\r\nContent-Length: 5\r\n\r\n".encode()
        assert warc.parse_record(head + b"block\r\n\r\n")["digest_ok"] is True
        assert warc.parse_record(head + b"clock\r\n\r\n")["problem"] == "digest doesn't match"


def test_framing():
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nX-Long: a\r\n  b\r\nContent-Length: %d\r\n\r\n"
    assert warc.parse_record(head % 3 + b"abc\r\n\r\n") == {"headers": {"warc-type": "resource", "x-long": "a b", "content-length": "3"}, "payload": b"abc", "block_length": 3, "digest_ok": None, "problem": None}
    assert warc.parse_record(head % 9 + b"abc\r\n\r\n")["problem"] == "block shorter than its content length"
    assert warc.parse_record(head % 2 + b"abc\r\n\r\n")["problem"] == "record doesn't end after its block"
    assert warc.parse_record(b"no header")["problem"] == "no WARC header"
    assert warc.parse_record(b"WARC/1.1\r\n\r\n")["problem"] == "no content length"


def test_data_source_reads_files_in_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record(f"<urn:{i}>", f"http://a/{i}", b"x" * i) for i in range(3)))
    (tmp_path / "deep" / "b.warc.gz").write_bytes(warc.record("<urn:9>", None, b"y"))
    (tmp_path / "other.txt").write_bytes(b"z")
    df = warc.read_warc(spark, str(tmp_path))
    assert rows(df.selectExpr("record_id", "uri", "length(payload) AS n", "digest_ok")) == [("<urn:0>", "http://a/0", 0, True), ("<urn:1>", "http://a/1", 1, True), ("<urn:2>", "http://a/2", 2, True), ("<urn:9>", None, 1, True)]
    assert warc.read_warc(spark, str(tmp_path / "deep" / "b.warc.gz")).count() == 1
    assert df.where("digest_ok").count() == 4 and zlib.crc32(b"") == 0
