"""Ogg: checksums, lacing, several streams, times, damage, round trip."""

import hashlib
import zlib

import pytest

from tracelens.llm import ogg_media as O
from tracelens.llm.queries import op2_ogg_media


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("data", [b"", b"\0", b"OggS" * 9, bytes(range(256))])
def test_checksum(data):
    assert O.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [1, 254, 255, 256, 510], [255 * 255], [255 * 255 + 7, 3], [70_000, 0, 5], [9] * 300])
def test_lacing_round_trip(sizes):
    packets = [bytes([k % 251]) * n for k, n in enumerate(sizes)]
    streams, bad = O.demux(O.mux([O.pages_of(5, [(p, k) for k, p in enumerate(packets)]), O.pages_of(6, [(b"x", 0)])]))
    assert not bad and streams[5].packets == packets and streams[6].packets == [b"x"] and streams[5].ended


def test_times():
    frames = [b"a" * 100, b"b" * 100, b"c" * 50]
    media = O.mux([O.pages_of(1, [(b"head", 0), (frames[0], 100), (frames[1], 200), (frames[2], 250)], per_page=3)])
    s = O.demux(media)[0][1]
    assert O.times(s, [0, 100, 100, 50], 100) == [0.0, 1.0, 2.0, 2.5]


def test_damage():
    payload = O.pad(b"hello " * 20_000)
    media = bytearray(O.to_ogg(payload, 7))
    media[len(media) // 2] ^= 1
    got, _, shown = O.from_ogg(bytes(media))
    assert shown["bad"] >= 1 and len(got) < len(payload)
    assert O.from_ogg(b"no ogg at all")[2]["streams"] == 0 and O.from_ogg(b"")[0] == b""
    assert O.from_ogg(b"junk" + O.to_ogg(O.pad(b"x"), 1))[0] == O.pad(b"x")


def test_documents(docs, rows, empty, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op2_ogg_media(spark, str(tmp_path)).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = O.pad(raw)
        x = got[r[0]]
        assert (x["n_bytes"], x["payload_bytes"]) == (len(raw), len(payload)) and len(payload) % 192 == 0 and payload
        assert x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-16:])
        assert x["media_sha256"] == hashlib.sha256(O.to_ogg(payload, len(raw))).hexdigest() and "bad=0" in x["feature"]
    assert got[0]["media_sha256"] == got[1]["media_sha256"] == got[2]["media_sha256"]
    assert O.read_media(O.write_media(empty)).count() == 0
