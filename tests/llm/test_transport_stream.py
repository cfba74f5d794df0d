import hashlib
import random
import zlib

import pytest

from textloom.llm import transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 150, 160, 184, 5000, ts.PES_BYTES, ts.PES_BYTES + 1, 3 * ts.PES_BYTES - 7, 1_000_003])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    media = ts.multiplex(ts.pad(raw))
    s = ts.demultiplex(media)
    assert s.payload == ts.pad(raw) and len(media) % 188 == 0
    units = -(-len(ts.pad(raw)) // ts.PES_BYTES)
    assert s.pts == [k * ts.PTS_STEP for k in range(units)] and len(s.random_access) == units and s.discontinuities == 0


def test_every_length_near_packet_bounds():
    for n in range(1, 800):
        raw = bytes(i % 251 for i in range(n))
        assert ts.demultiplex(ts.multiplex(raw)).payload == raw


def test_damage_is_seen():
    media = bytearray(ts.multiplex(ts.pad(b"x" * 5000)))
    with pytest.raises(ts.BrokenStream):
        ts.demultiplex(bytes(media[:-1]))
    lost = bytes(media[: 188 * 5] + media[188 * 6 :])
    with pytest.raises(ts.BrokenStream):
        ts.demultiplex(lost)
    media[188 * 5 + 3] ^= 1
    assert ts.demultiplex(bytes(media)).discontinuities == 2
    media[7] ^= 1
    with pytest.raises(ts.BrokenStream):
        ts.demultiplex(bytes(media))


def test_crc_of_tables():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_rows(spark):
    df = spark.createDataFrame([(1, "abc", 1), (2, None, 1), (3, "", 1), (4, "abc", 2), (None, "é" * 70_000, 1)], "doc_id long, text string, Feature int")
    rows = {r.doc_id: r for r in ts.digests(df).collect()}
    assert rows[1][1:] == rows[4][1:] and rows[2][1:] == rows[3][1:]
    assert rows[1].n_bytes == 3 and rows[1].payload_bytes == 64
    assert rows[1].payload_sha256 == hashlib.sha256(b"abc".ljust(64, b"\0")).hexdigest()
    assert rows[2].tail_crc32 == zlib.crc32(bytes(64))
    assert rows[None].n_bytes == 140_000 and rows[None].payload_bytes == 140_032
    back = ts.read_media(ts.add_media(df.drop("Feature"))).collect()
    assert all(bytes(r.payload) == ts.pad((r.text or "").encode()) and r.error is None for r in back)
    assert ts.digests(df.limit(0)).count() == 0


def test_null_media(spark):
    r = ts.read_media(spark.createDataFrame([(1, None)], "id int, media binary")).collect()[0]
    assert r.payload is None and r.error


def by_hand():
    """A stream typed from the standard: tables as a common multiplexer writes them, null packets, a PES packet of no stated length, PTS and DTS."""
    fill = lambda head: bytes.fromhex(head.replace(" ", "")).ljust(188, b"\xff")
    pat = fill("47 4000 10 00  00 B00D 0001 C1 00 00 0001 F000 2AB104B2")
    pmt = fill("47 5000 10 00  02 B012 0001 C1 00 00 E100 F000 1B E100 F000 15BD4D56")
    null = fill("47 1FFF 10")
    a = bytes(range(170))
    # adaptation of 7 bytes: random access and a PCR; PES 000001E0, length 0, PTS 90000 (marker bits set)
    one = bytes.fromhex("47410030 07 50 000000007E00 000001E0 0000 80 80 05 21 0005 BF21".replace(" ", "")) + a[: 188 - 12 - 14]
    two = bytes.fromhex("47010031" + "%02X" % (188 - 5 - (170 - 162)) + "00") + b"\xff" * (188 - 6 - 8) + a[162:]
    # PTS 93600 and DTS 90000; a stated length of 3 + 10 + 5
    three = bytes.fromhex("47410032" + "%02X" % (188 - 5 - 24) + "00") + b"\xff" * (188 - 6 - 24) + bytes.fromhex("000001E0 0012 80 C0 0A 31 0005 DB41 11 0005 BF21".replace(" ", "")) + b"hello"
    return [pat, pmt, null, one, null, pat, pmt, two, null, three], a + b"hello"


def test_a_stream_made_by_hand():
    packets, payload = by_hand()
    assert [len(p) for p in packets] == [188] * 10
    s = ts.demultiplex(b"".join(packets))
    assert s.payload == payload and s.pts == [90_000, 93_600] and s.random_access == [3]
    assert s.stream_type == 0x1B and s.packets == 10 and s.discontinuities == 0
    gap = packets[:9] + [bytes([*packets[9][:3], packets[9][3] + 3, *packets[9][4:]])]
    assert ts.demultiplex(b"".join(gap)).discontinuities == 1
    told = packets[:9] + [bytes([*gap[9][:5], 0x80, *gap[9][6:]])]
    assert ts.demultiplex(b"".join(told)).discontinuities == 0
    for k in (0, 1):  # a byte of a table
        bad = list(packets)
        bad[k] = bytes([*bad[k][:14], bad[k][14] ^ 4, *bad[k][15:]])
        bad[5 + k] = bad[k]
        with pytest.raises(ts.BrokenStream):
            ts.demultiplex(b"".join(bad))


def test_streams_are_stored_and_read(spark, monkeypatch):
    written = []
    settle = ts.settle
    monkeypatch.setattr(ts, "settle", lambda df, tag: written.append(settle(df, tag)) or written[-1])
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 300_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ts.digests(df).collect()}
    stored = {r.doc_id: bytes(r["__media"]) for r in written[0].collect()}
    for i, text in df.collect():
        assert rows[i].media_sha256 == hashlib.sha256(stored[i]).hexdigest() and rows[i].media_bytes == len(stored[i])
        assert ts.demultiplex(stored[i]).payload == ts.pad(text.encode())
    monkeypatch.setattr(ts, "settle", lambda d, tag: d.selectExpr("doc_id", "concat(substring(__media, 1, 188 * 3 + 3), x'17', substring(__media, 188 * 3 + 5)) as __media", "n_bytes"))
    with pytest.raises(Exception, match="out of order|damaged|wrong start"):
        ts.digests(df).collect()
