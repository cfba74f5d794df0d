import io

import pytest

from textloom.llm import warc


def test_records_round_trip():
    payloads = [b"", b"x", "é\r\n\r\nWARC/1.1 <p>".encode() * 20_000]
    raw = b"".join(warc.page_record(i, f"http://a/ b\r\n{i}", p) for i, p in enumerate(payloads)) + warc.page_record(9, None, payloads[2], 2)
    found = list(warc.read_records(io.BytesIO(raw)))
    assert [r.payload for r in found[:3]] == payloads and [r.kind for r in found] == ["response"] * 3 + ["revisit"]
    assert found[3].headers["warc-refers-to"] == "<urn:x-page:2>" and found[3].payload == b""
    assert found[3].headers["warc-payload-digest"] == f"sha1:{warc.digest(payloads[2])}"


def test_damage_is_seen():
    raw = warc.page_record(1, "u", b"payload" * 100)
    for bad in (raw[:-9], raw[:50], b"no gzip" + raw, raw + b"x" * 30):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_records(io.BytesIO(bad)))
    wrong = warc.record("response", {"Content-Type": "application/http", "WARC-Payload-Digest": "sha1:AAAA"}, b"HTTP/1.1 200 OK\r\n\r\nabc")
    with pytest.raises(warc.BrokenArchive, match="payload digest"):
        list(warc.read_records(io.BytesIO(wrong)))


ROWS = [(1, "http://a/", "same", 0), (2, None, "same", 0), (3, "http://b/", "other", 0), (4, "u", None, 0), (5, "u", "", 0), (2, None, "same", 0), (None, "u", "same", 0)]


def test_query_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload_bytes int")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    best = {}
    for p, _, h, _ in ROWS:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    want = []
    for p, _, h, _ in ROWS:
        raw = (h or "").encode()
        to = best[h or ""] if p is not None and best[h or ""] != p else None
        want.append((p, len(raw), warc.digest(raw), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)


def test_oracle(spark, tmp_path):
    import duckdb

    from textloom.llm.queries import ORACLE_SQL

    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, x int")
    df.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    want = con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLE_SQL['op2_warc']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.round_trip(df).collect())


def test_least_size_for_revisits(spark):
    df = spark.createDataFrame(ROWS[:6], "page_id long, url string, html string, x int")
    rows = {r.page_id: r for r in warc.round_trip(df, min_revisit_bytes=1).collect()}
    assert rows[4].record_type == "response" and rows[1].refers_to == 2


def test_empty_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
    (tmp_path / "a.warc.gz").write_bytes(warc.page_record(1, "u", b"abc") + warc.page_record(2, "u", b"abc", 1))
    (tmp_path / "b.warc.gz").write_bytes(warc.page_record(3, "u", b"abc") + b"\x1f\x8b broken")
    rows = warc.read_files(spark, f"file://{tmp_path}").collect()
    name = lambda r: r.archive.rpartition("/")[2]
    assert sorted((name(r), r.record_id, r.payload_bytes) for r in rows if r.error is None) == [("a.warc.gz", "<urn:x-page:1>", 3), ("a.warc.gz", "<urn:x-page:2>", None), ("b.warc.gz", "<urn:x-page:3>", 3)]
    assert [name(r) for r in rows if r.error] == ["b.warc.gz"]


def test_files_are_read_a_piece_at_a_time():
    class Slow(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert 0 < n <= warc.READ_BYTES
            Slow.most += n
            return super().read(n)

    page = bytes(range(256)) * 4000
    source = Slow(b"".join(warc.page_record(i, "u", page + bytes([i])) for i in range(3)))
    found = warc.read_records(source)
    assert next(found).payload == page + b"\0"
    early = Slow.most
    assert [r.payload[-1] for r in found] == [1, 2] and Slow.most >= early


def test_damage_fails_the_round_trip(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, x int")
    settle = warc.settle
    for harm, why in (
        ("concat(substring(content, 1, length(content) - 9))", "damaged"),
        ("concat(content, x'00')", "damaged"),
        ("x''", "records were read"),
    ):
        monkeypatch.setattr(warc, "settle", lambda d, tag, h=harm: settle(d.selectExpr("archive", f"{h} as content") if tag == "warc" else d, tag))
        with pytest.raises(warc.BrokenArchive, match=why):
            warc.round_trip(df)
    monkeypatch.setattr(warc, "settle", lambda d, tag: settle(d.where("record_id <> '<urn:x-page:2>'") if tag == "warc-records" else d, tag))
    monkeypatch.setattr(warc, "checked", lambda records, n: records)
    with pytest.raises(Exception, match="refers to no response"):
        warc.round_trip(df).collect()


def test_many_repeated_payloads_by_shuffle(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, x int")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(warc.mark_revisits(df)) == rows(warc.mark_revisits(df, broadcast_digests=0))
