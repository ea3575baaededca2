import gzip
from pathlib import Path

import pytest

from inkmeter.llm import warc

from .helpers import clashing


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "é", "ü" * 300_000), (6, "é", "ü" * 300_000), (None, "n", "same"), (7, "z", "own\r\n\r\nWARC/1.1")]


def test_round_trip_of_odd_rows(spark):
    got = warc.round_trip(pages(spark, ROWS)).collect()
    count = lambda key, kind: sum(r.page_id == key and r.record_type == kind for r in got)
    assert len(got) == len(ROWS) and count(6, "response") == 2
    by = {r.page_id: r for r in got}
    for i, _, html in ROWS:
        data = (html or "").encode()
        assert by[i].payload_digest == warc.base32_sha1(data) and by[i].payload_bytes == len(data)
        assert by[i].payload is None if by[i].record_type == "revisit" else bytes(by[i].payload) == data
    assert {i: (by[i].record_type, by[i].refers_to) for i in (1, 2, 3, None, 4, 5)} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), None: ("revisit", 3), 4: ("revisit", 5), 5: ("response", None)}


def test_archives_are_gzip_files_with_a_member_per_record(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_warc(pages(spark, ROWS), path)
    data = [p.read_bytes() for p in Path(f"{tmp_path}/out").glob("part-*")]
    assert sum(gzip.decompress(d).count(b"WARC-Record-ID") for d in data if d) == len(ROWS)
    assert sum(len([b"".join(m) for m in warc.members(d)]) for d in data) == len(ROWS)


def test_minimum_size_and_empty_table(spark):
    got = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_revisit=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", 7, warc.base32_sha1(b"payload"), None, False, "2000-01-01T00:00:00Z")
    for step in (1, 7, len(good)):
        assert warc.parse(good[k : k + step] for k in range(0, len(good), step)).payload == b"payload"
    for bad in (good.replace(b"payload", b"pAyload"), good[:-1], good + b"x", b"WARD" + good[4:], good[:40], good.replace(b"Content-Length: 7", b"Content-Length 7"), b""):
        with pytest.raises(warc.BadRecord):
            warc.parse([bad])
    z = warc.member(good)
    for cut in (z[:-9], z[:20] + b"\xff" + z[21:]):
        with pytest.raises(warc.BadRecord):
            [warc.parse(m) for m in warc.members(cut)]


def test_a_large_record_is_read_in_pieces():
    html = b"<p>" + b"x" * (5 << 20)
    z = warc.member(warc.record(1, "u", html, len(html), warc.base32_sha1(html), None, False, "d"))
    sizes = [len(x) for m in warc.members(z + b"\0" + z) for x in m]
    assert max(sizes) <= warc.PIECE and sum(sizes) > 2 * len(html)
    assert [warc.parse(m).payload == html for m in warc.members(z + b"\0" + z)] == [True, True]


def test_archives_of_others(spark, tmp_path):
    """Any file name, further record types, names that aren't numbers."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    one = warc.record(5, "http://x/", b"hi", 2, warc.base32_sha1(b"hi"), None, False, "d")
    (tmp_path / "crawl").mkdir()
    (tmp_path / "crawl" / "a-00.warc.gz").write_bytes(warc.member(info) + warc.member(one))
    got = sorted(warc.read_warc(spark, f"file://{tmp_path}").collect(), key=lambda r: r.record_type)
    assert [(r.page_id, r.record_type, r.url, bytes(r.payload)) for r in got] == [(5, "response", "http://x/", b"hi"), (None, "warcinfo", None, b"abcd")]


def test_clashing_columns(spark):
    d = clashing(pages(spark, ROWS[:4]), "id", "sha1", "payload", "response", "revisit", "bytes", "n")
    assert {r.page_id: r.record_type for r in warc.round_trip(d).collect()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response"}


def test_many_equal_payloads(spark):
    rows = [(k, f"http://x/{k}", "hot" if k % 3 else f"own {k % 50}") for k in range(900)]
    best = {}
    for k, _, h in rows:
        best[h] = max(best.get(h, -1), k)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {k: ("response", None, len(h)) if best[h] == k else ("revisit", best[h], len(h)) for k, _, h in rows}
