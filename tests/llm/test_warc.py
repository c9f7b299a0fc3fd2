import gzip
import hashlib
import io
import random
import time
import tracemalloc

import numpy as np
import pytest

from basinflow.llm import warc


@pytest.fixture(scope="module")
def archive():
    rng = random.Random(2)
    raw = []
    for i in range(30):
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) if i % 5 else b"\x1f\x8b\x08WARC/1.1\r\n" * i
        raw.append(warc.record(i, f"http://x/{i}\n", body, hashlib.sha256(body).hexdigest(), None))
    members = [warc.member(r) for r in raw]
    starts = [0]
    for m in members:
        starts.append(starts[-1] + len(m))
    return raw, members, starts


def ids(found):
    return sorted(int(f.headers["x-page-id"]) for f in found)


def test_whole_archives(archive):
    raw, members, starts = archive
    for data in (b"".join(members), b"".join(raw)):
        found, gaps = warc.salvage(data)
        assert ids(found) == list(range(30)) and gaps == []
    assert gzip.decompress(b"".join(members)) == b"".join(raw)
    assert warc.salvage(b"") == ([], [])


def test_damage_in_members_is_a_gap(archive):
    _, members, at = archive
    data = bytearray(b"".join(members))
    data[at[5] + 40] ^= 255
    data[at[9] + 1] ^= 7
    data = bytes(data[: at[12]]) + b"junk\x1f\x8b\x08junk" + bytes(data[at[12] : -5])
    found, gaps = warc.salvage(data)
    assert ids(found) == [i for i in range(30) if i not in (5, 9, 29)]
    assert [(g.start, g.end) for g in gaps] == [(at[5], at[6]), (at[9], at[10]), (at[12], at[12] + 11), (at[29] + 11, len(data))]
    covered = sorted([(g.start, g.end) for g in gaps] + [(f.start, f.end) for f in found])
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_damage_in_plain_archives_is_a_gap(archive):
    raw, _, _ = archive
    at = [0]
    for r in raw:
        at.append(at[-1] + len(r))
    data = bytearray(b"".join(raw))
    data[at[6] + 1] ^= 1  # the version line
    data[at[8] - 10] ^= 1  # the payload of record 7
    data[at[11]] ^= 1
    found, gaps = warc.salvage(bytes(data[: at[20] + 30]))
    assert ids(found) == [i for i in range(20) if i not in (6, 7, 11)]
    assert [(g.start, g.end) for g in gaps] == [(at[6], at[7]), (at[7], at[8]), (at[11], at[12]), (at[20], at[20] + 30)] or [(g.start, g.end) for g in gaps] == [(at[6], at[8]), (at[11], at[12]), (at[20], at[20] + 30)]


def test_wrong_content_length(archive):
    raw, _, _ = archive
    broken = raw[3].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found, gaps = warc.salvage(raw[2] + broken + raw[4])
    assert ids(found) == [2, 4] and len(gaps) == 1


def big_record(i, body):
    return warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)


def test_damaged_first_member_over_4_kb(archive):
    _, members, at = archive
    rng = random.Random(4)
    first = warc.member(big_record(99, bytes(rng.randrange(97, 123) for _ in range(20_000))))
    assert len(first) > 8192
    data = bytearray(first + b"".join(members))
    data[0] ^= 255
    found, gaps = warc.salvage(bytes(data))
    assert ids(found) == list(range(30)) and [(g.start, g.end) for g in gaps] == [(0, len(first))]
    found, gaps = warc.salvage(b"\0" * 5000 + b"".join(members))
    assert ids(found) == list(range(30)) and [(g.start, g.end) for g in gaps] == [(0, 5000)]


def test_plain_archive_of_gzip_bodies():
    raw = [big_record(i, gzip.compress(b"<p>page</p>" * (i + 1))) for i in range(5)]
    assert warc.salvage(b"".join(raw))[1] == [] and ids(warc.salvage(b"".join(raw))[0]) == [0, 1, 2, 3, 4]
    data = bytearray(b"".join(raw))
    data[len(raw[0]) + 1] ^= 1
    found, gaps = warc.salvage(bytes(data))
    assert ids(found) == [0, 2, 3, 4] and [(g.start, g.end) for g in gaps] == [(len(raw[0]), len(raw[0]) + len(raw[1]))]


def test_members_and_plain_records_mixed(archive):
    raw, members, _ = archive
    found, gaps = warc.salvage(b"".join(m if i % 2 else r for i, (m, r) in enumerate(zip(members, raw))))
    assert ids(found) == list(range(30)) and gaps == []
    broken = bytes([members[1][0] ^ 1]) + members[1][1:]
    found, gaps = warc.salvage(broken + raw[2] + members[3])
    assert ids(found) == [2, 3] and [(g.start, g.end) for g in gaps] == [(0, len(broken))]


@pytest.mark.parametrize("form", ["members", "plain", "one member", "mixed"])
def test_damage_at_every_byte_loses_one_record_at_most(form):
    raw = [big_record(i, b"<p>%d page</p>" % i * (3 * i) if i % 2 else gzip.compress(b"%d" % i * 50)) for i in range(4)]
    parts = {"members": [warc.member(r) for r in raw], "plain": raw, "one member": [warc.member(b"".join(raw))], "mixed": [warc.member(r) if i % 2 else r for i, r in enumerate(raw)]}[form]
    data = b"".join(parts)
    owner = [k for k, p in enumerate(parts) for _ in p]
    for at in range(len(data)):
        for flip in (0xFF, 0x01):
            broken = bytearray(data)
            broken[at] ^= flip
            records = list(warc.scan(warc.Archive(io.BytesIO(bytes(broken)), len(broken)), False))
            found = {warc._number(f.headers.get("x-page-id")) for f in records if isinstance(f, warc.Found)}
            if form != "one member":
                assert set(range(4)) - {owner[at]} <= found, at
            covered = sorted({(r.start, r.end) for r in records})
            assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:])), at


def test_damage_inside_a_member_of_many_records():
    raw = [big_record(i, b"page %d " % i * 40) for i in range(6)]
    inner = raw[0] + raw[1][:50] + raw[2] + b"WARC/1.1 no\r\nWARC/1.1\r\n" + raw[3] + raw[4][:-7] + raw[5]
    found, gaps = warc.salvage(warc.member(inner) + warc.member(raw[1]) + warc.member(b""))
    assert ids(found) == [0, 1, 2, 3, 5]
    first = len(warc.member(inner))
    assert [(g.start, g.end) for g in gaps] == [(0, first), (first + len(warc.member(raw[1])), first + len(warc.member(raw[1])) + len(warc.member(b"")))]


def test_blocks_without_an_http_head(monkeypatch):
    block = b"software: x\r\nformat: WARC" * 40_000
    raw = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data in (raw, warc.member(raw)):
        ((one,), gaps) = warc.salvage(data + data)[0][:1], warc.salvage(data + data)[1]
        assert one.payload == b"" and one.payload_bytes == 0 and gaps == [] and len(warc.salvage(data + data)[0]) == 2


def test_heads_and_signs_across_block_borders(archive, monkeypatch):
    raw, members, _ = archive
    data = b"junk" + b"".join(members[:9]) + b"junk" + b"".join(raw[9:15])
    want = warc.salvage(data)
    for block, step in ((7, 5), (64, 1), (1000, 1000), (4096, 17)):
        monkeypatch.setattr(warc, "BLOCK", block)
        monkeypatch.setattr(warc, "STEP", step)
        assert warc.salvage(data) == want
    assert [bytes(f.payload) for f in want[0]] == [r.split(b"\r\n\r\n", 2)[2][:-4] for r in raw[:15]]


def test_memory_follows_no_member():
    body = b"\0" * (48 << 20)
    data = warc.member(big_record(1, body)) + warc.member(big_record(2, b"x"))
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 255
    del body
    tracemalloc.start()
    assert ids(warc.salvage(data, with_payload=False)[0]) == [1, 2] and ids(warc.salvage(bytes(bad), with_payload=False)[0]) == [2]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_long_payloads_and_extra_columns(spark, tmp_path):
    long = "é<p>" * 700_000
    rows = [(1, "u" * 100_000, long, "x", 1), (2, "u", long, None, 2), (3, "u", "short", "y", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, start long")
    got = {r.page_id: r for r in warc.archive_pages(pages, folder=f"file://{tmp_path}/w", complete=True).collect()}
    assert bytes(got[1].payload).decode() == long and got[1].url == "u" * 100_000 and got[1].payload_bytes == len(long.encode())
    assert (got[2].record_type, got[2].refers_to, got[2].payload, got[2].payload_bytes) == ("revisit", 1, None, len(long.encode())) and bytes(got[3].payload) == b"short"


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>" + "é" * 100 + "</p>", "<p>x</p>"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else small if i % 3 == 1 else f"page {i} " * 30) for i in range(9, 60)]
    rows += [(5, None, big), (70, "http://h/\r\nX: y", None), (71, "u", ""), (None, "http://h", big), (72, "u", "page 11 " * 30), (72, "u", "page 11 " * 30)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path long")


def test_round_trip(spark, pages, tmp_path):
    got = warc.archive_pages(pages, folder=f"file://{tmp_path}/w", roll_bytes=500).collect()
    rows = pages.collect()
    assert len(got) == len(rows) and all(r.gap_reason is None for r in got) and len({r.path for r in got}) > 3
    low = {}
    for r in rows:
        if r.page_id is not None:
            low[r.html or ""] = min(low.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        to = low.get(r.html or "")
        again = len(body) >= 100 and r.page_id is not None and r.page_id > to
        want.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", to if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    html = {r.page_id: r.html or "" for r in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_reader_logs_gaps_and_recovers(spark, pages, tmp_path):
    folder = tmp_path / "damaged"
    rows = warc.with_revisits(pages, "page_id", "url", "html").coalesce(1)
    manifest = warc.write_archives(rows, f"file://{folder}").collect()
    (path,) = [r.path for r in manifest]
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 255
    open(name, "wb").write(bytes(data))
    got = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert sum(r.gap_reason is None for r in got) == pages.count() - 1
    assert sum(r.end - r.start for r in got) == len(data)


def test_query_fails_if_a_record_is_lost(spark, pages, tmp_path, monkeypatch):
    from basinflow.llm import catalog

    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.op2_warc(spark, str(tmp_path)).count() == pages.count()
    keep = warc.Scratch.keep

    def damaging(self, df, name):
        out = keep(self, df, name)
        if name == "manifest":
            path = out.first().path.removeprefix("file://").removeprefix("file:")
            data = bytearray(open(path, "rb").read())
            data[len(data) // 2] ^= 255
            open(path, "wb").write(bytes(data))
        return out

    monkeypatch.setattr(warc.Scratch, "keep", damaging)
    with pytest.raises(Exception, match="records read"):
        catalog.op2_warc(spark, str(tmp_path)).collect()


def test_empty_table(pages):
    assert warc.archive_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("length", ["²", "٣", "9" * 5000, "-1", "1e3", "", " ", "0x10", "18446744073709551616"])
@pytest.mark.parametrize("packed", [False, True])
def test_lengths_that_are_no_plain_number(length, packed):
    good = [warc.record(i, "http://a/", b"p" * 20, "0" * 64, None).replace(b"sha256:" + b"0" * 64, b"none") for i in range(3)]
    bad = good[1].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: " + length.encode() + b"\r\nX: ", 1)
    data = good[0] + bad + good[2]
    records, gaps = warc.salvage(warc.member(data) if packed else data)
    assert [r.headers["x-page-id"] for r in records] == ["0", "2"] and gaps


def test_random_damage_never_raises():
    rng = np.random.default_rng(11)
    records = [warc.record(i, f"http://a/{i}", bytes(rng.integers(0, 256, 50, dtype=np.uint8)), "0" * 64, None if i % 3 else 0) for i in range(6)]
    signs = [b"WARC/", b"\r\n", b"\r\n\r\n", b"Content-Length: \xc2\xb2\r\n", b"\x1f\x8b\x08", b":", b"\xff", b"Content-Length: 99999999999999999999\r\n\r\n"]
    for form in (b"".join(records), b"".join(map(warc.member, records)), warc.member(b"".join(records))):
        for _ in range(300):
            data = bytearray(form)
            for _ in range(rng.integers(1, 5)):
                at = int(rng.integers(len(data)))
                data[at : at + int(rng.integers(0, 40))] = signs[rng.integers(len(signs))]
            found, gaps = warc.salvage(bytes(data))
            assert len(found) <= 6 and (gaps or len(found) == 6 or len(data) < len(form))


@pytest.mark.parametrize("unit", [b"WARC/ ", b"WARC/\r\n", b"WARC/:\r\n", b"WARC/:\r\n\r\n", b"WARC/1.1\r\nContent-Length: 7\r\n\r\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_salvage_takes_time_in_proportion(unit, packed):
    """20 MB of what looks like version lines, whole headers among them, and a record behind."""
    good = warc.record(1, "http://a/", b"p" * 200, "0" * 64, None).replace(b"sha256:" + b"0" * 64, b"none")
    data = unit * (20_000_000 // len(unit)) + b"\r\n\r\n" + good
    began = time.perf_counter()
    records, _ = warc.salvage(warc.member(data, 1) if packed else data)
    assert [r.headers.get("x-page-id") for r in records] == ["1"]
    assert time.perf_counter() - began < 60
