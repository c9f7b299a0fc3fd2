"""WARC archives: a writer with revisit records, and a reader that salvages.

The writer stores one record per page, each its own gzip member, in archives of bounded
size under the shared folder. A task's archives count only once its manifest rows are
committed, so a lost or repeated task leaves no record twice. The reader checks every
record (member, version line, lengths, digests). After a failed check it searches for the
nearest valid member or version line, goes on from there, and logs the bytes between as a
quarantined gap; a search takes time in proportion to the bytes. Headers of members are
covered by the member's checksum; those of records that aren't in a member have no check
of their own, so a changed header value there goes unseen. Archives are read in blocks: memory follows the largest payload that is
asked for, not an archive or what a member inflates to.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROLL_BYTES = 64 << 20
LEAST_REVISIT_BYTES = 100
#: Payload bytes of a batch of rows that the reader gives, about.
BATCH_BYTES = 16 << 20
_VERSION = b"WARC/1.1\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _header_text(value: str) -> str:
    """A header value without control characters, percent-encoded as UTF-8."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP head alone, which tells the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines.append(f"WARC-Profile: {_REVISIT_PROFILE}")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>")
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """Bytes as one gzip member, the same on every run."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


@dataclass
class Found:
    """A valid record; its payload is None where it wasn't asked for."""

    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    start: int
    end: int


@dataclass
class Gap:
    """Bytes that no valid record covers."""

    start: int
    end: int
    reason: str


_MEMBER, _LINE, _BREAK = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"
#: Bytes that are read, inflated or kept for a search at once, and that a forward reader takes.
BLOCK, STEP = 1 << 18, 1 << 14
#: Bytes of a header; a longer one isn't valid.
MOST_HEADER = 64 << 20
#: Bytes of the head inside a block whose lines are looked at.
MOST_HEAD = 1 << 20


class Archive:
    """A seekable file's bytes by position, of which one block is held."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size
        self._at, self._block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a position on, less only at the end of the held block or the file."""
        if not self._at <= at < self._at + len(self._block):
            self.file.seek(at)
            self._at, self._block = at, self.file.read(BLOCK)
        return self._block[at - self._at : at - self._at + n]

    def exactly(self, at: int, n: int) -> bytes:
        """n bytes, less only at the end of the file."""
        out = b""
        while len(out) < n and (more := self.read(at + len(out), n - len(out))):
            out += more
        return out

    def find(self, sign: bytes, at: int) -> int:
        """First position from ``at`` on where a sign stands, the file's size if there is none."""
        tail = b""
        while part := self.read(at, BLOCK):
            place = (tail + part).find(sign)
            if place >= 0:
                return at - len(tail) + place
            at += len(part)
            tail = (tail + part)[1 - len(sign) :]
        return self.size


class _Plain:
    """Forward bytes of the archive itself, from a position on."""

    def __init__(self, archive: Archive, at: int):
        self.archive, self.at = archive, at

    def more(self) -> bytes:
        out = self.archive.read(self.at, STEP)
        self.at += len(out)
        return out


class _Inflated:
    """Forward content of the gzip member at a position; ``end`` is the member's end once all is read."""

    def __init__(self, archive: Archive, at: int):
        self.archive, self.at, self.end = archive, at, -1
        self._z, self._held = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """Next bytes, empty at the member's end; an error if it isn't valid."""
        while self.end < 0:
            raw = self._held or self.archive.read(self.at, STEP)
            if not self._held:
                self.at += len(raw)
            if not raw:
                raise zlib.error("the archive ends inside a member")
            out = self._z.decompress(raw, BLOCK)
            self._held = self._z.unconsumed_tail
            if self._z.eof:
                self.end = self.at - len(self._z.unused_data)
            if out:
                return out
        return b""


class _Cursor:
    """Reads a source forwards, holding little of it."""

    def __init__(self, source: _Plain | _Inflated):
        self.source, self.held, self.at, self.done = source, b"", 0, False

    def fill(self, n: int) -> int:
        """Holds n bytes, less only at the end."""
        parts, size = [self.held], len(self.held)
        while size < n and not self.done:
            parts.append(self.source.more())
            size += len(parts[-1])
            self.done = not parts[-1]
        self.held = b"".join(parts)
        return len(self.held)

    def take(self, n: int) -> bytes:
        """Up to n bytes, none at the end."""
        if not self.held:
            self.fill(1)
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def skip_to(self, at: int) -> None:
        while self.at < at and self.take(at - self.at):
            pass

    def until(self, sign: bytes, most: int) -> bytes | None:
        """Bytes before a sign, which are taken with it; None if it isn't among the next ones."""
        looked = 0
        while True:
            place = self.held.find(sign, max(0, looked - len(sign)))
            if place >= 0:
                out = self.held[:place]
                self.held = self.held[place + len(sign) :]
                self.at += place + len(sign)
                return out
            looked = len(self.held)
            if looked > most or self.done or self.fill(looked + max(STEP, looked)) == looked:
                return None


def _length(value: str) -> int:
    """A length as headers give it, ASCII digits alone; -1 if it is none that a store could hold."""
    return int(value) if value.isascii() and value.isdigit() and len(value) <= 18 else -1


def version_lines(source: _Plain | _Inflated, at: int) -> Iterator[tuple[int, int]]:
    """(place, end) of records that may begin in a source whose first byte is at ``at``, in order; one pass.

    A place has a version line that lines with a colon follow up to an empty one, among
    them a length. Of the version lines before one empty line the first and the last count.
    """
    held, base, looked, more = bytearray(), at, 0, True
    while more:
        part = source.more()
        held += part
        more = bool(part)
        while (stop := held.find(_BREAK, looked)) >= 0:
            if (first := held.find(_LINE, 0, stop)) >= 0:
                lines = bytes(held[first:stop]).split(b"\r\n")
                starts = list(accumulate((len(x) + 2 for x in lines), initial=base + first))
                low = len(lines) - 1
                while low > 0 and b":" in lines[low]:
                    low -= 1
                named = [i for i in range(low + 1, len(lines)) if lines[i].partition(b":")[0].strip().lower() == b"content-length"]
                size = _length(lines[named[-1]].partition(b":")[2].strip().decode("latin-1")) if named else -1
                places = [starts[i] + lines[i].find(_LINE) for i in range(low, named[-1]) if _LINE in lines[i]] if size >= 0 else []
                end = base + stop + len(_BREAK) + size
                yield from ((x, end) for x in dict.fromkeys(places[:1] + places[-1:]))
            # the line break may also begin the next header's empty line
            base += stop + 2
            del held[: stop + 2]
            looked = 2
        looked = max(0, len(held) - len(_BREAK) + 1)
        if len(held) > 2 * MOST_HEADER:
            base += len(held) - MOST_HEADER
            del held[: len(held) - MOST_HEADER]
            looked = max(0, len(held) - len(_BREAK) + 1)


def _headers(raw: bytes) -> dict[str, str] | str:
    """Header lines behind the version line, or what is wrong with them."""
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out if _length(out.get("content-length", "")) >= 0 else "bad length"


def parse(cursor: _Cursor, with_payload: bool = True, left: Callable[[int], str] | None = None) -> Found | str:
    """The record at a cursor, or what is wrong there; ``left`` tells by its length whether the block can be whole.

    The block is hashed as it is read; only a payload that is asked for is held.
    """
    start = cursor.at
    if cursor.fill(len(_LINE)) < len(_LINE) or not cursor.held.startswith(_LINE):
        return "no version line"
    raw = cursor.until(_BREAK, MOST_HEADER)
    if raw is None:
        return "header not closed"
    headers = _headers(raw)
    if isinstance(headers, str):
        return headers
    size = int(headers["content-length"])
    if left and (why := left(cursor.at + size)):
        return why
    block, payload = hashlib.sha256(), hashlib.sha256()
    head, tail, kept, inside, n = b"", b"", [], False, 0
    rest = size
    while rest and (part := cursor.take(min(rest, BLOCK))):
        rest -= len(part)
        block.update(part)
        if not inside:
            text = tail + part
            place = text.find(_BREAK)
            if place < 0:
                if len(head) < MOST_HEAD:
                    head += part
                tail = text[1 - len(_BREAK) :]
                continue
            inside = True
            head = (head + part)[: len(head) - len(tail) + place]
            part = text[place + len(_BREAK) :]
        payload.update(part)
        n += len(part)
        if with_payload:
            kept.append(part)
    if rest or cursor.fill(len(_BREAK)) < len(_BREAK) or not cursor.held.startswith(_BREAK):
        return "block doesn't end where its length says"
    cursor.take(len(_BREAK))
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and block.hexdigest() != want[7:]:
        return "block digest differs"
    if headers.get("warc-type") == "revisit":
        found = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n = max(0, _length(found[0].decode("latin-1"))) if found else 0
    elif headers.get("warc-payload-digest", "").startswith("sha256:") and payload.hexdigest() != headers["warc-payload-digest"][7:]:
        return "payload digest differs"
    return Found(headers, b"".join(kept) if with_payload else None, n, start, cursor.at)


def _member_end(archive: Archive, at: int) -> int:
    """End of the gzip member at a position, -1 if it isn't whole and valid."""
    source = _Inflated(archive, at)
    try:
        while source.more():
            pass
    except zlib.error:
        return -1
    return source.end


def _possible(archive: Archive, at: int) -> list[int]:
    """Places in a member's content where a record may begin whose block ends as its length says; two passes, whatever the content."""
    found = sorted(((end, place) for place, end in version_lines(_Inflated(archive, at), 0)))
    cursor, out = _Cursor(_Inflated(archive, at)), []
    for end, place in found:
        cursor.skip_to(end)
        if cursor.fill(len(_BREAK)) >= len(_BREAK) and cursor.held.startswith(_BREAK):
            out.append(place)
    return sorted(out)


def _inside(archive: Archive, at: int, end: int, with_payload: bool) -> Iterator[Found | Gap]:
    """Records of a valid member, salvaged at its version lines; a gap for all that is wrong inside.

    Positions inside a member have no byte of the archive: its bytes are the places of its
    records and its gap. After a failed check the places where records may begin are
    looked up once; content is inflated anew only to go back to one of them.
    """
    cursor, why, any_bytes, ahead = _Cursor(_Inflated(archive, at)), "", False, None
    while cursor.fill(1):
        any_bytes, place = True, cursor.at
        got = parse(cursor, with_payload)
        if not isinstance(got, str):
            got.start, got.end = at, end
            yield got
            continue
        why = why or got
        ahead = _possible(archive, at) if ahead is None else ahead
        i = bisect_right(ahead, place)
        if i == len(ahead):
            break
        if ahead[i] < cursor.at:
            cursor = _Cursor(_Inflated(archive, at))
        cursor.skip_to(ahead[i])
    if why or not any_bytes:
        yield Gap(at, end, why or "member without content")


def scan(archive: Archive, with_payload: bool = True) -> Iterator[Found | Gap]:
    """All valid records of an archive and the gaps between, in order.

    Every position is read by the bytes found there: a gzip member or a version line,
    also mixed. After a failed check the nearest valid one of either kind goes on. A
    member is inflated once to check it and once to read it, so of either no more than a
    block is held, besides the header and payload of one record.
    """
    member_at, line_at, lines = -1, -1, None

    def whole(p: int) -> tuple[Iterator[Found | Gap], int, str]:
        """Records at a position and their end, -1 if nothing there is valid."""
        if archive.exactly(p, 2) == _MEMBER[:2]:
            end = _member_end(archive, p)
            return (_inside(archive, p, end, with_payload), end, "") if end >= 0 else (iter(()), -1, "member fails its check")
        cursor = _Cursor(_Plain(archive, p))

        def left(to: int) -> str:
            return "" if archive.exactly(p + to, len(_BREAK)) == _BREAK else "block doesn't end where its length says"

        got = parse(cursor, with_payload, left)
        if isinstance(got, str):
            return iter(()), -1, got
        got.start, got.end = p, p + cursor.at
        return iter((got,)), got.end, ""

    def following(p: int) -> int:
        """Nearest place behind a position that looks like a member or a record."""
        nonlocal member_at, line_at, lines
        if member_at <= p:
            member_at = archive.find(_MEMBER, p + 1)
        if lines is None:
            lines = version_lines(_Plain(archive, p + 1), p + 1)
        while line_at <= p:
            line_at = next(lines, (archive.size, 0))[0]
        return min(member_at, line_at)

    at = 0
    while at < archive.size:
        records, end, why = whole(at)
        if end < 0:
            place, found = at, None
            while found is None and (place := following(place)) < archive.size:
                records, end, _ = whole(place)
                found = next((r for r in records if isinstance(r, Found)), None) if end >= 0 else None
            yield Gap(at, place, why)
            at = place
            if found is None:
                continue
            yield found
        yield from records
        at = end


def salvage(data: bytes, with_payload: bool = True) -> tuple[list[Found], list[Gap]]:
    """Records and gaps of an archive in memory."""
    got = list(scan(Archive(io.BytesIO(data), len(data)), with_payload))
    return [r for r in got if isinstance(r, Found)], [g for g in got if isinstance(g, Gap)]


_MANIFEST = "path string, records long, bytes long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes (page_id, url, payload binary, digest, refers_to) rows as archives; returns their manifest, not yet run.

    Every attempt of a task writes files of its own; only those of manifest rows that
    are kept belong to the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        rows: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                raw = member(record(page_id, url, payload, digest, refers), level)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= roll_bytes:
                    out.close()
                    rows.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            rows.append((f"{folder}/{name}", records, size))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["path", "records", "bytes"])

    return pages.mapInArrow(run, _MANIFEST)


_READ = "path string, start long, end long, gap_reason string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(manifest: DataFrame, *, with_payload: bool = True, complete: bool = False) -> DataFrame:
    """Records and gaps of the archives whose paths ``manifest`` lists.

    A record has its place, type, page_id, url, payload (null without
    ``with_payload``), payload_bytes, payload_digest and refers_to; a gap has its place
    and gap_reason, all else null. With ``complete`` an archive that doesn't give as many
    records as ``manifest`` says is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _filesystem(path)
                found: list[Found] = []
                gaps: list[Gap] = []
                number, held, lost = 0, 0, ""
                with system.open_input_file(name) as f:
                    for r in scan(Archive(f, f.size()), with_payload):
                        if isinstance(r, Gap):
                            gaps.append(r)
                            lost = lost or r.reason
                        else:
                            found.append(r)
                            number += 1
                            held += len(r.payload or b"")
                        if len(found) + len(gaps) >= 500 or held >= BATCH_BYTES:
                            yield _rows(path, found, gaps, with_payload)
                            found, gaps, held = [], [], 0
                if complete and number != records:
                    raise ValueError(f"{path}: {number} of {records} records read" + (f", a gap: {lost}" if lost else ""))
                yield _rows(path, found, gaps, with_payload)

    return manifest.select("path", F.col("records") if complete else F.lit(None).cast("long").alias("records")).mapInArrow(run, _READ)


def _number(text: str | None) -> int | None:
    """The 64-bit number that a header has; None if it has none."""
    plain = text is not None and len(text) <= 20 and text.isascii() and text.removeprefix("-").isdigit()
    return n if plain and -(1 << 63) <= (n := int(text)) < 1 << 63 else None


def _rows(path: str, found: list[Found], gaps: list[Gap], with_payload: bool) -> pa.RecordBatch:
    h = [f.headers for f in found]
    blank = [None] * len(gaps)
    digest = [x.get("warc-payload-digest", "").partition(":")[2] or None for x in h]
    columns = [
        ([path] * (len(found) + len(gaps)), pa.string()),
        ([f.start for f in found] + [g.start for g in gaps], pa.int64()),
        ([f.end for f in found] + [g.end for g in gaps], pa.int64()),
        ([None] * len(found) + [g.reason for g in gaps], pa.string()),
        ([x.get("warc-type") for x in h] + blank, pa.string()),
        ([_number(x.get("x-page-id")) for x in h] + blank, pa.int64()),
        ([x.get("warc-target-uri") for x in h] + blank, pa.string()),
        ([f.payload if with_payload and f.headers.get("warc-type") != "revisit" else None for f in found] + blank, pa.binary()),
        ([f.payload_bytes for f in found] + blank, pa.int64()),
        (digest + blank, pa.string()),
        ([_number(x.get("x-refers-to-page-id")) for x in h] + blank, pa.int64()),
    ]
    names = [c.split()[0] for c in _READ.split(", ")]
    return pa.record_batch([pa.array(v, t) for v, t in columns], names=names)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least ``least`` bytes the smallest page_id is referred to.

    Digests meet in narrow rows: payloads move once, dealt by page. A page without id is
    never a revisit and never referred to.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    revisits = narrow.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    folder: str | None = None,
    roll_bytes: int = ROLL_BYTES,
    with_payload: bool = True,
    complete: bool = False,
) -> DataFrame:
    """Writes pages as WARC archives and reads them back; see ``read_archives`` for the rows.

    The payload is the html in UTF-8, empty if null; null URLs and ids are left out of
    their record's header. Repeated rows are records of their own. An empty table gives
    no archive and an empty result; extra columns are not stored. Archives are in
    ``folder``, a path the whole cluster sees, or in the shared folder.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = with_revisits(pages, id_col, url_col, html_col)
    manifest = scratch.keep(write_archives(rows, folder or scratch.path("archives"), roll_bytes=roll_bytes), "manifest")
    # archives are of one size: each may be a task
    spread = manifest.repartition(max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("path"))
    return read_archives(spread, with_payload=with_payload, complete=complete)
