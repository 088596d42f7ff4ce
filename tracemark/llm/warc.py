"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block, whose second line names the header format of what follows: version 1 has five
fields, version 2 ten. Each record is one header line, the declared number of bytes, and a line end. The converter
splits the archive by these lengths, once, and writes WARC records with identifiers, timestamps, types and digests made
from what the ARC header says. What cannot be parsed is set aside, and parsing goes on at the next line that is a
header. Payloads are bytes of any kind. Files are packed in tasks up to a bounded size, and go through Spark's own
writers and readers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm.common import join_hot, materialise, scratch_path

# fixed values of the formats
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD_END = b"\r\n\r\n"
WARC_STARTS = (b"WARC/1.0", b"WARC/1.1", b"WARC/0.17", b"WARC/0.18")
BROADCAST_GROUPS = 500_000
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
FILE_BYTES = 32 << 20  # of an archive, before compression; a larger record has a file of its own
BATCH_BYTES = 8 << 20
SMALL = 1000


def _field(value) -> str:
    """A header field has no white space: what is not plain is percent-encoded; an absent one is a dash."""
    return quote(str(value), safe="!#$&'()*+,/:;=?@[]~-._") if value not in (None, "") else "-"


def _unfield(value: str | None):
    return None if value in (None, "-") else unquote(value)


class Source:
    """An archive's bytes, plain or compressed (as a whole or by record), read forwards; what was read can be put back."""

    def __init__(self, data: bytes):
        raw = io.BytesIO(data)
        self.file, self.held, self.at, self.broken = (gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw), b"", 0, None

    def _more(self, read, *n) -> bytes:
        try:
            return b"" if self.broken else read(*n)
        except (EOFError, OSError, zlib.error) as error:  # a cut or damaged archive ends here
            self.broken = f"damaged compression: {error}"
            return b""

    def read(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        while len(out) < n and (more := self._more(self.file.read, min(n - len(out), 1 << 20))):
            out += more
        self.at += len(out)
        return out

    def line(self) -> bytes:
        end = self.held.find(b"\n") + 1
        out, self.held = (self.held[:end], self.held[end:]) if end else (self.held + self._more(self.file.readline), b"")
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


def version_block(version: int, date: str = "19960101000000") -> bytes:
    body = f"{version} 0 Archive\n{' '.join(FIELDS[version])}\n".encode()
    fields = ["filedesc://archive.arc", "0.0.0.0", date, "text/plain"]
    fields += ["200", "-", "-", "0", "archive.arc"] if version == 2 else []
    return f"{' '.join(fields)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, payload: bytes, url=None, ip=None, date=None, mime=None, code=None, name=None) -> bytes:
    fields = [url, ip or "0.0.0.0", date or "19960101000000", mime or "text/html"]
    if version == 2:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        fields += [code or "200", digest, None, "0", name]
    return (" ".join(map(_field, fields)) + f" {len(payload)}\n").encode() + payload + b"\n"


def _header(line: bytes, version: int | None) -> list[str] | None:
    """The fields of a record's header line, or None; before the version is known any number of them will do."""
    fields = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
    fits = len(fields) == len(FIELDS[version]) if version else len(fields) in (5, 10)
    return fields if fits and fields[-1].isascii() and fields[-1].isdigit() and re.fullmatch(r"\d{4,17}|-", fields[2], re.A) else None


def intact(checksum: str | None, payload: bytes) -> bool | None:
    """Whether a payload has its declared checksum; None if none is declared or its form is not known."""
    given = (checksum or "").rpartition(":")[2]
    known = []
    if re.fullmatch("[A-Z2-7]{32}", given):
        known.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if re.fullmatch("[0-9a-fA-F]{40}", given):
        known.append(hashlib.sha1(payload).hexdigest())
    if re.fullmatch("[0-9a-fA-F]{32}", given):
        known.append(hashlib.md5(payload).hexdigest())
    return any(given.lower() == k.lower() for k in known) if known else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file's bytes by the declared lengths, in order. The version block is one too, of kind warcinfo;
    records of name lookups are of kind resource, others response. problem is null, "checksum differs" (the record is
    there as it is), or what stood in the way of a record: its payload are the bytes up to the next header line."""
    source, version = Source(data), None

    def record(at, kind, payload, problem=None, **of):
        return {"offset": at, "version": version, "kind": kind, "url": None, "ip": None, "date": None, "mime": None, "name": None, "payload": payload, "problem": problem} | of

    def skip(at, taken: bytes, problem):
        """The bytes from at up to the next header line."""
        while line := source.line():
            if _header(line, version):
                source.back(line)
                break
            taken += line
        return record(at, None, taken, problem)

    while line := source.line():
        at = source.at - len(line)
        if not line.strip():
            continue
        fields = _header(line, version)
        if not fields:
            yield skip(at, line, f"not a header line of version {version}" if version else "not a header line")
            continue
        size = int(fields[-1])
        body = source.read(size)
        if len(body) < size:
            source.back(body)
            yield skip(at, line, f"declares {size} bytes, there are {len(body)}")
            continue
        if version is None:
            number = body.split(b"\n", 1)[0].split(b" ")[0]
            if not fields[0].startswith("filedesc:") or number not in (b"1", b"2"):
                yield record(at, None, line + body, "an ARC file starts with a version block of version 1 or 2")
                return
            version = int(number)
            if len(fields) != len(FIELDS[version]) and len(fields) != len(FIELDS[1]):
                yield record(at, None, line + body, "the version block has other fields")
                continue
            yield record(at, "warcinfo", body, url=fields[0], ip=_unfield(fields[1]), date=_unfield(fields[2]), mime=_unfield(fields[3]))
        else:
            got = dict(zip(FIELDS[version], map(_unfield, fields), strict=True))
            problem = "checksum differs" if intact(got.get("Checksum"), body) is False else None
            yield record(at, "resource" if (got["URL"] or "").startswith("dns:") else "response", body, problem, url=got["URL"], ip=got["IP-address"],
                         date=got["Archive-date"], mime=got["Content-type"], name=got.get("Filename"))
        after = source.read(1)
        if after == b"\r":
            after += source.read(1)
        if after not in (b"\n", b"\r\n"):
            source.back(after)
    if source.broken:
        yield record(source.at, None, b"", source.broken)


def iso_date(date: str | None) -> str:
    """14 digits of an ARC date (fewer in old archives, missing ones are least) as a WARC timestamp; of none, or of no
    date at all, the first of 1970."""
    digits = re.sub(r"\D", "", date or "", flags=re.A)[:14]
    digits += "00000101000000"[len(digits):]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*of) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, of)))}"


def _write(rows: DataFrame, one, path: str, start: bytes, end: bytes, file_bytes: int) -> None:
    """Archives of rows, which one(row's values) makes bytes of: packed up to file_bytes, a file each, from start on;
    Spark's text writer puts the last end."""
    def run(batches):
        parts, size = [start], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-len(end)]], pa.binary())], ["value"])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = one(*row)
                if size and size + len(made) > file_bytes:
                    yield packed()
                    parts, size = [start], 0
                parts.append(made)
                size += len(made)
        if size:
            yield packed()

    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", end.decode()).option("maxRecordsPerFile", 1).options(**COMPRESSED).text(path)


def write_arc(pages: DataFrame, path: str, version: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """pages (page_id, url, html): ARC files. html is text or bytes, a null one an empty payload, a null url a dash; the
    page id is kept as Filename, which version 1 does not have."""
    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write(rows, lambda i, url, html: arc_record(version, html or b"", url, name=i), path, version_block(version), b"\n", file_bytes)


def _parsed(spark: SparkSession, path: str, parse, schema: str, pattern: str) -> DataFrame:
    """Rows that parse(path, bytes) gives of the files below path, in batches of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some, size = [], 0
                for row in parse(file, content.as_py()):
                    some.append({n: row.get(n) for n in names})
                    size += len(row["payload"])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(some, fields)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, offset, version, kind, url, ip, date, mime, name, problem, payload) of all records below path, as parse_arc
    gives them. An archive is one task's work, and up to 2 GB, as Spark reads files of bytes."""
    def parse(file, data):
        return ({"file": file, **r} for r in parse_arc(data))
    return _parsed(spark, path, parse, "file string, offset long, version int, kind string, url string, ip string, date string, mime string, name string, problem string, payload binary", pattern)


def plan_revisits(records: DataFrame, small: int = SMALL) -> DataFrame:
    """(same, size, to_file, to_offset, to_name) of payloads of `small` bytes at least that several responses have.

    The response is that with the largest name, as a number where it is one, then as text; then the last by file and
    offset. Payloads are equal if their SHA-256 and lengths are.
    """
    rank = F.struct(F.expr("try_cast(name AS bigint)").alias("number"), "name", "file", "offset")
    groups = records.filter((F.col("kind") == "response") & (F.col("size") >= small)).groupBy("same", "size").agg(F.max(rank).alias("to"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").select("same", "size", F.col("to.file").alias("to_file"), F.col("to.offset").alias("to_offset"), F.col("to.name").alias("to_name"))


def warc_record(file, offset, version, kind, url, ip, date, mime, name, payload, digest, to_file, to_offset, to_name) -> bytes:
    """One WARC record, with its closing lines; the place in the ARC file gives the identifiers."""
    revisit = to_file is not None and (to_file, to_offset) != (file, offset)
    body = b"" if revisit else payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else kind}", f"WARC-Record-ID: <{record_id(file, offset)}>", f"WARC-Date: {iso_date(date)}"]
    if kind != "warcinfo":
        head += [f"WARC-Target-URI: {_field(url)}", f"WARC-IP-Address: {_field(ip)}",
                 f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Payload-Length: {len(payload)}",
                 f"WARC-Source-Version: ARC/{version}", f"WARC-Source-Name: {_field(name)}"]
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(to_file, to_offset)}>", f"WARC-Refers-To-Name: {_field(to_name)}"]
    kind_of = "application/http; msgtype=response" if payload.startswith(b"HTTP/") else re.sub(r"[\r\n]+", " ", mime or "application/octet-stream")
    head += [f"Content-Type: {kind_of}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + RECORD_END


def convert(spark: SparkSession, arc_path: str, warc_path: str, small: int = SMALL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """ARC files to WARC files; returns what was set aside: (file, offset, problem, n_bytes). A record whose checksum
    differs is listed there and converted all the same. Each archive is parsed once. Runs when it is called."""
    parsed = read_arc(spark, arc_path).withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long"), "same": F.sha2("payload", 256)})
    parsed = materialise(parsed, "records")
    good = parsed.filter("kind is not null")
    groups = materialise(plan_revisits(good, small), "revisits")
    # payloads stay where they are as long as the groups are counted to be few
    few = groups.count() <= BROADCAST_GROUPS
    planned = good.join(F.broadcast(groups), ["same", "size"], "left") if few else join_hot(good, groups, ["same", "size"], "left")
    ours = F.col("kind") == "response"
    columns = ["file", "offset", "version", "kind", "url", "ip", "date", "mime", "name", "payload", "digest",
               *[F.when(ours, F.col(c)).alias(c) for c in ("to_file", "to_offset", "to_name")]]
    _write(planned.select(*columns), warc_record, warc_path, b"", RECORD_END, file_bytes)
    return parsed.filter("problem is not null").select("file", "offset", "problem", F.col("size").alias("n_bytes"))


def parse_warc(data: bytes) -> Iterator[tuple[dict | None, bytes]]:
    """(header, payload) of the records of a WARC file's bytes, plain or compressed, the names of the header's fields in
    lower case; (None, bytes) of what is no record up to the next one."""
    source = Source(data)

    def skip(taken: bytes):
        while line := source.line():
            if line.rstrip(b"\r\n") in WARC_STARTS:
                source.back(line)
                break
            taken += line
        return None, taken

    while line := source.line():
        if not line.strip():
            continue
        if line.rstrip(b"\r\n") not in WARC_STARTS:
            yield skip(line)
            continue
        head, seen, last = {}, line, None
        while (line := source.line()).strip():
            seen += line
            name, colon, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            if line[:1] in b" \t" and last:  # a folded line
                head[last] += " " + line.decode("utf-8", "replace").strip()
            elif colon:
                last = name.strip().lower()
                head[last] = value.strip()
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            yield skip(seen)
            continue
        body = source.read(int(size))
        if len(body) < int(size):
            source.back(body)
            yield skip(seen)
            continue
        yield head, body
    if source.broken:
        yield None, b""


def _digest(value: str | None) -> str | None:
    """The hex digits of a labelled SHA-1, base 32 or hex."""
    label, _, given = (value or "").rpartition(":")
    if label.lower() not in ("", "sha1"):
        return None
    if re.fullmatch("[A-Za-z2-7]{32}", given):
        return base64.b32decode(given.upper()).hex()
    return given.lower() if re.fullmatch("[0-9a-fA-F]{40}", given) else None


def read_warc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(record_id, record_type, name, refers_to, refers_to_name, date, url, declared_bytes, declared_digest, payload) of
    the records below path; the type of what is no record is null."""
    def parse(_, data):
        for head, body in parse_warc(data):
            h = head or {}
            length = h.get("warc-payload-length", "")
            yield {"record_id": h.get("warc-record-id", "").strip("<>") or None, "record_type": h.get("warc-type") if head is not None else None, "name": _unfield(h.get("warc-source-name")),
                   "refers_to": h.get("warc-refers-to", "").strip("<>") or None, "refers_to_name": _unfield(h.get("warc-refers-to-name")), "date": h.get("warc-date"),
                   "url": _unfield(h.get("warc-target-uri")), "declared_bytes": int(length) if length.isascii() and length.isdigit() else None,
                   "declared_digest": _digest(h.get("warc-payload-digest")), "payload": body}
    return _parsed(spark, path, parse, "record_id string, record_type string, name string, refers_to string, refers_to_name string, date string, url string, "
                   "declared_bytes long, declared_digest string, payload binary", pattern)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits below path, the
    bytes and digest of the full payload: measured on responses, and for revisits taken from the response that they
    refer to; where that is not found they are what the record declares. Page ids are the records' source names, null
    where those are no numbers. Each archive is parsed once, when this is called."""
    measured = materialise(read_warc(spark, path).filter("record_type in ('response', 'revisit')").select(
        "record_id", "record_type", "refers_to", F.expr("try_cast(name AS bigint)").alias("page_id"), F.expr("try_cast(refers_to_name AS bigint)").alias("to_page"),
        "declared_bytes", "declared_digest", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha")), "measured")
    own = measured.filter("record_type = 'response'")
    # only revisits are joined: the rows without a reference would all meet in one task
    again = measured.filter("record_type = 'revisit' and refers_to is not null").drop("bytes", "sha")
    asked = own.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("bytes").alias("bytes"), F.max("sha").alias("sha"))
    again = join_hot(again, asked, ["refers_to"], "left").unionByName(measured.filter("record_type = 'revisit' and refers_to is null").withColumns(
        {"bytes": F.lit(None).cast("long"), "sha": F.lit(None).cast("string")}))
    return own.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(
        "page_id", F.coalesce("bytes", "declared_bytes").alias("payload_bytes"), F.coalesce("sha", "declared_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to")))


def op9(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_pages(spark, warc)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (d, n)
"""
