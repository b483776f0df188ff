"""WARC writer and salvage reader.

The reader takes byte ranges of WARC files (plain, or gzip members of one or more records), so that large
files are read in parallel. At each place it checks a record: gzip member and its CRC, version
line, header block (folded lines too), Content-Length, the two line ends after the block, and the WARC-Block-Digest if
given (sha1, sha256, sha512 or md5, in hex or base32). After a failed check it searches for the next place where a member or a version line
begins and passes the checks, goes on there, and logs the bytes between as a quarantined gap. A
range owns the records and gaps that begin in it; a record may run past its end. Each range reports where it began and where its last record ended;
a range that did not begin where the ones before it ended (within a record that holds WARC records itself, or after rubbish on the border)
is read again from there. So the rows don't depend on the size of the ranges.

Rows: kind 'record' (uri, payload, offset, size) or 'gap' (offset, size, reason). For records in a gzip member `inner` is the place
in its content; the first one has the member's stored size, the others 0. A gap inside a member has `inner` and its size in the content.

Defined results: an empty file gives no row; a file of rubbish is one gap; a record cut off by the
end of the file is a gap up to there; trailing padding of zero bytes or white space is a gap as
well; records without a target URI have uri null; repeated records are each given, ties cannot occur; payloads of any length are read whole; a payload
that is not UTF-8 is given as bytes; a digest of another algorithm cannot be checked: the record is given, with that as its reason. A null html is written as an empty payload and
a null url without a target URI; a null page_id comes back as null. Extra columns of pages are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosec.llm.shared import new_path, stash, worker_fs

RANGE_BYTES = 8 << 20
_WINDOW = 1 << 20
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_GZIP = b"\x1f\x8b\x08"
ROW = "kind string, path string, begin long, offset long, size long, inner long, record_id string, uri string, payload binary, reason string"
_DIGESTS = ("sha1", "sha256", "sha512", "md5")


def record(record_id: str, uri: str | None, payload: bytes) -> bytes:
    """One response-like WARC record, plain."""
    digest = hashlib.sha1(payload).hexdigest()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] * (uri is not None) + [f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Source:
    """Random access to a file with one window kept."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buf = f, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.buf)):
            self.f.seek(at)
            self.at, self.buf = at, self.f.read(min(max(n, _WINDOW), self.size - at))
        return self.buf[at - self.at : at - self.at + n]


def _same_digest(algorithm: str, want: str, block: bytes) -> bool:
    got = hashlib.new(algorithm, block).digest()
    try:
        if len(want) == 2 * len(got):
            return bytes.fromhex(want) == got
        return base64.b32decode(want.upper() + "=" * (-len(want) % 8)) == got
    except (ValueError, binascii.Error):
        return False


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record at a place of raw; or what is wrong with it."""
    m = _VERSION.match(raw, at)
    if not m:
        return "no version line"
    end = _HEAD_END.search(raw, m.end() - 1)
    if not end:
        return "header not ended"
    head: dict[str, str] = {}
    last = None
    for line in raw[m.end() : end.start()].splitlines():
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            head[last] += " " + text.strip()
            continue
        k, colon, v = text.partition(":")
        if not colon or not k.strip():
            return "bad header line"
        last = k.strip().lower()
        head[last] = v.strip()
    n = head.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        return "no length"
    block = raw[end.end() : end.end() + int(n)]
    if len(block) < int(n):
        return "block cut off"
    tail = raw[end.end() + int(n) : end.end() + int(n) + 4]
    stop = 4 if tail == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0
    if not stop:
        return "no end of record"
    algorithm, _, want = head.get("warc-block-digest", "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm in _DIGESTS and not _same_digest(algorithm, want.strip(), block):
        return "digest differs"
    if algorithm and algorithm not in _DIGESTS:
        head["unchecked"] = f"digest not checked: {algorithm}"
    return head, block, end.end() + int(n) + stop


def _content(raw: bytes, first: tuple[dict, bytes, int]):
    """(place, headers, block, None) of the records of a member's content, and (place, size, None, reason) of what is between; the first one is parsed."""
    at, got = 0, first
    while True:
        if not isinstance(got, str):
            yield at, got[0], got[1], None
            to = got[2]
        else:
            to = at + 1
            while True:
                m = _VERSION.search(raw, to)
                to = m.start() if m else len(raw)
                if not m or not isinstance(parse(raw, to), str):
                    break
                to += 1
            yield at, to - at, None, got
        if to >= len(raw):
            return
        at, got = to, parse(raw, to)


def check_at(src: Source, at: int) -> tuple[list, int] | str:
    """Records (and gaps between them) and stored size of the record or member at a place of the file; or why there is none."""
    lead = src.read(at, 8)
    if lead.startswith(_GZIP):
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                piece = src.read(pos, 1 << 16)
                if not piece:
                    return "member cut off"
                out.append(z.decompress(piece))
                pos += len(piece)
                if pos == at + len(piece) and not (got := b"".join(out)).startswith(b"WARC/"[: len(got)]):
                    return "no version line"
        except zlib.error:
            return "member damaged"
        got = parse(raw := b"".join(out))
        return got if isinstance(got, str) else (list(_content(raw, got)), pos - len(z.unused_data) - at)
    if lead.startswith(b"WARC/"):
        n = 1 << 16
        while True:
            raw = src.read(at, n)
            got = parse(raw)
            if not isinstance(got, str):
                return [(None, got[0], got[1], None)], got[2]
            if got not in ("header not ended", "block cut off", "no end of record") or at + n >= src.size:
                return got
            m = re.search(rb"(?i)content-length:\s*(\d+)", raw)
            need = int(m[1]) + (m.end() + (1 << 16) if m else 0) if m else n * 2
            if got != "header not ended" and need <= n:
                return got
            n = max(need, n + 1) if got != "header not ended" else n * 2
    return "neither member nor version line"


def next_start(src: Source, at: int) -> int:
    """The next place where a member or a version line may begin; the end of the file if none."""
    while at < src.size:
        part = src.read(at, _WINDOW)
        line = _VERSION.search(part)
        found = [i for i in (part.find(_GZIP), line.start() if line else -1) if i >= 0]
        if found:
            return at + min(found)
        if at + len(part) >= src.size:
            return src.size
        at += len(part) - 16
    return src.size


def salvage(src: Source, begin: int, end: int, start: int | None = None):
    """Records and gaps that begin in [begin, end), as dictionaries, then a row of kind 'range': where the first begins and where the last ends.

    start: where the ranges before end; None takes the first place of the range that checks.
    """
    none = dict(inner=None, record_id=None, uri=None, payload=None, reason=None)
    at = begin if start is None else start
    if begin and start is None:
        at = next_start(src, begin)
        while at < end and isinstance(check_at(src, at), str):
            at = next_start(src, at + 1)
    first, end = at, min(end, src.size)
    while at < end:
        got = check_at(src, at)
        if not isinstance(got, str):
            for k, (inner, head, block, reason) in enumerate(got[0]):
                if block is None:
                    yield none | dict(kind="gap", offset=at, size=head, inner=inner, reason=reason)
                    continue
                rid = re.sub(r"^<urn:|>$", "", head.get("warc-record-id", "")) or None
                yield none | dict(kind="record", offset=at, size=0 if k else got[1], inner=inner, record_id=rid, uri=head.get("warc-target-uri"), payload=block, reason=head.get("unchecked"))
            at += got[1]
            continue
        to = next_start(src, at + 1)
        while to < src.size and isinstance(check_at(src, to), str):
            to = next_start(src, to + 1)
        yield none | dict(kind="gap", offset=at, size=to - at, reason=got)
        at = to
    yield none | dict(kind="range", offset=first, size=at - first)


_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _read_ranges(pdfs):
    for pdf in pdfs:
        for x in pdf.itertuples():
            fs, bare = worker_fs(x.path)
            rows, size = [], 0
            with fs.open_input_file(bare) as f:
                for row in salvage(Source(f, x.length), x.begin, min(x.begin + x.span, x.length), None if pd.isna(x.start) else int(x.start)):
                    rows.append(row | {"path": x.path, "begin": x.begin})
                    size += len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pd.DataFrame(rows)[_COLUMNS]
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows)[_COLUMNS]


def _scan(ranges: DataFrame) -> DataFrame:
    n = max(1, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stash(ranges.repartition(n, "path", "begin").mapInPandas(_read_ranges, ROW), "salvaged")


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Salvage every .warc or .warc.gz file of a folder: (kind, file, offset, size, inner, record_id, uri, payload, reason)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin")).withColumn("span", F.lit(range_bytes).cast("long"))
    out = _scan(ranges.withColumn("start", F.lit(None).cast("long")))
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    while True:  # each round settles at least the first wrong range of a file
        seen = out.where("kind = 'range'").select("path", "begin", "offset", F.max(F.when(F.col("size") > 0, F.col("offset") + F.col("size"))).over(before).alias("ended"), "size")
        # a range whose bytes are all taken must have no rows; any other begins where those before it end
        wrong = seen.where("begin > 0").withColumn("ended", F.greatest("begin", F.coalesce("ended", F.lit(0).cast("long"))))
        wrong = wrong.join(ranges, ["path", "begin"])
        last = F.least(F.col("begin") + F.col("span"), F.col("length"))
        wrong = stash(wrong.where(F.when(F.col("ended") >= last, F.col("size") > 0).otherwise(F.col("offset") != F.col("ended"))).select("path", "begin", "length", "span", F.col("ended").alias("start")), "ranges")
        if wrong.isEmpty():
            break
        out = out.join(wrong.select("path", "begin"), ["path", "begin"], "left_anti").select(*out.columns).unionByName(_scan(wrong))
    return out.where("kind <> 'range'").select("kind", F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "offset", "size", "inner", "record_id", "uri", "payload", "reason")


def _write(path: str, damage):
    def run(batches):
        import uuid

        fs, bare = worker_fs(path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with fs.open_output_stream(f"{bare}/{name}", compression=None) as out:
            for b in batches:
                for pid, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    raw = member(record("none" if pid is None else str(pid), url, (html or "").encode()))
                    out.write(damage(pid, raw) if damage else raw)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    return run


def write_warc(pages: DataFrame, path: str, damage=None) -> None:
    """One .warc.gz of a gzip member a record from each partition; only the files that a finished task names count.

    A task that is run again writes a file of another name, and what the lost one left is removed.
    """
    spark = pages.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    use = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    done = {r["name"] for r in use.mapInArrow(_write(path, damage), "name string, n long").collect()}  # a row a task
    for s in fs.listStatus(p):
        if s.getPath().getName() not in done:
            fs.delete(s.getPath(), False)


def harm(page_id: str | None, raw: bytes) -> bytes:
    """Deterministic damage for tests and the query: 1 in 50 members is cut, hit or followed by rubbish."""
    kind = int(hashlib.md5(str(page_id).encode()).hexdigest()[:8], 16) % 150
    if kind == 0:
        return raw[: len(raw) // 2]
    if kind == 1:
        i = len(raw) // 3
        return raw[:i] + bytes(255 - x for x in raw[i : i + 8]) + raw[i + 8 :]
    if kind == 2:
        return raw + b"\x1f\x8b\x08WARC/1.0 rubbish" * 20
    return raw


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as damaged WARC files and salvage them: (page_id, url, html) of recovered records, and gaps by reason."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, harm)
    got = read_warc(pages.sparkSession, path)
    return got.select("kind", F.col("record_id").try_cast("long").alias("page_id"), F.col("uri").alias("url"), F.col("payload").cast("string").alias("html"), F.when(F.col("kind") == "gap", F.col("size")).alias("gap_bytes"), "reason", "file", "offset")
