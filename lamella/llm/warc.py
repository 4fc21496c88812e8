"""WARC files with a two-level capture index.

Records are written as gzip members into WARC files. Their captures are sorted
by reversed-host URL key into compressed blocks; each index part has a sparse
directory of its blocks, and a short table lists the parts. A look-up searches
the parts, then a directory, then reads and searches one block, and last reads
the record's bytes alone.

Files go through ``pyarrow.fs`` to the cluster's shared folder. A task writes
files under a name of its own and returns rows that name them; files of lost
or repeated tasks are named by no row and are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import BATCH_BYTES, materialise, parts_for, prepare, scratch_path
from lamella.llm.url_filter import host_of

#: Captures of a block; bytes after which a task begins another WARC file; most index parts.
BLOCK_LINES, FILE_BYTES, MOST_PARTS = 1000, 256 << 20, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:lamella:capture:"


class Record(NamedTuple):
    capture: str
    kind: str
    refers_to: str | None
    digest: str
    length: int
    payload: bytes


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the rest of the URL, so that captures of a site are neighbours."""
    host = host_of(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    plain = F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))
    return plain


def record_bytes(capture: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which has the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID_PREFIX}{quote(capture, safe='')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:lamella:no-url', safe=';/?:@&=+$,#%!*()[]~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{quote(refers_to, safe='')}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + gzip.flush()


def parse_record(member: bytes) -> Record:
    """A record from its gzip member; the payload of a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    name = lambda x: unquote(x.strip("<>").removeprefix(ID_PREFIX))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return Record(name(fields["WARC-Record-ID"]), kind, name(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, digest, length, payload)


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Ranges:
    """Range reads from files of a folder, with a few of them kept open."""

    def __init__(self, root: str, most: int = 32) -> None:
        self.store, self.base = _store(root)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    def read(self, name: str, offset: int | None = None, length: int | None = None) -> bytes:
        if name not in self.open:
            self.open[name] = self.store.open_input_file(f"{self.base}/{name}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(name)
        f = self.open[name]
        return f.read_at(f.size(), 0) if offset is None else f.read_at(length, offset)


def write_records(pages: DataFrame, root: str, date: str) -> DataFrame:
    """Write ``pages`` (capture, url, payload, digest, refers_to) and return their captures: key, capture, file, offset, length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                for r in batch.select(["capture", "url", "payload", "digest", "refers_to"]).to_pylist():
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = record_bytes(r["capture"], r["url"], r["payload"], r["digest"], r["refers_to"], date)
                    out.write(data)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                columns = [batch.column("key"), batch.column("capture"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "capture", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    _store(root)[0].create_dir(_store(root)[1], recursive=True)
    return pages.mapInArrow(run, "key string, capture string, file string, offset long, length long")


def build_index(captures: DataFrame, root: str, parts: int) -> DataFrame:
    """Write the captures' blocks and directories; returns a row per index part: first key and capture, and its name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        name, at, directory, held, first = uuid.uuid4().hex, 0, [], [], None
        with store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None) as out:

            def flush() -> None:
                nonlocal at
                data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
                out.write(data)
                directory.append((held[0][0], held[0][1], at, len(data)))
                at += len(data)
                held.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first = first or row[:2]
                    held.append(row)
                    if len(held) == BLOCK_LINES:
                        flush()
            if held:
                flush()
        if first:
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as out:
                out.write("\n".join(map(json.dumps, directory)).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*first, name)], ["key", "capture", "part"])

    ordered = captures.select("key", "capture", "file", "offset", "length").repartitionByRange(parts, "key", "capture").sortWithinPartitions("key", "capture")
    return ordered.mapInArrow(run, "key string, capture string, part string")


class Index:
    """Looks captures up: parts, then a part's block directory, then one block, each by binary search."""

    def __init__(self, root: str, parts: list[tuple[bytes, bytes, str]]) -> None:
        self.ranges = Ranges(root)
        self.firsts = [p[:2] for p in parts]
        self.names = [p[2] for p in parts]
        self.directories: OrderedDict[str, tuple[list, list]] = OrderedDict()
        self.blocks: OrderedDict[tuple, list] = OrderedDict()

    @staticmethod
    def _cached(cache: OrderedDict, key: object, make: Callable, most: int) -> object:
        if key not in cache:
            cache[key] = make()
            if len(cache) > most:
                cache.popitem(last=False)
        return cache[key]

    def _directory(self, part: str) -> tuple[list, list]:
        def load() -> tuple[list, list]:
            rows = [json.loads(x) for x in self.ranges.read(f"{part}.dir").split(b"\n")]
            return [(r[0].encode(), r[1].encode()) for r in rows], [tuple(r[2:]) for r in rows]

        return self._cached(self.directories, part, load, 8)

    def _block(self, part: str, offset: int, length: int) -> list:
        def load() -> list:
            rows = [json.loads(x) for x in zlib.decompress(self.ranges.read(f"{part}.cdx.gz", offset, length)).split(b"\n")]
            return [((r[0].encode(), r[1].encode()), tuple(r[2:])) for r in rows]

        return self._cached(self.blocks, (part, offset), load, 8)

    def find(self, key: str, capture: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every record of this capture; equal ones may go on into later blocks and parts."""
        want = (key.encode(), capture.encode())
        # Equal captures may begin in the part and block before the first that starts with them.
        p = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while p < len(self.names) and self.firsts[p] <= want:
            firsts, places = self._directory(self.names[p])
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(places) and firsts[b] <= want:
                rows = self._block(self.names[p], *places[b])
                i = bisect.bisect_left(rows, want, key=lambda r: r[0])
                while i < len(rows) and rows[i][0] == want:
                    yield rows[i][1]
                    i += 1
                b += 1
            p += 1


def by_bytes(records: Iterable[Record], most: int = BATCH_BYTES) -> Iterator[list[Record]]:
    """Runs of records; a run ends with the record that brings its payloads to ``most`` bytes."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r.payload)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_captures(requests: DataFrame, parts: DataFrame, root: str, tasks: int) -> DataFrame:
    """Records of the distinct ``requests`` (key, capture): capture, kind, refers_to, digest, length, payload.

    The table of parts has a row per index partition, MOST_PARTS at most; each
    task gets all of it and reads the directories and blocks that it needs.
    """
    table = sorted((r.key.encode(), r.capture.encode(), r.part) for r in parts.collect())
    held = requests.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, records = Index(root, held.value), Ranges(root)
        names = ["capture", "kind", "refers_to", "digest", "length", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            asked = zip(batch.column("key").to_pylist(), batch.column("capture").to_pylist(), strict=True)
            found = (parse_record(records.read(*place)) for key, capture in asked for place in index.find(key, capture))
            for some in by_bytes(found):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    # Dealt by key range, so that a task's look-ups are in few index blocks.
    dealt = requests.repartitionByRange(tasks, "key", "capture").sortWithinPartitions("key", "capture")
    return dealt.mapInArrow(run, "capture string, kind string, refers_to string, digest string, length long, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame, str]:
    """Write all pages; returns the captures (key, capture, file, offset, length), the index parts and the folder.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one
    with the largest id is a response and the others revisit it. A null html
    is an empty payload, a null URL has an empty key, a null id an empty
    capture name and is always a response. Rows with equal ids are separate
    records, judged by their own payloads.
    """
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = rows.filter(F.octet_length("payload") >= least_bytes).select("id", F.sha1("payload").alias("digest"))
    # Hot digests: the aggregation is partial before the shuffle, and only narrow rows meet in the join.
    owners = narrow.groupBy("digest").agg(F.max("id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    # By id and digest: rows that share an id can have different payloads.
    revisits = narrow.join(owners, "digest").filter("id <> owner").select(F.col("id").alias("of"), F.col("digest").alias("copy"), F.col("owner")).distinct()
    digested = rows.withColumn("digest", F.sha1("payload"))
    named = digested.join(revisits, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("copy")), "left").select(
        url_key(F.col("url")).alias("key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("capture"), "url", "payload",
        "digest", F.col("owner").cast("string").alias("refers_to"),
    )
    root = scratch_path(spark, "warc")
    captures = materialise(write_records(named, root, date), "warc-captures")
    parts = materialise(build_index(captures, root, parts_for(captures, 16 << 20, most=MOST_PARTS)), "warc-parts")
    return captures, parts, root


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, indexed, and read back through the index by their URLs and ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures, parts, root = archive(pages)
    asked = pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("capture")).distinct()
    back = read_captures(asked, parts, root, parts_for(pages, 8 << 20, least=8))
    return back.select(
        F.expr("try_cast(capture as bigint)").alias("page_id"),
        F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM q
"""
