"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

The writer makes one gzip stream of a whole archive, as many crawlers do. The normaliser inflates such a
stream once, front to back, writes every record again as a gzip member of its own and puts a sidecar index
(offset, length, type, record id: a line each) beside the archive. It gives back the byte range in the index of
each run of records, so a reader fetches its own lines of the index and then any record by its offset.

Records with equal payloads of at least MIN_REVISIT bytes are stored once: the one with the largest page_id
is a response, the others are revisits that refer to it (identical-payload-digest profile).

Defined cases: null html is an empty payload; a null url leaves the target out; a null page_id is kept, and
refers to the largest page_id that isn't null, if there is one. Rows that repeat a page_id and its payload
are all responses if that page_id is the largest. An empty table gives no archive rows. Files appear under
their names only when complete, so a task that is run again replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, open_files, remove_tree
from .encoding import small_batches

MIN_REVISIT = 1000
GZIP_LEVEL = 1
PIECE = 1 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, bytes long"
#: A row per run of records of an archive: how many, and where their lines stand in its index.
RUNS = "archive string, records long, index_from long, index_to long"
RUN_RECORDS = 2000
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, payload binary"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str) -> int | None:
    number = urn.split(":")[2]
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        plain = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            head.append(f"X-Target-Exact: {base64.b64encode(url.encode()).decode()}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(raw: bytes, name: bytes) -> str:
    """The value of a header of a record, by its exact name."""
    top = raw[: raw.find(b"\r\n\r\n") + 2]
    at = top.index(b"\r\n" + name + b": ") + len(name) + 4
    return top[at : top.index(b"\r\n", at)].decode()


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), block and payload of one record; the payload's digest is verified."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
    url = head.get("warc-target-uri")
    if "x-target-exact" in head:
        url = base64.b64decode(head["x-target-exact"]).decode()
    return {"page_id": _page_of(head["warc-record-id"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None, "payload": payload if kind == "response" else None}


class _Target:
    """A file that gets its name when it is complete."""

    def __init__(self, path: str):
        from pyspark import TaskContext

        self.fs, self.path = open_files(path)
        self.part = f"{self.path}.attempt-{TaskContext.get().taskAttemptId()}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def _manifest(path: str, records: int, size: int):
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        target, gz, n = None, None, 0
        for batch in small_batches(batches, "payload"):
            if target is None:
                target, gz = _Target(path), zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
            for page_id, url, payload, digest, revisit, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "revisit", "refers_to"))):
                target.write(gz.compress(build_record(page_id, url, payload, digest, refers, revisit)))
                n += 1
        if target:
            target.write(gz.flush())
            target.close()
            yield _manifest(path, n, target.size)

    return run


def split_records(pieces):
    """Whole records from the pieces of an inflated archive; holds one record and one piece at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            size = next(int(x.partition(b":")[2]) for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            stop = end + 4 + size + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream):
    """The content of a gzip stream of one member or many, in pieces."""
    d = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if out := d.decompress(data, PIECE * 4):
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data = d.unused_data
                d = zlib.decompressobj(31)
    if out := d.flush():
        yield out


def _runs(path: str, ends: list[int], step: int):
    """ends: for each record where its line in the index ends."""
    firsts = range(0, len(ends), step)
    lasts = [min(k + step, len(ends)) for k in firsts]
    begins = [ends[k - 1] if k else 0 for k in firsts]
    columns = [pa.array([path] * len(lasts), pa.string()), pa.array([b - a for a, b in zip(firsts, lasts)], pa.int64()), pa.array(begins, pa.int64()), pa.array([ends[b - 1] for b in lasts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "records", "index_from", "index_to"])


def _normalise(folder: str, step: int):
    def run(batches):
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = source.rpartition("/")[2]
                target, index, ends = _Target(f"{folder}/{name}"), _Target(f"{folder}/{name}.idx"), array("q")
                fs, path = open_files(source)
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in split_records(inflate(stream)):
                        gz = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        index.write(f"{target.size} {len(member)} {header(raw, b'WARC-Type')} {header(raw, b'WARC-Record-ID')}\n".encode())
                        target.write(member)
                        ends.append(index.size)
                target.close()
                index.close()
                yield _runs(f"{folder}/{name}", ends, step)

    return run


def _read(with_payload: bool):
    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for archive, begin, end in zip(*(batch.column(c).to_pylist() for c in ("archive", "index_from", "index_to"))):
                fs, path = open_files(archive)
                with fs.open_input_file(f"{path}.idx") as f:
                    f.seek(begin)
                    places = [tuple(map(int, x.split()[:2])) for x in f.read(end - begin).decode().splitlines()]
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for offset, size in places:
                        f.seek(offset)
                        r = parse_record(zlib.decompress(f.read(size), 31)) | {"archive": archive, "offset": offset}
                        held += len(r["payload"] or b"") if with_payload else 200
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        if held > 4_000_000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes monolithic archives below folder; a row per archive."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    keys = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= MIN_REVISIT)
    leaders = keys.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1 AND leader IS NOT NULL").select("digest", "leader")
    refers = keys.select("page_id", "digest").join(leaders, "digest").where(~F.col("page_id").eqNullSafe(F.col("leader"))).distinct()
    refers = refers.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("leader").alias("refers_to"), F.lit(True).alias("revisit"))
    joined = rows.join(refers, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    joined = joined.select("page_id", "url", "payload", "digest", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")
    # An archive per partition: where few pages are revisits, pages stay where they were read.
    ordered = joined.sortWithinPartitions("page_id", "digest", "url")
    return cut(ordered.mapInArrow(_write(folder), MANIFEST), "warc-written")


def normalise_archives(manifest: DataFrame, folder: str, step: int = RUN_RECORDS) -> DataFrame:
    """Rewrites each archive of manifest below folder with a member per record and an index beside it; a row per run of step records."""
    n = max(1, manifest.count())
    return cut(manifest.repartition(n, "archive").mapInArrow(_normalise(folder, step), RUNS), "warc-normalised")


def read_archives(runs: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of normalised archives, read by offset run by run."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "archive", "index_from").mapInArrow(_read(with_payload), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    folder = fresh_path(spark, "warc")
    written = write_archives(pages, f"{folder}/whole")
    normal = normalise_archives(written, f"{folder}/records")
    remove_tree(spark, f"{folder}/whole")
    return read_archives(normal, with_payload)


ORACLE = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
m AS (SELECT d, max(page_id) AS leader FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
