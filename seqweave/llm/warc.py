"""Deterministic sharded WARC writer and reader.

Records are dealt to shards of consecutive page ids (cut where the payload bytes of ranges of ids reach the shard size), one
partition each, range-sorted inside each shard, and streamed to gzip files, one member per record, that roll at a compressed size. Headers
and digests are made anew from the payload. Files are written under a temporary name and renamed; the manifest table, one
row per file, is the commit: a file that no manifest row names does not exist for readers, so lost or repeated tasks leave
no trace. The same input gives the same bytes, whatever the cluster.

Payloads of at least min_revisit bytes that are equal share one response record, that of the largest page_id; the others
become revisit records. Streaming keeps an Arrow batch of records in memory.

Defined results: null html is an empty payload; a null url is empty; a null page_id sorts first and never stands for
others unless all are null; rows that repeat a page_id and payload are records of their own, all responses if theirs is
the largest page_id; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import runtime

#: Ranges of page ids that hold about as many pages each; 257 numbers reach the driver.
RANGES = 256
MANIFEST = "path string, shard bigint, number int, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text or "")


def member(header: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One gzip member that holds one record; no clock enters it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*header, ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))])]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def page_record(page_id, url: str, payload: bytes, refers_to, date: str, level: int) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    header = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", base32(digest)), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        header += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return member(header, http + payload if refers_to is None else http, level)


class RollingFile:
    """Files of one shard under temporary names; each is renamed when full."""

    def __init__(self, root: str, shard: int, roll_bytes: int, date: str, level: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.roll, self.date, self.level = shard, roll_bytes, date, level
        self.number, self.out, self.done = 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.base}/pages-{self.shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.digest, self.bytes, self.records, self.first = hashlib.sha256(), 0, 0, page_id
            name = f"pages-{self.shard:08d}-{self.number:05d}.warc.gz"
            self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", hashlib.sha1(name.encode()).hexdigest())), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
        self.put(data)
        self.records += 1
        self.last = page_id
        if self.bytes >= self.roll:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.name).type != fs.FileType.NotFound:
            self.fs.delete_file(self.name)  # an earlier attempt at the same task wrote the same bytes
        self.fs.move(self.temporary, self.name)
        self.done.append((self.name, self.shard, self.number, self.records, self.bytes, self.digest.hexdigest(), self.first, self.last))
        self.number, self.out = self.number + 1, None


def revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that another page stands for."""
    meta = pages.select("page_id", "payload_bytes", "digest").where(F.col("payload_bytes") >= min_revisit)
    stands = meta.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n", "payload_bytes")
    out = meta.join(stands, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return out.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, root: str | None = None, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, min_revisit: int = 1000, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below root; the manifest, once committed."""
    spark = pages.sparkSession
    root = root or f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    meta = runtime.materialize(p.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest")), "warc-meta")
    total, bounds = meta.agg(F.sum("payload_bytes"), F.percentile_approx("page_id", [k / RANGES for k in range(RANGES + 1)], 20 * RANGES)).first()
    # a bucket is a part of a range: ranges hold about as many pages each, whatever the ids, and their parts are equally wide
    bounds = sorted({float(x) for x in bounds or [0]})
    parts = max(8, -(-8 * (total or 0) // shard_bytes // RANGES))
    edges = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # one literal once it is folded

    def bucket(c):
        x = c.cast("double")
        number = F.greatest(F.lit(1), F.least(F.lit(max(1, len(bounds) - 1)), F.size(F.filter(edges, lambda b: b <= x))))

        def part(k):
            a, z = F.get(edges, k - 1), F.coalesce(F.get(edges, k), F.get(edges, k - 1))
            of = F.when(z > a, F.floor((x - a) / (z - a) * parts)).otherwise(0)
            return k * (1 << 20) + F.greatest(F.lit(0), F.least(F.lit((1 << 20) - 1), of))

        return F.coalesce(runtime.let(number, part), F.lit(0)).cast("long")

    weighed = meta.groupBy(bucket(F.col("page_id")).alias("bucket")).agg((F.sum("payload_bytes") + 500 * F.count("*")).alias("w"))
    weighed = weighed.withColumn("range", F.shiftright("bucket", 20))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)  # the sums of ranges first, a row each, then of a range's parts
    ranges = weighed.groupBy("range").agg(F.sum("w").alias("_w")).select("range", F.coalesce(F.sum("_w").over(before.orderBy("range")), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.coalesce(F.sum("w").over(before.partitionBy("range").orderBy("bucket")), F.lit(0))
    shards = weighed.join(F.broadcast(ranges), "range").select("bucket", F.floor(place / shard_bytes).cast("int").alias("shard"))
    shards = runtime.materialize(shards, "warc-shards")
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    none = F.lit(None)
    records = p.select(bucket(F.col("page_id")).alias("bucket"), "page_id", F.lit(1).alias("kind"), F.sha1("payload").alias("digest"), none.cast("long").alias("refers_to"), "url", "payload")
    notes = revisits(meta, min_revisit).select(bucket(F.col("page_id")).alias("bucket"), "page_id", F.lit(0).alias("kind"), "digest", "refers_to", none.cast("string").alias("url"), none.cast("binary").alias("payload"))
    stream = records.union(notes).join(shards, "bucket").repartitionById(int(n_shards), F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")

    def written(batches):
        from pyarrow import fs

        f, base = fs.FileSystem.from_uri(root)
        f.create_dir(base, recursive=True)
        file, done, noted, noted_id = None, [], {}, object()
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "kind", "digest", "refers_to", "url", "payload")]
            for i in range(batch.num_rows):
                shard, page_id, kind, digest, refers_to, url, payload = (c[i].as_py() for c in columns)
                if file is None or file.shard != shard:
                    if file:
                        file.close()
                        done += file.done
                    file = RollingFile(root, shard, roll_bytes, date, level)
                if page_id != noted_id:
                    noted, noted_id = {}, page_id
                if kind == 0:
                    noted[digest] = refers_to
                else:
                    file.add(page_id, page_record(page_id, url, payload, noted.get(digest), date, level))
        if file:
            file.close()
            done += file.done
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    manifest = runtime.materialize(stream.mapInArrow(K.lean(written), MANIFEST), "warc-manifest")
    _commit(spark, root, manifest)
    return manifest.withColumn("root", F.lit(root))


def _commit(spark: SparkSession, root: str, manifest: DataFrame) -> None:
    """A short summary beside the files, under a temporary name first; the manifest table lists the files."""
    from pyarrow import fs

    n, records, size, mark = manifest.agg(F.count("*"), F.sum("records"), F.sum("bytes"), F.bit_xor(F.xxhash64("sha256", "shard", "number"))).first()
    f, base = fs.FileSystem.from_uri(root)
    f.create_dir(base, recursive=True)
    with f.open_output_stream(f"{base}/MANIFEST.tmp") as out:
        out.write(json.dumps({"files": n, "records": records or 0, "bytes": size or 0, "mark": mark or 0}).encode())
    f.move(f"{base}/MANIFEST.tmp", f"{base}/MANIFEST.json")


def records_of(data: bytes):
    """(header, block) of each record in a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("a gzip member is cut short")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        text = b"".join(parts)
        end = text.index(b"\r\n\r\n")
        header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in text[:end].decode().split("\r\n")[1:])
        n = int(header["Content-Length"])
        block = text[end + 4 : end + 4 + n]
        if len(block) != n or text[end + 4 + n :] != b"\r\n\r\n" or base32(hashlib.sha1(block).hexdigest()) != header["WARC-Block-Digest"]:
            raise ValueError("a record is damaged")
        yield header, block


def read(manifest: DataFrame) -> DataFrame:
    """Records of the archive that a manifest names, checked against their digests; payload facts are taken from the bytes."""

    def parsed(batches):
        from pyarrow import fs

        for batch in batches:
            for path, root, sha256 in zip(batch.column("path").to_pylist(), batch.column("root").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                f, _ = fs.FileSystem.from_uri(root)
                with f.open_input_stream(path, compression=None) as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{path} differs from its manifest")
                rows = []
                for header, block in records_of(data):
                    if header["WARC-Type"] == "warcinfo":
                        continue
                    page_id = int(header["X-Page-Id"]) if header["X-Page-Id"] else None
                    digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if header["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload differs from its digest")
                        n, refers_to = len(payload), None
                    else:
                        n, refers_to = int(header["X-Payload-Length"]), int(header["X-Refers-To-Page-Id"])
                    rows.append((page_id, header["WARC-Target-URI"], n, digest, header["WARC-Type"], refers_to))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    # a number of tasks by the number of files: by their few bytes of manifest, Spark would put all files in one
    files = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "root", "sha256").repartition(files, "path").mapInArrow(K.lean(parsed), RECORD)
