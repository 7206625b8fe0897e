"""WARC archives: records with revisits, and a normaliser of monolithic gzip files.

``write_monolithic`` writes pages as WARC records, one gzip stream for a whole file, as many crawlers and text writers
leave them.  ``normalise`` inflates each such file once, as a stream, and rewrites every record as a gzip member of its
own, with a sidecar index of offsets beside it.  ``read`` splits the index over the cluster and fetches members by
their offsets, so that one record can be read without the rest of its archive.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response; the others are
revisits, without a block, that name it.  The payload digest is SHA-1 in base 32.

Archives lie in the shared folder of ``spark.checkpoint.dir``, or where ``folder`` says, and are reached through
Arrow's file systems.  Files are written under a name of the attempt and moved when complete: a lost executor's
work is done again and leaves no part of a file behind.  A task holds one record and one piece of a file at a time.

Defined cases: a null or empty payload is a record with an empty block; without a url the record has no target; equal
ids with equal payloads are one response and revisits of their own id; rows without an id are revisits of one that has
an id, and responses where none has; an empty table gives no archive and no rows.  Extra columns stay out of the
archives.  ``pages`` has to be a table that reads the same rows in the same order twice, as files do.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.llm.common import cut, ships, table, work_dir

ships(__name__)

LEAST = 0
PER_FILE = 4_000  # records of one archive
PIECE = 1 << 16
_URN = "urn:page:"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha: Column) -> Column:
    """Base 32 of 40 hex digits: five of them are twenty bits are four letters."""
    letters = []
    for k in range(0, 40, 5):
        number = F.conv(F.substring(sha, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def roles(pages: DataFrame, id: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to (null for responses)."""
    whole = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.drop("payload_bytes", "payload_digest", "refers_to").withColumns(
        {"payload_bytes": F.octet_length(whole).cast("long"), "_sha": F.sha1(whole.cast("binary")), "_row": F.monotonically_increasing_id()})
    # One row for each digest on the right, so a payload that very many pages share can be split at run time.
    first = rows.where(F.col("payload_bytes") >= least).groupBy("_sha").agg(F.max(F.struct(F.col(id).alias("id"), "_row")).alias("_first"), F.count("*").alias("_n"))
    rows = rows.join(first.where("_n > 1").drop("_n"), "_sha", "left")
    refers = F.when(F.col("_row") != F.col("_first._row"), F.col("_first.id"))
    return rows.withColumns({"refers_to": refers, "payload_digest": base32(F.col("_sha"))}).drop("_first", "_sha", "_row")


def record(id: str = "page_id", url: str = "url", payload: str = "html") -> Column:
    """A row of ``roles`` as the text of a WARC record, without the two line ends behind it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(id).cast("string"), none), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\r\n]", "")), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))), none),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(none),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"))
    return F.concat(head, F.when(revisit, none).otherwise(F.coalesce(F.col(payload), none)))


def write_monolithic(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """``pages`` as WARC files, each one gzip stream, of at most ``PER_FILE`` records."""
    rows = roles(pages, id, payload, least).select(record(id, url, payload).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", PER_FILE).text(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme that Spark gives it, so that executors reach the same one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    rest = "//" + rest.lstrip("/") if scheme != "file" else "///" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


class Inflated:
    """The bytes of a gzip file of any number of members, read as a stream."""

    def __init__(self, source):
        self.source, self.engine, self.buffer = source, zlib.decompressobj(31), bytearray()
        self.raw = b""

    def more(self) -> bool:
        while True:
            if self.engine.eof:
                self.raw = self.engine.unused_data
                self.engine = zlib.decompressobj(31)
            piece = self.raw or self.source.read(PIECE)
            self.raw = b""
            if not piece:
                return False
            out = self.engine.decompress(piece)
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buffer)
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise EOFError("a record ends with the file")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def records(stream: Inflated):
    """(head, block) of each record."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.strip():
            continue
        yield head, stream.take(int(parsed(head.lstrip())["Content-Length"]))
        stream.take(4)


def page_of(value: str) -> str:
    return value.strip("<>").removeprefix(_URN)


def rewrite(source: str, target: str) -> tuple[int, int]:
    """One file to members of one record each, and its index: id, type, offset and length of each, by tabs."""
    system, path = opened(source)
    out_system, out_path = opened(target)
    attempt = uuid.uuid4().hex
    n = at = 0
    with system.open_input_stream(path, compression=None) as raw, \
            out_system.open_output_stream(f"{out_path}/.{attempt}.gz", compression=None) as warc, \
            out_system.open_output_stream(f"{out_path}/.{attempt}.idx", compression=None) as index:
        for head, block in records(Inflated(raw)):
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = engine.compress(head) + engine.compress(block) + engine.compress(b"\r\n\r\n") + engine.flush()
            warc.write(member)
            fields = parsed(head)
            index.write(f"{page_of(fields['WARC-Record-ID'])}\t{fields['WARC-Type']}\t{at}\t{len(member)}\n".encode())
            at += len(member)
            n += 1
    name = path.rsplit("/", 1)[1].split(".")[0]
    out_system.move(f"{out_path}/.{attempt}.gz", f"{out_path}/{name}.warc.gz")
    out_system.move(f"{out_path}/.{attempt}.idx", f"{out_path}/{name}.warc.idx")  # last: an index means a whole archive
    return n, at


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites all gzip files of a folder; (source, records, bytes) of each."""
    target = qualified(spark, target)
    out_system, out_path = opened(target)
    out_system.create_dir(out_path, recursive=True)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # names only, no content

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                n, size = rewrite(name, target)
                yield pa.RecordBatch.from_pylist([{"source": name, "records": n, "bytes": size}])

    # Each file is a task's work of its own.
    spread = names.repartition(max(1, names.count()), "path")
    return cut(spread.mapInArrow(run, "source string, records bigint, bytes bigint"), "normalised")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload) of the records of normalised archives.

    Payloads are measured as they are read; a digest that differs from the record's own stops the read.  Revisits
    have no payload of their own and their size is that of the response they refer to.
    """
    lines = spark.read.option("pathGlobFilter", "*.idx").text(folder).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", ".gz").alias("archive"), F.split("value", "\t").alias("v"))
    index = lines.select("archive", F.col("v")[1].alias("type"), F.col("v")[2].cast("long").alias("at"), F.col("v")[3].cast("long").alias("size"))

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            archive, source = None, None
            for r in batch.to_pylist():
                if r["archive"] != archive:
                    if source is not None:
                        source.close()
                    archive = r["archive"]
                    system, path = opened(archive)
                    source = system.open_input_file(path)
                (head, block), = records(Inflated(pa.BufferReader(source.read_at(r["size"], r["at"]))))
                fields = parsed(head)
                told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != told:
                    raise ValueError(f"{archive}: the payload at {r['at']} differs from its digest")
                refers = fields.get("WARC-Refers-To")
                rows.append({
                    "id": page_of(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"),
                    "payload_digest": told, "refers": page_of(refers) if refers else None,
                    "payload_bytes": len(block) if r["type"] == "response" else None, "payload": block if r["type"] == "response" else None})
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if source is not None:
                source.close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
                        ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    spread = index.repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    found = spread.mapInArrow(run, "id string, record_type string, url string, payload_digest string, refers string, payload_bytes bigint, payload binary")
    return found.withColumns({"page_id": F.col("id").try_cast("long"), "refers_to": F.col("refers").try_cast("long")}).drop("id", "refers")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(table(spark, sf_dir, "pages"), f"{base}/monolithic")
    normalise(spark, f"{base}/monolithic", f"{base}/records")
    found = cut(read(spark, f"{base}/records").drop("payload", "url"), "records")
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    return found.join(sizes, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM page),
told AS (SELECT page_id, payload_bytes, list_reduce(list_transform(generate_series(0, 39, 5), lambda k: list_reduce(list_transform([15, 10, 5, 0],
   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, k + 1, 5))::INTEGER >> s) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
   CASE WHEN page_id = max(page_id) OVER d THEN 'response' ELSE 'revisit' END AS record_type,
   CASE WHEN page_id <> max(page_id) OVER d THEN max(page_id) OVER d END AS refers_to FROM told WINDOW d AS (PARTITION BY payload_digest)
"""
