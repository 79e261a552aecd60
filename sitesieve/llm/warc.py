"""WARC archives of pages, written with an index and read back through it.

Writing: each task appends its records, every one a gzip member of its own, to a file of its own in the shared folder and
returns one index row per record: file, offset, length, URL, digest. The index is a written table, and only the files of tasks that it
names count: what a lost or repeated task attempt leaves behind has another name and is never read.

Reading: selected index rows are dealt out by file and stretch of ``STRETCH`` bytes, sorted by offset, and read in ranges that join neighbours
less than ``GAP`` bytes apart, ``STRETCH`` at most at once (or one record, if it is longer). Payloads of responses are hashed again
and compared with the recorded digest.

Copies: of records with equal payloads (SHA-256 and length) of at least ``SMALLEST`` bytes, the one with the smallest page id is a
response, the others are revisits that refer to it. Shorter ones are all responses. A null html is an empty payload, a null URL leaves the
header out, null page ids come last; of rows that repeat page id and payload, the first by URL counts as the smaller.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_path, stage

SMALLEST = 100
GAP = 64 << 10
STRETCH = 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of every row of ``pages``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html"))
    narrow = stage(rows.filter(F.col("n_bytes") >= smallest).groupBy("digest", "page_id").agg(F.count("*").alias("n")), "payloads")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id"))
    groups = narrow.groupBy("digest").agg(least["page_id"].alias("refers_to"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    # only rows that are not alone with their payload are looked up; the others stay where they are
    copies = stage(narrow.join(groups, "digest"), "copies").withColumnsRenamed({"digest": "d", "page_id": "id"})
    marked = rows.join(copies, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("id")), "left")
    first = (F.col("page_id").eqNullSafe(F.col("refers_to"))) & (F.col("n") == 1)
    marked = marked.withColumn("record_type", F.when(F.col("n").isNull() | first, "response").otherwise("revisit"))
    columns = ["page_id", "url", "html", "digest", "record_type", "refers_to"]
    repeated = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("n") > 1)
    if not copies.filter("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy(F.col("url").asc_nulls_last()))
        again = marked.filter(F.coalesce(repeated, F.lit(False))).withColumn("record_type", F.when(place == 1, "response").otherwise("revisit"))
        marked = marked.filter(~F.coalesce(repeated, F.lit(False))).select(*columns).unionByName(again.select(*columns))
    return marked.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers_to"))).select(*columns)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One uncompressed WARC record. The block is an HTTP response, of a revisit only its head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT if kind == "revisit" else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if kind == "revisit" else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """Header fields of an uncompressed record, with its block as ``block``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    found = dict(line.split(": ", 1) for line in lines)
    found["block"] = rest[: int(found["Content-Length"])]
    return found


def write(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` (as ``roles`` gives them) below ``path``; the index of what was written, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        try:
            for batch in batches:
                index = []
                for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    packed = gzip_member(record(page_id, url, payload, digest, kind, refers_to))
                    out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(packed)
                    index.append((page_id, url, digest, kind, name, offset, len(packed)))
                    offset += len(packed)
                columns = list(zip(*index)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))
        finally:
            if out is not None:
                out.close()

    id_field = rows.schema["page_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(id_field), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ("page_id", "url", "digest", "record_type", "file", "offset", "length")
    schema = f"page_id {id_field.simpleString()}, url string, digest string, record_type string, file string, offset long, length long"
    return stage(rows.mapInArrow(run, schema), "warc_index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = STRETCH) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, start, stop) of joined reads over records sorted by offset."""
    joined: list[tuple[int, int, int, int]] = []
    for i, (start, n) in enumerate(zip(offsets, lengths)):
        if joined and start - joined[-1][3] <= gap and start + n - joined[-1][2] <= most:
            joined[-1] = (joined[-1][0], i + 1, joined[-1][2], max(joined[-1][3], start + n))
        else:
            joined.append((i, i + 1, start, start + n))
    return joined


def read(index: DataFrame, path: str) -> DataFrame:
    """What the records of the selected ``index`` rows say: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def of_record(found: dict) -> tuple:
        head, _, payload = found["block"].partition(b"\r\n\r\n")
        said = found["WARC-Payload-Digest"].removeprefix("sha256:")
        if found["WARC-Type"] == "response":
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if digest != said:
                raise ValueError(f"payload of {found['WARC-Record-ID']} differs from its digest")
        else:
            n, digest = int(head.rpartition(b"Content-Length: ")[2]), said
        return (
            found.get("X-Page-ID"), found.get("WARC-Target-URI"), n, digest, found["WARC-Type"], found.get("X-Refers-To-Page-ID"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin]:
                    end += 1
                with store.open_input_file(f"{folder}/{files[begin]}") as source:
                    for first, last, start, stop in ranges(offsets[begin:end], lengths[begin:end]):
                        data = source.read_at(stop - start, start)
                        rows = []
                        for k in range(begin + first, begin + last):
                            at = offsets[k] - start
                            rows.append(of_record(parse(zlib.decompress(data[at : at + lengths[k]], 31))))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                            names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                        )
                begin = end

    id_type = index.schema["page_id"].dataType
    stretch = F.floor(F.col("offset") / STRETCH)
    spread = index.repartition("file", stretch).sortWithinPartitions("file", "offset").select("file", "offset", "length")
    said = spread.mapInArrow(
        run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )
    return said.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write all ``pages`` into the shared folder; the index and where the files are."""
    path = new_path(pages.sparkSession, "warc")
    return write(roles(pages), path), path
