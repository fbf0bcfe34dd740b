"""A content-addressed archive of WARC records.

An archive is two tables. ``payloads`` holds the bytes of every distinct payload once, each
as a zstandard frame of its own, under their SHA-256; ``records`` holds one row per record with its exact headers (those of WARC
and of HTTP) and the digest of its payload. Joined on the digest they give the original
records back, byte for byte; ``export_files`` writes these as WARC files and ``import_files``
takes such files apart again.

A payload many records share is stored once and sent once per ``SHARE`` records, so no task
holds a hot payload's records. Digests are verified twice: when payloads are stored, length
and a second hash must agree within a digest, and when they are read, the bytes must give
the digest under which they lie.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.llm.common import give_back, written

#: Payloads of fewer bytes are written out with every record.
LEAST = 100
#: Records of one digest that meet its payload in one group.
SHARE = 4096
#: A digest with more than this share of the records is looked up by broadcast: there are fewer than that many.
HEAVY = 1024
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, header string, record_type string, digest string, share bigint"


@F.pandas_udf(T.BinaryType())
def packed(payload: pd.Series) -> pd.Series:
    """Each payload as a zstandard frame: what is shuffled and stored is less than half."""
    return payload.map(zstandard.ZstdCompressor(level=3).compress)


@F.pandas_udf(T.BinaryType())
def unpacked(frame: pd.Series) -> pd.Series:
    return frame.map(zstandard.ZstdDecompressor().decompress, na_action="ignore").astype(object)


@F.pandas_udf(T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]))
def measured(frame: pd.Series) -> pd.DataFrame:
    """Length and SHA-256 of the bytes in a frame."""
    found = [(len(b), hashlib.sha256(b).hexdigest()) for b in map(zstandard.ZstdDecompressor().decompress, frame)]
    return pd.DataFrame(found, columns=["payload_bytes", "payload_digest"])


def _line(name: str, value: Column) -> Column:
    """A header line, absent where the value is null; line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """The exact bytes before the payload: WARC headers, blank line, HTTP headers, blank line."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )


def _with_first(rows: DataFrame) -> DataFrame:
    """Rows with ``first``, the least id of their digest, and ``share``, the part of its records they belong to.

    Counts and minima are combined before the shuffle. Digests that hold more than one in
    ``HEAVY`` rows number fewer than ``HEAVY`` and are broadcast; for the others, no key of
    the join has more rows than that.
    """
    of = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    heavy = F.col("copies") > of.select(F.sum("copies") / HEAVY).scalar()
    tagged = rows.join(F.broadcast(of.where(heavy).withColumnRenamed("digest", "hot")), F.col("digest") == F.col("hot"), "left")
    hot = tagged.where("hot IS NOT NULL").drop("hot")
    cold = tagged.where("hot IS NULL").select(*rows.columns).join(of.where(~heavy), "digest")
    both = hot.unionByName(cold)
    shares = F.ceil(F.col("copies") / SHARE).cast("bigint")
    return both.withColumn("share", F.pmod(F.xxhash64("page_id", "url"), shares)).drop("copies")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row of ``pages`` to an archive at ``path``.

    The payload is the text in UTF-8, empty for null. Of records with equal payloads of at
    least ``least`` bytes, those with the smallest id are responses and the others revisit
    them. Repeated rows of an id with equal payload give equal records. Rows without an id
    revisit as others do, but are never referred to; where no row of a payload has an id, all
    are responses. A null address leaves its header out. Other columns are not looked at.
    """
    bytes_ = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), bytes_.alias("payload"))
    keyed = written(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("n")), "keys")
    revisit = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = _with_first(keyed).withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    records.select("page_id", _header(date).alias("header"), "record_type", "digest", "share").write.parquet(f"{path}/records")
    _store(rows.select("payload"), path)


def _store(payloads: DataFrame, path: str) -> None:
    """One row per distinct payload; copies are dropped before and after the shuffle."""
    check = F.struct(F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("x"))
    once = payloads.select(F.sha2("payload", 256).alias("digest"), check.alias("check"), packed("payload").alias("payload")).groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"), F.count(F.lit(1)).alias("copies")
    )
    sound = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads with digest "), F.col("digest"))))
    once.select("digest", sound.alias("payload"), F.ceil(F.col("copies") / SHARE).cast("bigint").alias("shares")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record, payload_bytes, payload_digest``: the original records, joined from both tables.

    ``record`` has the exact bytes, with the two line ends that close it. Length and digest
    are taken from the stored payload, also for revisits, whose record ends after its headers.
    A stored payload that does not give its digest, or a record without its payload, fails the query.
    """
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")
    stored = spark.read.schema("digest string, payload binary, shares bigint").parquet(f"{path}/payloads").withColumn("actual", measured("payload"))
    actual = F.col("actual.payload_digest")
    verified = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    sent = stored.select(
        F.col("digest").alias("of"), "payload", "actual.payload_bytes", verified.alias("payload_digest"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("of_share"),
    )
    whole = records.join(sent, (F.col("digest") == F.col("of")) & (F.col("share") == F.col("of_share")), "left")
    body = F.coalesce(unpacked(F.when(F.col("record_type") == "response", F.col("payload"))), F.lit(b""))
    found = F.when(F.col("payload_digest").isNotNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest"))))
    return whole.select(
        "page_id", F.concat(F.col("header").cast("binary"), body, F.lit(END.encode())).alias("record"), "payload_bytes", found.alias("payload_digest")
    )


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``record_type``, ``target_uri``, ``refers_to`` (a page id), ``digest`` and ``block_bytes``, read from the bytes of each record.

    Fails on a record that is not as long as its own headers say.
    """
    text = F.col(record).cast("string")
    head = F.concat(F.substring_index(text, END, 1), F.lit("\r\n"))
    size = _field(head, "Content-Length").cast("bigint")
    length = F.octet_length(F.substring_index(text, END, 1)) + 4 + size + 4
    block = F.when(length == F.octet_length(record), size).otherwise(F.raise_error(F.concat(F.lit("cut record: "), head)))
    named = {
        "record_type": _field(head, "WARC-Type"),
        "target_uri": _field(head, "WARC-Target-URI"),
        "refers_to": F.regexp_extract(head, r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1).try_cast("bigint"),
        "digest": F.substring_index(_field(head, "WARC-Payload-Digest"), ":", -1),
        "block_bytes": block,
    }
    return records.select(*[c for c in records.columns if c not in named], *[v.alias(n) for n, v in named.items()])


def export_files(archive: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Writes the records of ``read_archive`` as uncompressed WARC files of at most ``per_file`` records."""
    text = F.col("record").cast("string")
    body = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 4).cast("string")
    ends = F.when(F.endswith(text, F.lit(END)), body).otherwise(F.raise_error(F.lit("record without its end")))
    archive.select(ends.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """``header, digest, payload, record_type``: the records of the WARC files at ``path``, cut by their Content-Length.

    ``header`` ends where the payload begins, so both joined are the record. A file is read
    by one task; a cut-off record fails it.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, at, out = content.as_py(), 0, []
                while at < len(data):
                    stop = data.find(b"\r\n\r\n", at) + 4
                    fields = {}
                    for line in data[at : stop - 4].split(b"\r\n")[1:]:
                        field, _, value = line.partition(b": ")
                        fields[field.lower()] = value
                    if stop < 4 or b"content-length" not in fields:
                        raise ValueError(f"{name}: no record at byte {at}")
                    end = stop + int(fields[b"content-length"])
                    if data[end : end + 4] != b"\r\n\r\n":
                        raise ValueError(f"{name}: record at byte {at} is cut off")
                    inner = data.find(b"\r\n\r\n", stop, end) + 4
                    body = inner if fields.get(b"content-type", b"").startswith(b"application/http") and inner >= 4 else stop
                    out.append((data[at:body], data[body:end], fields.get(b"warc-payload-digest", b"").decode().rpartition(":")[2], fields.get(b"warc-type", b"").decode()))
                    at = end + 4
                    if len(out) == 256 or at >= len(data):
                        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.string(), pa.string()), strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["header", "payload", "digest", "record_type"])
                        out = []
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, "header binary, payload binary, digest string, record_type string")
