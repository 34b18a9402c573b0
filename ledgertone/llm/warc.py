"""WARC archives written and read by Spark's text source, with records found by their boundary chain.

Reading splits a file at every place that looks like the start of a record, in parallel and at any split size. Inside a
payload such a place is no record. Each task emits, for every candidate, its offset and the offset its header's length
leads to; pointer jumping from the start of each file keeps the candidates that the chain of records reaches.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertone.session import shared_folder

from .common import joined_small, remember, saved

MAGIC = "WARC/1."
#: Payloads below this size are always stored, never referred to.
LEAST_SHARED = 100
_HEADER_END, _LINE = b"\r\n\r\n", "\r\n"


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
    least: int = LEAST_SHARED, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """One record per row, in as many files as the table has partitions; an empty table writes an empty folder.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are ``response`` records (all
    of them, should that id be repeated), the others ``revisit`` records that refer to it; a null id counts as
    largest. Smaller payloads are always stored. A null payload is empty. Payloads don't cross the network: only
    digests are grouped, and the repeated ones are joined back, broadcast while few.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), text.alias("payload")).select(
        "*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("n")
    )
    shared = saved(
        rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c"))
        .where("c > 1 and first is not null").select("digest", "first"), "payloads",
    )
    rows = joined_small(rows, shared, "digest")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit(_LINE))
    # a header must not hold blanks or the magic
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), "WARC/", "WARC%2F")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + _LINE), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("n").cast("string")), F.lit(_LINE),
    )
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    header = F.concat(
        F.lit(MAGIC + "0" + _LINE),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(
            again,
            F.concat(
                line("WARC-Refers-To", name(F.col("first"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_LINE),
    )
    # the separator after each record is the pair of blank lines that the format asks for
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", _LINE * 2).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    )


_FIELD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\r?$")
_SCAN = (
    "file string, block bigint, rel bigint, size bigint, step bigint, record_type string, record_id string, "
    "target_uri string, refers_to string, declared string, at bigint, payload_bytes bigint, digest string"
)
_SCAN_ARROW = pa.schema(
    [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SCAN.split(", ")]
)


def parse(value: bytes) -> dict | None:
    """A candidate's fields from the text after the magic; None if its header is not one.

    ``step`` is the number of bytes from the magic's end to the end of the record, ``at`` and ``payload_bytes`` place
    the payload; a revisit has none here and tells the size of the full one.
    """
    end = value.find(_HEADER_END)
    if end < 0 or value[1:3] != b"\r\n" or not value[:1].isdigit():
        return None
    fields = {k.lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(value[:end])}
    length = fields.get(b"content-length", "")
    if not length.isascii() or not length.isdigit() or b"warc-type" not in fields:
        return None
    start, n = end + 4, int(length)
    out = {
        "step": start + n + 4, "record_type": fields[b"warc-type"], "record_id": fields.get(b"warc-record-id"),
        "target_uri": fields.get(b"warc-target-uri"), "refers_to": fields.get(b"warc-refers-to"),
        "declared": fields.get(b"warc-payload-digest", "").removeprefix("sha256:").lower() or None,
    }
    if "application/http" in fields.get(b"content-type", ""):
        http = value.find(_HEADER_END, start, start + n)
        inner = {k.lower(): v for k, v in _FIELD.findall(value[start : max(http, start)])}
        if http >= 0:
            start, n = http + 4, n - (http + 4 - start)
        if out["record_type"] == "revisit":
            full = inner.get(b"content-length", b"")
            return out | {"at": start, "payload_bytes": int(full) if full.isdigit() else None, "digest": out["declared"]}
    whole = start + n <= len(value)
    digest = hashlib.sha256(value[start : start + n]).hexdigest() if whole else None
    return out | {"at": start, "payload_bytes": n, "digest": digest}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, rel = None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(*batch.to_pydict().values(), strict=True):
            if split != (file, block):
                split, rel = (file, block), 0
            # what stands before the first magic of a file is no candidate
            found = parse(value) if block or rel else None
            rows.append({"file": file, "block": block, "rel": rel, "size": len(value)} | (found or {}))
            rel += len(value) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(rows, schema=_SCAN_ARROW)


def _placed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Offsets within splits become offsets of the magic within files."""
    return joined_small(rows, splits, ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel") - len(MAGIC))


def segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(every segment with its offset and, for candidates, the offset of the next record; the splits' first offsets)."""
    rows = saved(_segments(spark, path).mapInArrow(_scan, _SCAN), "segments")
    # one row per split: as many in a window as a file has splits
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = saved(
        rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
        .select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "splits",
    )
    return _placed(rows, splits).withColumn("next", F.col("offset") + len(MAGIC) + F.col("step")), splits


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, block, offset, next, ...) that the chain from offset 0 of their file reaches.

    Candidates that follow one another without a gap are one run, cut wherever another chain enters; runs are what
    pointer jumping works on, so its rounds grow with the logarithm of the runs in a file.
    """
    inside = Window.partitionBy("file", "block").orderBy("offset")
    rows = candidates.select(
        "*", F.lag("next").over(inside).alias("_before"), F.lead("offset").over(inside).alias("_after")
    )
    enters = (
        rows.where(~F.col("next").eqNullSafe(F.col("_after")))
        .select("file", F.col("next").alias("offset"), F.lit(1).alias("_entered")).distinct()
    )
    rows = rows.join(enters, ["file", "offset"], "left")
    cut = ~F.col("_before").eqNullSafe(F.col("offset")) | F.col("_entered").isNotNull() | (F.col("offset") == 0)
    rows = saved(rows.withColumn("_run", F.max(F.when(cut, F.col("offset"))).over(inside)), "candidates")
    jump = saved(rows.groupBy("file", F.col("_run").alias("at")).agg(F.max("next").alias("to")), "runs")
    starts = jump.select("file", "at")
    reached, known = saved(jump.where("at = 0").select("file", "at"), "reached"), -1
    while (now := reached.count()) > known:
        known = now
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        more = more.join(starts, ["file", "at"], "left_semi")
        reached = saved(reached.union(more).distinct(), "reached")
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = saved(jump.join(far, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "runs")
        if not jump.limit(1).count():
            break
    hit = reached.select("file", F.col("at").alias("_run"))
    return rows.join(hit, ["file", "_run"], "left_semi").drop("_run", "_before", "_after", "_entered")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, next, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest.

    Bytes and digest are of the full payload: of a stored one as read, of a revisit as its headers tell. A payload
    that holds the magic is put together from its segments. Folders without records give no rows.
    """
    rows, splits = segments(spark, path)
    found = saved(reachable(rows.where("next is not null")), "records")
    broken = found.where("digest is null and record_type <> 'revisit'").select("file", "offset", "next", "at", "payload_bytes")
    if broken.limit(1).count():
        found = found.join(_mended(spark, path, rows, splits, broken), ["file", "offset"], "left").withColumn(
            "digest", F.coalesce("digest", "mended")
        )
    return found.select(
        "file", "offset", "next", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes",
        F.col("digest").alias("payload_digest"),
    )


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, payload) of every stored record, whole."""
    rows, splits = segments(spark, path)
    found = reachable(rows.where("next is not null")).where("record_type <> 'revisit'")
    return _payloads(spark, path, rows, splits, found.select("file", "offset", "next", "at", "payload_bytes"))


def _payloads(spark, path, rows, splits, records) -> DataFrame:
    """Payloads of records from a second reading: their segments meet by the record they lie in."""
    owners = records.select("file", "offset", F.col("offset").alias("own"), F.col("next").alias("own_next"), "at", "payload_bytes")
    upto = Window.partitionBy("file").orderBy("offset")
    parts = rows.select("file", "offset").join(owners, ["file", "offset"], "left").select(
        "file", "offset", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("own", "own_next", "at", "payload_bytes")]
    )
    parts = saved(parts.where("offset < own_next"), "parts")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rel = None, 0
        for batch in batches:
            rels = []
            for file, block, value in zip(*batch.to_pydict().values(), strict=True):
                if split != (file, block):
                    split, rel = (file, block), 0
                rels.append(rel)
                rel += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rels, pa.int64())], names=["file", "block", "value", "rel"])

    texts = _segments(spark, path).mapInArrow(again, "file string, block bigint, value binary, rel bigint")
    whole = F.expr(
        "array_join(transform(array_sort(collect_list(struct(offset AS o, hex(value) AS h))), x -> x.h), " f"hex('{MAGIC}'))"
    )
    return (
        joined_small(_placed(texts, splits), parts, ["file", "offset"], "inner")
        .groupBy("file", F.col("own").alias("offset"), "at", "payload_bytes").agg(whole.alias("hex"))
        .select("file", "offset", F.expr("substring(unhex(hex), CAST(at AS INT) + 1, CAST(payload_bytes AS INT))").alias("payload"))
    )


def _mended(spark, path, rows, splits, broken) -> DataFrame:
    return _payloads(spark, path, rows, splits, broken).select("file", "offset", F.sha2("payload", 256).alias("mended"))


def broken_files(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """Files (file, size) whose chain of records does not end where the file does."""
    ends = records.groupBy("file").agg(F.max("next").alias("end"))
    return sizes.join(ends, "file", "left").where("coalesce(end, 0) <> size")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html") -> DataFrame:
    """Write the rows to an archive in the shared folder and read it back (``read_archive``)."""
    spark = pages.sparkSession
    path = remember(f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    write_archive(pages, path, id_col, url_col, payload_col)
    return read_archive(spark, path)
