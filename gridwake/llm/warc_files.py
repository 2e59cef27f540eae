"""Operator 4: WARC archives, read back by boundary-chain verification.

Writing: records with equal payloads (by SHA-1) meet once; the smallest id is the response, the others are revisits that
refer to it and store no payload. Records are lines of Spark's text writer whose line separator is the empty line that
ends a WARC record, so the archives are plain, valid WARC files in whatever store Spark writes to.

Reading: a task takes a file and emits for each place where a record could begin, that is for each magic at the start or
behind an empty line, where it would end by its own header. A payload can hold a magic, even a whole record, so candidates are no records yet. The offsets of
a file then go to one small group that follows them from the file's start by pointer jumping: in round k every candidate
knows the candidate 2**k records ahead, so the chain is known after log2(n) rounds. Candidates off the chain are dropped.

Only offsets travel (24 bytes for each candidate); a group is one file, and files are kept to about FILE_BYTES by the
writer. Files of other writers are read whole by a task as well, so they must fit into its memory.

Defined results: a null html is an empty payload; rows with the same id and payload are all responses if the id is the
smallest; a row without an id is a revisit if its payload has a row with one and a response otherwise; a null url is
left out of the header; an empty table gives an empty folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import join_checked, materialize, new_path

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 8 << 20


def base32(digest: Column) -> Column:
    """Upper-case base32 of the hex digits of a SHA-1: 8 groups of 5 make 4 letters each."""

    def letters(k: Column) -> Column:
        bits = F.conv(F.substr(digest, 5 * k + 1, F.lit(5)), 16, 10).cast("int")
        letter = lambda shift: F.substr(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(letter(15), letter(10), letter(5), letter(0))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, record): the text of each page's record, without the empty line behind it. Payloads under least_bytes are never revisits."""
    base = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # The digest has a step of its own: its letters are cut out of it one by one.
    own = base.select("*", F.sha1(F.col("html").cast("binary")).alias("hex"), F.octet_length("html").cast("long").alias("size")).withColumn("digest", base32(F.col("hex"))).drop("hex")
    # Payloads that stand more than once; partial aggregation meets hot payloads before the shuffle.
    again = own.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("order").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL").select("digest", "response")
    # As a rule few payloads repeat, and then no page has to travel.
    met = join_checked(own, materialize(again, "repeated_payloads"), "digest", max_rows=200_000)
    revisit = F.coalesce(~F.col("order").eqNullSafe(F.col("response")) & F.col("response").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("response"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return met.select("id", F.concat(head, block).alias("record"))


def write_warc(pages: DataFrame, folder: str, **columns) -> None:
    """Write a record for each page to WARC files of about FILE_BYTES in folder."""
    size = sum((F.coalesce(F.octet_length(columns.get(f"{c}_col", c)), F.lit(0)).cast("long") for c in ("html", "url")), F.lit(600))
    mean = pages.agg(F.avg(size)).first()[0] or 600
    per_file = max(1, int(FILE_BYTES / mean))
    records(pages, **columns).select("record").write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)


_NEXT = END.encode() + MAGIC
_CONTENT = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")


def _field(head: bytes, name: bytes) -> str | None:
    at = head.find(b"\r\n" + name + b": ")
    return None if at < 0 else head[at + len(name) + 4 : head.index(b"\r\n", at + 2)].decode("utf-8", "replace")


def _candidates(content: bytes) -> Iterator[tuple]:
    """(offset, next offset, type, id, refers to, payload bytes, digest said, digest of the stored payload) for each magic at the start or behind an empty line."""
    at = 0 if content.startswith(MAGIC) else content.find(_NEXT) + 4
    while at != 3:
        close = content.find(b"\r\n\r\n", at)  # headers are of any length, and those of two magics share no byte
        head = content[at : close + 2] if close >= 0 else b""
        length = _CONTENT.search(head)
        body = close + 4
        end = body + int(length[1]) if length else -1
        if length and content[end : end + 4] == b"\r\n\r\n":
            http = content.find(b"\r\n\r\n", body, end)
            stored = content[http + 4 : end] if http >= 0 else b""
            kind = _field(head, b"WARC-Type")
            said = (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
            full = _CONTENT.search(content, body, http + 2) if http >= 0 else None
            size = len(stored) if kind != "revisit" else int(full[1]) if full else None
            digest = said if kind == "revisit" else base64.b32encode(hashlib.sha1(stored).digest()).decode()
            yield at, end + 4, kind, _field(head, b"WARC-Record-ID"), _field(head, b"WARC-Refers-To"), size, said, digest
        at = content.find(_NEXT, at) + 4


def chain(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from the smallest possible start, offset 0, reaches; offset is ascending."""
    n = len(offset)
    jump = np.searchsorted(offset, after)
    jump[(jump < n) & (offset[np.minimum(jump, n - 1)] != after)] = n
    jump = np.append(jump, n)  # n stands for the end
    reached = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        reached[0] = True
    while True:
        step = jump[np.flatnonzero(reached)]
        if reached[step].all():
            break
        reached[step] = True
        jump = jump[jump]
    return reached[:n]


_CANDIDATE = "file string, start bigint, after bigint, kind string, record_id string, refers_to string, payload_bytes bigint, digest_said string, digest string, file_bytes bigint"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of the archives in folder where a record could begin, with what its header says."""
    fields = [c.split() for c in _CANDIDATE.split(", ")]
    names, kinds = [n for n, _ in fields], [pa.string() if k == "string" else pa.int64() for _, k in fields]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                stored = content.as_buffer().to_pybytes()
                rows = [(path.as_py(), *c, len(stored)) for c in _candidates(stored)]
                if stored and not rows:
                    raise ValueError(f"{path}: no record begins in {len(stored)} bytes")
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content").mapInArrow(tb.tidy(find), _CANDIDATE)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in folder: the candidates that the chain of their file reaches. A chain that does not end with its file is an error."""
    found = materialize(candidates(spark, folder), "candidates")

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        after = group["after"].to_numpy()
        reached = chain(group["start"].to_numpy(), after)
        end, size = after[reached].max(initial=0), group["file_bytes"][0].as_py()
        if end != size:
            raise ValueError(f"{group['file'][0]}: the records end at byte {end} of {size}")
        return group.filter(pa.array(reached)).select(["file", "start"])

    on_chain = found.select("file", "start", "after", "file_bytes").groupBy("file").applyInArrow(follow, "file string, start bigint")
    return found.join(on_chain, ["file", "start"], "left_semi").drop("file_bytes")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS {kind})")
    return read_warc(spark, folder).select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
