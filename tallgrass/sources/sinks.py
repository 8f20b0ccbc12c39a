"""Sinks: canonical JSON files, backup copies, read-back verification, exports, keyed tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.records import strip_service

_OPEN, _BETWEEN, _CLOSE = "[\r\n", ",\r\n", "\r\n]"


def render(records: list[object]) -> str:
    """Records as the canonical file has them: indented by 4, CRLF, text as it is, no line break at the end."""
    return json.dumps(records, ensure_ascii=False, indent=4).replace("\n", "\r\n")


def canonical_rows(records: DataFrame, order_col: str) -> DataFrame:
    """``ord json``: each record as one JSON object in field order, null fields left out."""
    fields = [c for c in records.columns if c not in (order_col, "path")]
    return records.select(F.col(order_col).alias("ord"), F.to_json(F.struct(*fields)).alias("json"))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as it stands in the file, between two commas."""
    for batch in batches:
        whole = [render([json.loads(r)]) for r in batch.column("json").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([w[len(_OPEN) : -len(_CLOSE)] for w in whole], pa.string())], names=["value"])


def write_canonical(spark: SparkSession, records: DataFrame, order_col: str, path: str) -> str | None:
    """Writes one canonical file and reads it back before the old one goes, which stays as ``path.bak``. Returns the copy's path.

    Tasks render sorted parts beside the target; these are then joined byte by byte, so no record passes through Python on
    the driver and memory is that of a buffer. The file is read again, and its length and checksum must be those of what was
    written; else an error is raised and the old file is where it was.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, fresh, folder = (hadoop.Path(f"{path}{end}") for end in ("", f".new-{uuid.uuid4().hex}", f".parts-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    backup = f"{path}.bak"
    fs.setWriteChecksum(False)  # a checksum file beside it would outlive edits by other programs
    try:
        rows = canonical_rows(records, order_col).orderBy("ord").select("json")
        rows.mapInArrow(_rendered, "value string").write.option("lineSep", _BETWEEN).text(folder.toString())
        parts = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
        check, length = jvm.java.util.zip.CRC32(), 0
        out = jvm.java.util.zip.CheckedOutputStream(fs.create(fresh, True), check)
        try:
            pieces = [(None, _OPEN if parts else "[]"), *parts, *([(None, _CLOSE)] if parts else [])]
            for i, (part, size) in enumerate(pieces):
                if part is None:
                    out.write(bytearray(size.encode()))
                    length += len(size)
                else:
                    size -= len(_BETWEEN) * (i == len(parts))  # nothing after the last record
                    given = fs.open(hadoop.Path(part))
                    try:
                        whole = jvm.org.apache.commons.io.input.BoundedInputStream(given, size)
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(whole, out, 1 << 16, False)
                    finally:
                        given.close()
                    length += size
        finally:
            out.close()
        again = jvm.java.util.zip.CheckedInputStream(fs.open(fresh), jvm.java.util.zip.CRC32())
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(again, jvm.java.io.OutputStream.nullOutputStream(), 1 << 16, False)
        finally:
            again.close()
        if fs.getFileStatus(fresh).getLen() != length or again.getChecksum().getValue() != check.getValue():
            raise OSError(f"{path} was not written as it was meant to be; the old file is as it was")
        had = fs.exists(target)
        if had:
            fs.delete(hadoop.Path(backup), False)
            fs.rename(target, hadoop.Path(backup))
        if not fs.rename(fresh, target):
            raise OSError(f"{path} could not be put in its place; the old file is {backup}")
        return backup if had else None
    finally:
        fs.delete(folder, True)
        fs.delete(fresh, False)
        fs.setWriteChecksum(True)


def verify(written: DataFrame, expected: DataFrame) -> bool:
    """Whether two sets of rows are the same, repeats counted."""
    columns = expected.columns
    one, other = (df.select(*[F.to_json(F.struct(F.col(c))).alias(c) for c in columns]) for df in (written, expected))
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def export(records: DataFrame, path: str) -> None:
    """JSON lines without service fields, a file for each partition."""
    strip_service(records).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def without(records: DataFrame, order_col: str, places: list[int]) -> DataFrame:
    """Records but those at the given places."""
    return records.filter(~F.col(order_col).isin(places)) if places else records


def cleared(records: DataFrame) -> DataFrame:
    """No records, with the same columns."""
    return records.limit(0)
