"""Mail filtering on tables and streams: messages in, an action and the message to send on for each out."""

from __future__ import annotations

import email
import email.policy
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources import formats, tables

_FLAGS = [re.compile(p) for p in (V.FLAG_AUTOEXEC, V.FLAG_WRITE, V.FLAG_EXECUTE)]


def message_stream(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """New message files of a folder as a stream: file_id, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file_id"), "content")


def _is_office(data: bytes) -> bool:
    return tables.container_of(data) in ("OLE", "PPT", "OpenXML", "Word2003_XML", "MHTML")


def _suspicious(data: bytes) -> bool:
    code = "\n".join(m[3] for inner in formats.inner_ole(data) for m in tables._project_modules(inner))
    runs, writes, executes = (bool(f.search(code)) for f in _FLAGS)
    return runs and (writes or executes)


def _verdicts(message: email.message.Message):
    """(part, place, name, verdict) of the leaf parts, with a name or without; each is judged by itself."""
    leaves = (p for p in message.walk() if not p.get_content_type().startswith("multipart"))
    for place, part in enumerate(leaves):
        data = part.get_payload(decode=True) or b""
        yield part, place, part.get_filename() or "", ("not office" if not _is_office(data) else "SUSPICIOUS" if _suspicious(data) else "Macro OK")


def attachments(messages: DataFrame) -> DataFrame:
    """file_id, place, name, verdict, error of each leaf part of the messages."""
    read = lambda d: ((k, n, v) for _, k, n, v in _verdicts(email.message_from_bytes(d, policy=email.policy.compat32)))
    return tables.generate(messages, read, "place long, name string, verdict string", errors=True)


def actions(messages: DataFrame) -> DataFrame:
    """file_id, attachments, suspicious, action, message: REPLACE with suspicious attachments replaced by a note; ACCEPT as it is; DISCARD (no message) where a part can't be read. Works alike on tables and streams: each message is one row."""

    def read(data):
        try:
            message = email.message_from_bytes(data, policy=email.policy.compat32)
            n, bad = 0, 0
            for part, _, name, verdict in _verdicts(message):
                n += bool(name) or verdict != "not office"
                if verdict == "SUSPICIOUS":
                    bad += 1
                    part.set_payload(V.REMOVED)
                    part.set_type("text/plain")
                    del part["Content-Transfer-Encoding"]
                    part["Content-Transfer-Encoding"] = "7bit"
        except Exception:  # whatever a hostile part does: the message doesn't get through, and the stream goes on
            yield None, None, "DISCARD", None
            return
        yield n, bad > 0, "REPLACE" if bad else "ACCEPT", message.as_bytes() if bad else data

    return tables.generate(messages, read, "attachments long, suspicious boolean, action string, message binary")


def archive(messages: DataFrame, path: str, checkpoint: str | None = None):
    """Keeps every message as it came, by day, as Parquet: a table is written, a stream's query is started and returned."""
    rows = messages.select("file_id", "content", F.current_date().alias("day"))
    if messages.isStreaming:
        return rows.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return rows.write.mode("append").partitionBy("day").parquet(path)
