"""Audit logs: folders of daily JSONL files, read as tables of lines; and the one writer that extends a chain."""

from __future__ import annotations

import fcntl
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.errors import ChainIntegrityError
from veilwork.functions.canonical import GENESIS, entry_hash
from veilwork.operators.audit_schema import checked

LINE = "file string, part long, line_no long, line string"
#: What is cut off the ends of a line: blanks, tabs, carriage returns (of CRLF), form feeds.
BLANK = " \t\r\f\v"

#: Ranges whose starts are broadcast, some 8 MB; a range has openCostInBytes at least (4 MB by default). Beyond that Spark chooses the join.
RANGES = 100_000


def _conf_bytes(spark: SparkSession, name: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def read_lines(spark: SparkSession, folder: str, names: str = "audit_*.jsonl") -> DataFrame:
    """file, part, line_no (from 1, blank lines counted), line; blank lines are left out. A folder without such files has no lines.

    Files are read by byte ranges (Spark's splits), many tasks to a file; `part` is where a line's range begins. Spark counts the rows of a range
    one by one, so a line's number in its range is known without moving it. A first pass counts the lines of each range, one row for a range; their
    sums in order of ranges give the numbers in the file. A line belongs to the range in which it begins. A last line without end is a line.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names}")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], LINE)
    raw = spark.read.text(f"{folder}/{names}", lineSep="\n").select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value"
    )
    ranges = raw.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("file", "part", (F.col("first") - earlier - 1).alias("zero"))
    most = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // max(1, _conf_bytes(spark, "spark.sql.files.openCostInBytes")) + len(found)
    lines = raw.join(F.broadcast(starts) if most <= RANGES else starts, ["file", "part"]).select("file", "part", (F.col("at") - F.col("zero")).alias("line_no"), F.btrim("value", F.lit(BLANK)).alias("line"))
    return lines.filter("line <> ''")


#: The fields of a record that reports read; what a line lacks is null.
RECORD = """seq long, event_id string, timestamp string, event_type string, model string, provider string, entity_count int,
categories map<string,double>, tokens_used array<string>, prompt_hash string, sanitized_hash string, latency_ms double, mode string,
certificate_hash string, key_id string, prev_hash string, entry_hash string, compliance_version string, article_ref array<string>,
retention_hint_days int, pii_in_log boolean, decision_id string, system_version_pin string,
bias_context struct<session_id:string,exit_reason:string,wipe_confirmed:boolean,entity_count:int>,
key_manifest struct<key_id:string,public_key:string,deployer_id:string,valid_from:string,valid_until:string,purpose:string,manifest_version:string,manifest_hash:string,root_signature:string,root_key_id:string>,
content_context struct<modality:string,synthetic:boolean,labeled:boolean,disclosure_method:string,deepfake:boolean>,
checkpoint_context struct<stamped_entry_hash:string,tsa_url:string,tst_token_b64:string,hash_algorithm:string,stamped_seq:long>"""


def records(lines: DataFrame) -> DataFrame:
    """Lines parsed for reports; lines that are no JSON object are dropped."""
    parsed = lines.withColumn("r", F.from_json("line", RECORD, {"mode": "PERMISSIVE"}))
    return parsed.filter("r is not null and (r.seq is not null or r.event_type is not null or r.entry_hash is not null)").select("file", "line_no", "line", "r.*")


def last_valid(lines: DataFrame) -> tuple[int, str] | None:
    """(seq, entry_hash) of the last line in order that has both."""
    r = lines.select("file", "line_no", F.from_json("line", "seq long, entry_hash string").alias("r")).filter("r.seq is not null and r.entry_hash is not null")
    got = r.agg(F.max_by(F.struct("r.seq", "r.entry_hash"), F.struct("file", "line_no")).alias("m")).head()["m"]
    return (got["seq"], got["entry_hash"]) if got is not None else None


class AuditLog:
    """The single writer of a chain of records in a folder of this machine. Extending a chain is serial by its nature."""

    def __init__(self, folder: str | Path, compliance: bool = False, retention_days: int = 180, strict: bool = False) -> None:
        self.folder, self.compliance, self.retention_days, self.strict = Path(folder), compliance, retention_days, strict
        self.folder.mkdir(parents=True, exist_ok=True)
        os.chmod(self.folder, 0o700)
        self.seq, self.last = self._recovered()

    def _recovered(self) -> tuple[int, str]:
        files = sorted(self.folder.glob("audit_*.jsonl"), reverse=True)
        for path in files:
            for line in reversed(path.read_text(encoding="utf-8").split("\n")):
                try:
                    entry = json.loads(line)
                    return int(entry["seq"]) + 1, str(entry["entry_hash"])
                except (ValueError, KeyError, TypeError):
                    if line.strip() and self.strict:
                        raise ChainIntegrityError(f"{path.name} ends with a broken line") from None
        return 0, GENESIS

    def append(self, entry: dict, now: datetime | None = None) -> dict:
        """Complete, check, hash and write one record; returns it."""
        now = now or datetime.now(UTC)
        entry = {"seq": self.seq, "timestamp": now.isoformat(), **entry, "prev_hash": self.last}
        if self.compliance:
            entry |= compliance_fields(entry.get("event_type", ""), self.retention_days)
        checked(entry)
        entry["entry_hash"] = entry_hash(entry)
        path = self.folder / f"audit_{now.astimezone(UTC):%Y-%m-%d}.jsonl"
        data = (json.dumps(entry, ensure_ascii=False) + "\n").encode()
        handle = os.open(path, os.O_RDWR | os.O_APPEND | os.O_CREAT, 0o600)
        try:
            fcntl.flock(handle, fcntl.LOCK_EX)
            size = os.fstat(handle).st_size
            if size and os.pread(handle, 1, size - 1) != b"\n":  # the line before was cut short
                data = b"\n" + data
            os.write(handle, data)
        finally:
            os.close(handle)
        self.seq, self.last = self.seq + 1, entry["entry_hash"]
        return entry


def compliance_fields(event_type: str, retention_days: int = 180) -> dict:
    """What a record gets in compliance mode."""
    articles = ["EU_AI_Act_Art_12", "EU_AI_Act_Art_19"]
    if event_type.startswith("bias_"):
        articles.append("EU_AI_Act_Art_4a")
    if event_type == "content_generation":
        articles.append("EU_AI_Act_Art_50")
    return {"compliance_version": "eu_ai_act_article12_v1", "article_ref": articles, "retention_hint_days": retention_days, "pii_in_log": False}
