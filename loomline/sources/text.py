"""Lines of text files as messages, and results as JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import ParseResult
from ..plans.ranking import numbered

# What the command line takes at most.
MAX_LINE, MAX_LINES, MAX_BYTES = 8 << 20, 1_000_000, 256 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx and msg: the lines of the files at ``path``, numbered by file and place. Lines end in a line feed; one
    carriage return before it is dropped. Blank lines stay. Invalid UTF-8 becomes U+FFFD."""
    raw = spark.read.option("lineSep", "\n").text(path)
    found = raw.select(F.make_valid_utf8(F.regexp_replace("value", r"\r\z", "")).alias("msg"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return numbered(found, [F.col("_f"), F.col("_b"), F.col("_m")], "idx").select("idx", "msg")


def read_lines_local(spark: SparkSession, path: str, stdin=None) -> DataFrame:
    """The same for the driver's own files and standard input (``-``), within limits."""
    data = (stdin or sys.stdin.buffer).read() if path == "-" else open(path, "rb").read()
    if len(data) > MAX_BYTES:
        raise ValueError(f"input has more than {MAX_BYTES} bytes")
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    if len(lines) > MAX_LINES:
        raise ValueError(f"input has more than {MAX_LINES} lines")
    if max(map(len, lines), default=0) > MAX_LINE:
        raise ValueError(f"a line has more than {MAX_LINE} bytes")
    rows = [(i, x.removesuffix(b"\r").decode("utf-8", "replace")) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "idx long, msg string")


def document(result: ParseResult, templates: bool = False, masks: bool = False) -> dict:
    """One document of a small result: only what is asked for is computed."""
    out: dict = {"clusters": [r["cluster_id"] for r in result.clusters.orderBy("idx").collect()]}
    if templates and (found := [r["templates"] for r in result.templates.orderBy("cluster_id").collect()]):
        out["templates"] = found
    if masks and (shown := [r["mask"] for r in result.masks.orderBy("idx").collect()]):
        out["masks"] = shown
    return out


def write_document(out: dict, path: str, stdout=None) -> None:
    text = json.dumps(out, indent=2, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "\n"
    if path == "-":
        (stdout or sys.stdout).write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def write_json(result: ParseResult, path: str) -> None:
    """Results of any size, as JSON lines: idx, cluster_id and mask; and beside them the templates."""
    result.clusters.join(result.masks, "idx").write.mode("overwrite").json(f"{path}/messages")
    result.templates.write.mode("overwrite").json(f"{path}/templates")
