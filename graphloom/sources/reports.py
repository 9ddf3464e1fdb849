"""Coverage reports (LCOV and Cobertura) as line rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

#: Lines that go back to Spark at once.
AT_ONCE = 20_000
SCHEMA = "report_path string, suite string, path string, line long, hits long, branches_valid long, branches_covered long"


def lcov(text: str) -> Iterator[tuple]:
    """``(suite, path, line, hits, branches, branches covered)``; the last count of a line holds, and the last test name."""
    suite = ([None] + re.findall(r"^TN:(.*)$", text, re.M))[-1] or None
    for record in text.split("end_of_record"):
        name = re.search(r"^SF:(.*)$", record, re.M)
        if not name:
            continue
        hits = {int(a): int(b) for a, b in re.findall(r"^DA:(\d+),(-?\d+)", record, re.M)}
        branches: dict[int, list[int]] = {}
        for line, taken in re.findall(r"^BRDA:(\d+),[^,]*,[^,]*,(\S+)", record, re.M):
            branches.setdefault(int(line), []).append(taken not in ("-", "0"))
        for line, n in sorted(hits.items()):
            own = branches.get(line, [])
            yield suite, name[1].strip(), line, n, len(own), sum(own)


def cobertura(text: str) -> Iterator[tuple]:
    for c in ET.fromstring(text).iter("class"):
        for x in c.iter("line"):
            hits, valid, covered = int(x.get("hits", 0)), 0, 0
            if x.get("branch", "").lower() == "true":
                m = re.search(r"\((\d+)/(\d+)\)", x.get("condition-coverage", ""))
                covered, valid = (int(m[1]), int(m[2])) if m else (int(hits > 0), 1)
            yield None, c.get("filename", ""), int(x.get("number", 0)), hits, valid, covered


def is_xml(text: str) -> bool:
    return text.lstrip().startswith("<") or "<?xml" in text or "<coverage" in text


def read(files: DataFrame, suite: str | None = None) -> DataFrame:
    """Lines of all reports. ``files``: path, content. A given suite replaces what the reports say."""
    fields = [x.split() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):  # one report at a time
                path, text = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or b"").decode("utf-8", "replace")
                for r in cobertura(text) if is_xml(text) else lcov(text):
                    rows.append((path, suite or r[0], *r[1:]))
                    if len(rows) >= AT_ONCE:
                        yield as_batch(rows)
                        rows = []
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    ship(files.sparkSession)
    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, SCHEMA)
