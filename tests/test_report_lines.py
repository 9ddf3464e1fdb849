"""Coverage reports line by line, in splits of any size, against the small parser."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import report_lines, reports

XML = (
    '<?xml version="1.0"?><coverage><packages><package><classes>'
    '<class filename="a.py"><methods><method name="f"><lines><line number="2" hits="1"/></lines></method></methods><lines><line number="1" hits="0"/><line number="3" hits="2" branch="true" condition-coverage="50% (1/2)"/><line number="4" hits="1" branch="True"/></lines></class>'
    '<class filename="b.py"><lines><line number="9" hits="5"/></lines></class></classes></package></packages></coverage>'
)


def report(seed, records=40):
    rnd = random.Random(seed)
    out = [f"TN:first{seed}"]
    for k in range(records):
        out.append(f"SF:src/f{k % 25}.c ")
        for _ in range(rnd.randint(0, 30)):
            n = rnd.randint(1, 20)
            out += [f"DA:{n},{rnd.randint(0, 3)}"] + [f"BRDA:{n},0,{j},{rnd.choice(['-', '0', '4'])}" for j in range(rnd.randint(0, 2))] + ["FN:1,x"] * (rnd.random() < 0.2)
        out += ["BRDA:77,0,0,1", "LF:3", "end_of_record"]
        if k == 20:
            out.append("TN:later")
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("split", ["300b", "128m"])
def test_splits_of_any_size_give_what_the_small_parser_gives(spark, tmp_path, split):
    texts = {f"r{k}.info": report(k) for k in range(3)} | {"empty.info": "", "none.info": "nothing here\nDA:1,1\n", "x.xml": XML, "noname.info": "TN:\nSF:z.c\nDA:5,-1\nend_of_record"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = report_lines.read(spark, str(tmp_path))
        got = sorted(((r.report_path.rsplit("/", 1)[1], *tuple(r)[1:]) for r in found.collect()), key=str)
        tasks = report_lines.lcov(spark, str(tmp_path / "r0.info")).sparkSession.read.text(str(tmp_path / "r0.info")).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(((name, *row) for name, text in texts.items() for row in (reports.cobertura(text) if reports.is_xml(text) else reports.lcov(text))), key=str)
    assert got == want and len(got) > 400
    assert (tasks > 10) == (split == "300b")
    one = report_lines.read(spark, str(tmp_path / "r1.info"), "mine")
    assert {r.suite for r in one.select("suite").distinct().collect()} == {"mine"}


def test_no_python(spark, tmp_path):
    (tmp_path / "r.info").write_text(report(1))
    plan = report_lines.read(spark, str(tmp_path)).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


def test_reports_of_one_batch_are_read_one_at_a_time(spark, monkeypatch):
    """A task gives back what it has read before it reads on: its memory doesn't go with all reports of a batch."""
    import pyarrow as pa

    text = '<coverage><class filename="a.c"><lines>' + "".join(f'<line number="{k}" hits="1"/>' for k in range(15_000)) + "</lines></class></coverage>"
    taken = []
    monkeypatch.setattr(reports, "ship", lambda s: None)

    class Files:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([f"r{k}" for k in range(8)]), pa.array([text.encode()] * 8)], names=["path", "content"])
            taken.extend(b.num_rows for b in run(iter([batch])))

    reports.read(Files())
    assert sum(taken) == 8 * 15_000 and max(taken) <= 20_000
