"""Tables below the shared folder: fewer helper processes than files and their checksums need, the same rows, damage is seen."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import common
from cohortloom.llm.common import cut, release


def waited_for(spark):
    """Page faults of the child processes that the JVM has waited for: they rise by as many with each helper that ends."""
    stat = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/stat").read_text()
    return int(stat.rpartition(")")[2].split()[8])


def files(table):
    return sorted(p.name for p in Path(common._PATHS[table].removeprefix("file://")).iterdir())


def test_checksum_files_start_no_process(spark, tmp_path):
    rows = spark.range(0, 100, 1, 30)
    cut(rows)  # what a session starts once
    at = [waited_for(spark)]
    rows.write.parquet(str(tmp_path / "plain"))
    at.append(waited_for(spark))
    out = cut(rows)
    at.append(waited_for(spark))
    plain, own = at[1] - at[0], at[2] - at[1]
    assert 4 * own <= 3 * plain
    assert len([f for f in files(out) if f.endswith(".parquet")]) == 30 and not [f for f in files(out) if f.endswith(".crc")]
    release(out)


def test_rows_come_back_and_released_tables_are_empty(spark, rows):
    made = spark.createDataFrame([(1, "a\n", None), (1, "a\n", None), (None, "é", 2.5)], "doc_id long, text string, x double").repartition(3)
    out = cut(made)
    path = common._PATHS[out]
    assert rows(out) == rows(made) and out.schema == made.schema and "_temporary" not in files(out)
    release(out)
    assert spark.read.parquet(path).count() == 0


def test_damaged_pages_are_seen(spark):
    out = cut(spark.range(0, 2000, 1, 1).select(F.xxhash64("id").alias("h")))
    path = Path(common._PATHS[out].removeprefix("file://"))
    part = next(path.glob("*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|integrity|crc"):
        out.agg(F.sum("h")).collect()
