"""Arrow IPC shards: both formats, lists, missing, broken and empty shards."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest

from granary.sources.arrow import count_shards, read_shards, write_shards

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("ipc", ["file", "stream"])
def test_round_trip(spark, tmp_path, ipc):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    at = f"file://{tmp_path}/docs"
    write_shards(docs, at, ipc=ipc)
    back = read_shards(spark, at)
    assert back.schema.simpleString() == docs.schema.simpleString()
    assert back.exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert back.rdd.getNumPartitions() == 3
    counted = count_shards(spark, at).collect()
    assert len(counted) == 3 and sum(r.rows for r in counted) == docs.count()
    write_shards(docs.limit(5), at, ipc=ipc)
    assert read_shards(spark, at).count() == docs.count() + 5
    write_shards(docs.limit(2), at, "overwrite", ipc)
    assert read_shards(spark, at).count() == 2 and len(list((tmp_path / "docs").glob("*.arrow"))) == 1


def put(path, table, stream=False):
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as w:
        w.write_table(table)


def test_foreign_shards(spark, tmp_path):
    """Shards of other writers: long strings, dictionaries, both formats in one folder, columns in another order."""
    put(tmp_path / "a.arrow", pa.table({"x": pa.array(["u", None], pa.large_string()), "n": [1, 2]}))
    put(tmp_path / "b.arrow", pa.table({"n": pa.array([3], pa.int32()), "x": pa.array(["v"]).dictionary_encode()}), stream=True)
    put(tmp_path / "c.arrow", pa.table({"n": pa.array([], pa.int64()), "x": pa.array([], pa.string())}))
    (tmp_path / "d.arrow").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no shard")
    got = read_shards(spark, str(tmp_path), f"{tmp_path}/missing")
    assert sorted((r.n, r.x) for r in got.collect()) == [(1, "u"), (2, None), (3, "v")]
    assert {r.shard: r.rows for r in count_shards(spark, str(tmp_path)).collect()} == {"a.arrow": 2, "b.arrow": 1, "c.arrow": 0, "d.arrow": 0}


def test_missing_broken_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="none of these is there"):
        read_shards(spark, f"{tmp_path}/gone").collect()
    (tmp_path / "empty").mkdir()
    assert read_shards(spark, f"{tmp_path}/empty", schema="a int").collect() == []
    with pytest.raises(Exception, match="give one"):
        read_shards(spark, f"{tmp_path}/empty").collect()
    (tmp_path / "bad").mkdir()
    put(tmp_path / "bad/a.arrow", pa.table({"a": [1]}))
    (tmp_path / "bad/b.arrow").write_bytes(b"ARROW1\0\0 but nothing else")
    with pytest.raises(Exception):  # noqa: B017
        read_shards(spark, f"{tmp_path}/bad").collect()
    put(tmp_path / "bad/b.arrow", pa.table({"b": [1]}))
    with pytest.raises(Exception, match="no column a"):
        read_shards(spark, f"{tmp_path}/bad").collect()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    at = f"{tmp_path}/t"
    write_shards(spark.range(10).repartition(2), at)
    with pytest.raises(Exception):  # noqa: B017
        write_shards(spark.range(10).selectExpr("id / (id - id) as id", "raise_error('broken') as e"), at, "overwrite")
    assert read_shards(spark, at).count() == 10
    assert len(json.loads((tmp_path / "t/state.json").read_text())["shards"]) == 2
