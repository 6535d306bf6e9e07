"""The CSV folder source: ranges, headers, rescue, restarts."""

import io
import json
import os
import random

import pytest
from pyspark.sql import types as T

from roomledger.sources import csvfolder as c

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])


@pytest.fixture
def local(folder):
    path = folder.removeprefix("file:")
    os.makedirs(f"{path}/csv")
    return path


def put(local, name, text):
    os.makedirs(os.path.dirname(f"{local}/csv/{name}"), exist_ok=True)
    with open(f"{local}/csv/{name}", "wb") as out:
        out.write(text if isinstance(text, bytes) else text.encode())


def land(spark, local, **more):
    c.land_folder(spark, f"{local}/csv", f"{local}/bronze", f"{local}/cp", SCHEMA, **more).awaitTermination()
    return spark.read.parquet(f"{local}/bronze")


def rows(df):
    return sorted((r.k is not None, r.k, r.name, r.v) for r in df.collect())


@pytest.mark.parametrize("seed", range(40))
def test_every_line_is_in_one_range(seed, monkeypatch):
    pick = random.Random(seed)
    monkeypatch.setattr(c, "CHUNK", pick.randint(1, 30))
    monkeypatch.setattr(c, "HEAD", pick.randint(1, 9))
    lines = [bytes(pick.choice(b"ab\xc3\xa9,") for _ in range(pick.randint(0, 12))) for _ in range(pick.randint(0, 12))]
    data = b"k,name\n" + b"\n".join(lines) + (b"\n" if pick.random() < 0.5 else b"")
    cut = pick.randint(1, 25)
    found = []
    for plan in c.plan_ranges([("f", len(data))], cut):
        for _, size, start, end in plan.parts:
            blocks = list(c.whole_lines(io.BytesIO(data), size, start, end))
            assert blocks[0] == b"k,name\n"
            found.append(b"".join(blocks[1:]))
    assert b"".join(found) == data[7:]


def test_ranges_pack_small_files_and_cut_long_ones():
    plans = c.plan_ranges([("a", 30), ("b", 0), ("c", 60), ("d", 250)], 100)
    assert [[(p, s, e) for p, _, s, e in plan.parts] for plan in plans] == [
        [("a", 0, 30), ("c", 0, 60)], [("d", 0, 100)], [("d", 100, 200)], [("d", 200, 250)]]


def test_files_land_once_by_their_own_headers(spark, local):
    put(local, "a.csv", "k,name,v\n1,one,1.5\n2,,2\n")
    put(local, "deep/b.csv", "v,extra,k\r\n3.5,tier 1,3\r\n4,,4\r\n")
    put(local, "_hidden.csv", "k\n9\n")
    first = land(spark, local, range_bytes=20)
    assert rows(first) == [(True, 1, "one", 1.5), (True, 2, None, 2.0), (True, 3, None, 3.5), (True, 4, None, 4.0)]
    rescued = [json.loads(r._rescued_data) for r in first.collect() if r._rescued_data]
    assert len(rescued) == 1 and rescued[0]["extra"] == "tier 1" and rescued[0]["_file_path"].endswith("b.csv")
    assert land(spark, local).count() == 4
    put(local, "c.csv", '﻿k,name,v\n5,"five, 5",\n')
    assert rows(land(spark, local))[-1] == (True, 5, "five, 5", None)
    assert {os.path.basename(r[0]) for r in first.select("_source_file").distinct().collect()} == {"a.csv", "b.csv"}


def test_bad_values_and_lines_are_rescued(spark, local):
    put(local, "a.csv", b"k,name,v\nx,y,1\n1,n,2,more\n7\n8,\"\",1\n9,caf\xe9,1\n\n")
    got = {(r.k, r.name, r.v): json.loads(r._rescued_data) if r._rescued_data else None for r in land(spark, local).collect()}
    assert set(got) == {(None, "y", 1.0), (1, "n", 2.0), (7, None, None), (8, "", 1.0), (9, "caf�", 1.0)}
    assert got[None, "y", 1.0]["k"] == "x" and "_corrupt_record" not in got[None, "y", 1.0]
    assert got[1, "n", 2.0]["_corrupt_record"] == "1,n,2,more" and got[7, None, None]["_corrupt_record"] == "7"
    assert got[8, "", 1.0] is None is got[9, "caf�", 1.0]


def test_a_batch_that_fails_is_landed_once(spark, local, monkeypatch):
    put(local, "a.csv", "k,name,v\n1,a,1\n")
    land(spark, local)
    put(local, "b.csv", "k,name,v\n2,b,2\n")
    stream = c.folder_stream(spark, f"{local}/csv", f"{local}/cp/files", SCHEMA)

    def fail(batch, number):
        batch.write.mode("overwrite").parquet(f"{local}/bronze/landed={number}")
        raise RuntimeError("killed")

    query = stream.writeStream.option("checkpointLocation", f"{local}/cp/stream").trigger(availableNow=True).foreachBatch(fail).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    put(local, "c.csv", "k,name,v\n3,c,3\n")
    assert [r[1] for r in rows(land(spark, local))] == [1, 2]  # the failed batch again, with the files it had
    assert [r[1] for r in rows(land(spark, local))] == [1, 2, 3]
    assert [r[1] for r in rows(land(spark, local))] == [1, 2, 3]


def test_empty_folder_and_header_only(spark, local):
    put(local, "a.csv", "k,name,v\n")
    put(local, "b.csv", "")
    c.land_folder(spark, f"{local}/csv", f"{local}/bronze", f"{local}/cp", SCHEMA).awaitTermination()
    put(local, "c.csv", "k,name,v\n1,a,1")
    assert rows(land(spark, local)) == [(True, 1, "a", 1.0)]
