"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import datetime
import hashlib
import json
import os
import time

import duckdb
import pytest

from emberlog.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None:
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(name, spark, duck):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in catalog.oracle():
        found = duck.sql(catalog.oracle()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_streams(spark, tmp_path):
    from emberlog.operators.subscriptions import subscription_table
    from emberlog.streaming import live

    log = catalog._as_log(spark.read.parquet(f"{FOLDER}/events.parquet"))
    log.repartitionByRange(3, "lev_id").write.parquet(f"{tmp_path}/log")
    stream = live.file_log(spark, f"{tmp_path}/log", log.schema)
    live.deliver(stream, subscription_table(spark, catalog._SUBS), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/out/sent")
    assert sent.select("conn", "sub", "lev_id").distinct().count() == sent.count() > 0
    live.write_stream(live.file_log(spark, f"{tmp_path}/log", log.schema), f"{tmp_path}/store", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store").count() == log.where("kind != 20001").count()
    timed = log.selectExpr("lev_id", "cast(created_at as double) at", "pubkey")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed.coalesce(1).write.parquet(f"{tmp_path}/timed")
    limited = live.rate_limited(live.file_log(spark, f"{tmp_path}/timed", timed.schema), "pubkey", 0.0001, 3)
    # State with a time to live always wants another batch, so the stream is stopped once it has read everything.
    q = limited.writeStream.format("memory").queryName("limited").outputMode("append").start()
    deadline = time.time() + 90
    while time.time() < deadline and spark.table("limited").count() < timed.count():
        time.sleep(0.5)
    q.stop()
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in live.rate_limited_batch(timed, "pubkey", 0.0001, 3).collect()}


def test_event_id_hashes_every_event(spark, tmp_path):
    """Ids from 1000 on too, against a plain loop."""
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), i % 7, ["view", "purchase"][i % 2], 1.0, f'{{"k": {i % 5}}}') for i in (0, 1, 999, 1000, 1001, 123_457)]
    spark.createDataFrame(rows, catalog._STREAM).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i, ts, user, kind, _, props in rows:
        k = str(json.loads(props)["k"])
        tags = [["d", k], ["t", k]] if kind == "purchase" else [["t", k]]
        at = int(ts.replace(tzinfo=datetime.UTC).timestamp())
        text = json.dumps([0, hashlib.sha256(str(user).encode()).hexdigest(), at, 30023 if kind == "purchase" else 1, tags, ""], separators=(",", ":"))
        want[i] = hashlib.sha256(text.encode()).hexdigest()
    assert {r.lev_id: r.event_hash for r in catalog.queries()["event_id"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["stream_match", "stream_handoff", "stream_search_handoff"])
def test_streams_of_tables_in_several_files(name, spark, tmp_path, duck):
    """A table that is a folder is read whole, as one that is a file."""
    for t in ("events", "documents"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(duck.sql(f"select {', '.join(columns)} from ({catalog.oracle()[name]})").fetchall())
