"""What the second round's review found in the plans."""

import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.operators import recovery
from cairn.plans import bindings, registry
from cairn.streaming import stateful
from tests.test_oracle import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("s_progressive_stream", "conversations"), ("s_touch_stream", "events"), ("s_staging_stream", "events"), ("s_breaker_stream", "events"), ("x_windowed_stream", "events")])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, table):
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["q_backingless_gc", "q_upstream_select"])
def test_probes_are_not_multiplied_out(spark, tmp_path, monkeypatch, name):
    """On odd keys and balances, and without a row for each narinfo and upstream."""
    c = duckdb.connect()
    for table in ("orders", "lineitem"):
        c.execute(f"CREATE TABLE {table} AS SELECT * FROM '{SF}/{table}.parquet' USING SAMPLE reservoir(2000 ROWS) REPEATABLE (1)")
    c.execute(f"CREATE TABLE part AS SELECT * FROM '{SF}/part.parquet' WHERE p_partkey % 10 <> 4")
    c.execute(f"CREATE TABLE supplier AS SELECT * REPLACE (CASE WHEN s_suppkey % 10 < 2 OR s_suppkey = 5 THEN s_acctbal ELSE abs(s_acctbal) END AS s_acctbal) FROM '{SF}/supplier.parquet' WHERE s_suppkey % 10 <> 3")
    c.execute("INSERT INTO supplier SELECT * REPLACE (NULL AS s_acctbal, 27 AS s_suppkey) FROM supplier LIMIT 1")
    c.execute("INSERT INTO supplier SELECT * REPLACE (-1 AS s_acctbal) FROM supplier WHERE s_suppkey = 8 LIMIT 1")
    c.execute("INSERT INTO supplier SELECT * REPLACE (NULL AS s_suppkey) FROM supplier LIMIT 1; INSERT INTO supplier SELECT * REPLACE (-7 AS s_suppkey, 5 AS s_acctbal) FROM supplier LIMIT 1")
    c.execute("INSERT INTO part SELECT * FROM part LIMIT 3; INSERT INTO part SELECT * REPLACE (NULL AS p_partkey) FROM part LIMIT 1; INSERT INTO part SELECT * REPLACE (-17 AS p_partkey) FROM part LIMIT 1")
    c.execute("INSERT INTO lineitem SELECT * REPLACE (-17 AS l_partkey, -7 AS l_suppkey) FROM lineitem LIMIT 2; INSERT INTO lineitem SELECT * REPLACE (NULL AS l_suppkey) FROM lineitem LIMIT 2")
    c.execute("INSERT INTO lineitem SELECT * REPLACE (77 AS l_partkey, 27 AS l_suppkey) FROM lineitem LIMIT 1")
    for table in ("orders", "lineitem", "part", "supplier"):
        c.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    want = c.sql(registry.oracle_sql()[name])
    expected = rows(want.columns, want.fetchall())
    assert len({r[0] for r in expected}) > 1
    monkeypatch.delitem(bindings.BINDINGS, "probes")
    df = registry.queries()[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == expected


def test_absence_by_class_decides_as_probes_do(spark):
    upstreams = spark.createDataFrame([(0, 0, True), (10, 0, True), (1, 1, True), (11, 1, None), (2, 2, False)], "upstream_id long, class long, answers boolean")
    assets = spark.createDataFrame([(i, i % 4) for i in range(12)], "narinfo_id long, class long")
    hits = spark.createDataFrame([(4, 10), (4, 0), (5, 1)], "narinfo_id long, upstream_id long")
    probes = assets.join(upstreams, "class").join(hits.withColumn("hit", F.lit(True)), ["narinfo_id", "upstream_id"], "left")
    probes = probes.select("narinfo_id", F.when(F.coalesce("answers", F.lit(False)), F.when(F.col("hit"), "present").otherwise("absent")).alias("status"))
    links = spark.createDataFrame([(i, i) for i in range(14)] + [(20, 0), (20, 8), (21, 0), (21, 4), (22, None), (23, 0), (23, 3)], "nar_file_id long, narinfo_id long")
    files = spark.createDataFrame([(i,) for i in range(25)], "id long")
    got = {r[0]: r[1] for r in recovery.decided(files, links, recovery.absent(assets, upstreams, hits)).collect()}
    assert got == {r[0]: r[1] for r in recovery.probed(files, links, probes).collect()}
    assert {i for i, d in got.items() if d == "delete_absent"} == {0, 8, 20} and {i for i, d in got.items() if d == "delete_linkless"} == {14, 15, 16, 17, 18, 19, 22, 24}


def test_staging_states_are_few_and_end_each_by_itself(spark, tmp_path):
    """Many keys; then one that goes backwards, one that is idle for too long and comes again, and odd rows."""
    schema = "k string, s string, at timestamp"
    day = lambda d: datetime(2024, 1, 1, 12) + timedelta(days=d)
    batches = [
        [(f"k{n}", ("requested", "staging", "complete")[n % 3], day(0)) for n in range(6000)] + [(None, "staging", day(0)), ("odd", "other", day(0)), ("odd", None, day(0))],
        [("k1", "requested", day(2)), ("k2", "requested", day(2)), ("k3", "complete", day(2)), (None, "requested", day(2)), ("k9", "staging", day(8))],
        [("k3", "requested", day(8))],
        [("k2", "staging", day(8)), ("k5", "requested", day(8)), ("odd", "requested", day(8))],
    ]
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if n < 3 else 0)
    out, states = [], []
    stream = stateful.staging(stateful.file_stream(spark, f"{tmp_path}/in", schema), "k", "s", "at")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: out.append({r[0]: r[1] for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    first, *later = [x for x in out if x]
    assert first == {k: s if s != "other" else None for k, s, _ in batches[0] if (k, s) != ("odd", None)}
    assert later[0] == {"k1": "staging", "k2": "complete", "k3": "complete", None: "staging", "k9": "staging"}
    assert later[1] == {"k3": "complete"}
    assert later[2] == {"k2": "complete", "k5": "requested", "odd": "requested"}
    assert max(states) <= 4097
