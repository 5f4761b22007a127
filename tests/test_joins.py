from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks.queries import registered
from fleetlens.functions import scalar as S
from fleetlens.operators import joins, scan, scope
from fleetlens.session import prepare
from fleetlens.sources.tables import to_model
from helpers import at, rows

HOT = 400
HUGE = str(2**63 - 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many of them exact copies."""
    facts = [(1, i % 3) for i in range(HOT)] + [(k, k) for k in range(2, 12)] + [(None, 5)]
    return (
        spark.createDataFrame(facts, "k int, v int").repartition(4),
        spark.createDataFrame([(k, f"n{k}") for k in range(1, 9)], "k int, name string"),
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_ways_agree(spark, skewed, how):
    facts, dim = skewed
    results = []
    for broadcast, salted in ((HUGE, "1"), ("0", HUGE), ("0", "0")):
        spark.conf.set(joins.BROADCAST_BYTES_CONF, broadcast)
        spark.conf.set(joins.SALTED_BYTES_CONF, salted)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = joins.lookup(facts, dim, ["k"], how)
            results.append(sorted(map(str, found.select(sorted(found.columns)).collect())))
        finally:
            for name in (joins.BROADCAST_BYTES_CONF, joins.SALTED_BYTES_CONF, "spark.sql.autoBroadcastJoinThreshold"):
                spark.conf.unset(name)
    assert results[0] == results[1] == results[2]


def test_lookup_salts_a_medium_side(spark, skewed):
    facts, dim = skewed
    spark.conf.set(joins.BROADCAST_BYTES_CONF, "0")
    spark.conf.set(joins.SALTED_BYTES_CONF, HUGE)
    try:
        plan = joins.lookup(facts, dim, ["k"])._jdf.queryExecution().optimizedPlan().toString()
        kept = joins.lookup(facts, dim, ["k"], balanced=True)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(joins.BROADCAST_BYTES_CONF)
        spark.conf.unset(joins.SALTED_BYTES_CONF)
    assert "_salt" in plan and "_salt" not in kept


def test_latest_per_key_breaks_ties_by_later_columns(spark):
    df = spark.createDataFrame(
        [("a", at(0), 1, "x"), ("a", at(5), 1, "y"), ("a", at(5), 2, "z"), ("b", None, 1, "q")],
        "k string, t timestamp, id int, v string",
    )
    found = {r["k"]: r["v"] for r in rows(joins.latest_per_key(df, ["k"], ["t", "id"]))}
    assert found == {"a": "z", "b": "q"}


def test_strict_join_picks_newest_on_both_sides(spark):
    jobs = spark.createDataFrame(
        [(1, 1, at(0), "old"), (2, 1, at(0), " "), (3, 1, at(1), "T1"), (4, 2, at(0), "T2")],
        "row_id int, r int, t timestamp, target string",
    )
    levels = spark.createDataFrame(
        [(1, 1, at(0), -50), (2, 1, at(1), -60), (3, 1, at(1), -61)], "row_id int, r int, t timestamp, level int"
    )
    found = rows(joins.strict_time_join(jobs, levels, ["r", "t"], "row_id", ["target"], ["level"]))
    assert sorted((r["target"], r["level"]) for r in found) == [(" ", -50), ("T1", -61)]


def test_overlay_replaces_with_nulls(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, x string, y int")
    patch = spark.createDataFrame([(1, None, True)], "k int, x string, z boolean")
    found = {r["k"]: r for r in rows(joins.overlay(base, patch, "k"))}
    assert found[1] == {"k": 1, "x": None, "y": 10, "z": True}
    assert found[2] == {"k": 2, "x": "b", "y": 20, "z": None}


def test_one_row(spark):
    a = spark.range(5).agg(F.count(F.lit(1)).alias("n"))
    b = spark.range(3).agg(F.max("id").alias("m"), F.min("id").alias("l"))
    assert rows(joins.one_row(a, b)) == [{"n": 5, "m": 2, "l": 0}]


def test_bridge_matches_name_or_id_once(spark):
    master = spark.createDataFrame(
        [(1, "AMR_1", " y "), (2, "2", "Y"), (3, "AMB_3", "n"), (4, "cart", "y")], "id int, name string, is_active string"
    )
    robots = scope.robot_scope(master)
    assert {(r["master_robot_id"], r["robot_type"]) for r in rows(robots)} == {(1, "AMR"), (2, "OTHER"), (4, "OTHER")}
    bridge = scope.reference_bridge(robots)
    assert sorted(r["robot_reference"] for r in rows(bridge)) == ["1", "2", "4", "AMR_1", "cart"]
    facts = spark.createDataFrame([("1",), ("AMR_1",), ("2",), ("3",)], "robot_code string")
    found = joins.attach_by_reference(facts, bridge, "robot_code")
    assert sorted(r["master_robot_id"] for r in rows(found)) == [1, 1, 2]
    assert scope.robot_scope(master, "amr").count() == 1


def test_attach_dim_with_null_key(spark):
    facts = spark.createDataFrame([(1, None), (1, 2), (None, 2)], "j int, s int")
    dim = spark.createDataFrame([(1, None, "none"), (1, 2, "two")], "job int, sub int, name string")
    found = joins.attach_dim(facts, dim, {"j": "job", "s": "sub"}, {"name": "label"}, null_key=-1)
    assert sorted((str(r["j"]), str(r["s"]), r["label"]) for r in rows(found)) == [
        ("1", "2", "two"), ("1", "None", "none"), ("None", "2", None)]


@pytest.mark.parametrize("chunk", [60, 3600, 10**9])
def test_asof_matches_brute_force(spark, chunk):
    left = [("a" if i % 4 else "b", at(i * 7 % 90), i) for i in range(60)]
    right = [("a" if i % 3 else "b", at(i * 11 % 95), i) for i in range(50)]
    left_df = spark.createDataFrame(left, "k string, t timestamp, i int")
    right_df = spark.createDataFrame(right, "k string, t timestamp, v int")
    before = {r["i"]: r["hit"] for r in rows(scan.asof_before(left_df, right_df, ["k"], "t", "t", "v", "hit",
                                                              chunk_seconds=chunk))}
    after = {r["i"]: r["hit"] for r in rows(scan.asof_after(left_df, right_df, ["k"], "t", "t", "v", "hit",
                                                            chunk_seconds=chunk))}
    for k, t, i in left:
        earlier = [(rt, v) for rk, rt, v in right if rk == k and rt < t]
        later = [(rt, v) for rk, rt, v in right if rk == k and rt >= t]
        last = max((rt for rt, _ in earlier), default=None)
        first = min((rt for rt, _ in later), default=None)
        assert before[i] == max((v for rt, v in earlier if rt == last), default=None)
        assert after[i] == max((v for rt, v in later if rt == first), default=None)


@pytest.mark.parametrize("chunk", [30, 600, 10**9])
def test_neighbours_cross_chunks(spark, chunk):
    times = sorted({(i * i * 13) % 4000 for i in range(80)})
    df = spark.createDataFrame([("a", at(0) + timedelta(seconds=s), s) for s in times], "k string, t timestamp, s int")
    found = scan.with_neighbours(df, ["k"], "t", following={"nxt": "s"}, preceding={"prv": "s"}, key_max={"top": "s"},
                                 chunk_seconds=chunk)
    got = {r["s"]: (r["prv"], r["nxt"], r["top"]) for r in rows(found)}
    for i, s in enumerate(times):
        assert got[s] == (times[i - 1] if i else None, times[i + 1] if i + 1 < len(times) else None, times[-1])


def test_exact_ratios(spark):
    df = spark.createDataFrame([(1, 3), (-1, 3), (1, 8), (-5, 1000), (5, 0), (7, None)], "a long, b long")
    found = df.select(S.ratio("a", "b", 2).alias("r"), S.percent("a", "b").alias("p")).collect()
    assert [None if r.r is None else float(r.r) for r in found] == [0.33, -0.33, 0.13, -0.01, None, None]
    assert float(found[0].p) == 33.33 and found[4].p is None


def test_natural_order(spark):
    df = spark.createDataFrame([("LM10",), ("lm9",), ("LM1",), ("A",)], "n string")
    assert [r.n for r in df.orderBy(*S.natural_key("n")).collect()] == ["A", "LM1", "lm9", "LM10"]


def test_asof_with_null_keys_and_values(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, None, at(10)), (3, "b", at(10)), (4, "a", at(700))], "id int, k string, t timestamp")
    right = spark.createDataFrame(
        [("a", at(1), 5), ("a", at(2), None), (None, at(3), 9), ("b", at(20), 7), ("a", None, 8)], "k string, at timestamp, v int"
    )
    for chunk in (60, 3600, 86400):
        found = {r["id"]: r["v2"] for r in rows(scan.asof_before(left, right, ["k"], "t", "at", "v", "v2", chunk_seconds=chunk))}
        assert found == {1: None, 2: None, 3: None, 4: None}
        kept = scan.asof_before(left, right, ["k"], "t", "at", "v", "v2", chunk_seconds=chunk, ignore_nulls=True)
        assert {r["id"]: r["v2"] for r in rows(kept)} == {1: 5, 2: None, 3: None, 4: 5}
        ahead = {r["id"]: r["v2"] for r in rows(scan.asof_after(left, right, ["k"], "t", "at", "v", "v2", chunk_seconds=chunk))}
        assert ahead == {1: None, 2: None, 3: 7, 4: None}


def test_latest_row_without_a_time_is_still_a_row(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", at(1), 2), ("b", None, 3)], "k string, t timestamp, v int")
    assert {r["k"]: r["v"] for r in rows(joins.latest_per_key(df, ["k"], ["t"], ["v"]))} == {"a": 1, "b": 2}


def test_sessions_in_other_zones_are_refused(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="time zone"):
            to_model(spark.range(1), "etl_batch")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.fixture(scope="module")
def many_robots(spark, tmp_path_factory):
    """A master of some MB whose rows, with two references each, hold tens of MB."""
    path = str(tmp_path_factory.mktemp("many") / "master")
    robots = spark.range(600_000).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("AMR_"), F.col("id").cast("string")).alias("name"),
        F.lit(" y ").alias("is_active"),
    )
    robots.coalesce(1).write.parquet(path)
    return prepare(spark).read.parquet(path)


def test_a_file_of_some_mb_is_not_broadcast(spark, many_robots):
    robots = scope.robot_scope(many_robots)
    facts = spark.range(10).select(F.col("id").cast("string").alias("robot_code"), F.col("id").alias("t"))
    plans = [
        scope.in_scope(facts, scope.reference_bridge(robots)),
        joins.attach_by_reference(facts, scope.reference_bridge(robots), "robot_code"),
        joins.attach_dim(facts, robots, {"t": "master_robot_id"}, {"robot_type": "robot_type"}),
    ]
    assert [len(rows(plan)) for plan in plans] == [10, 10, 10]
    for plan in plans:
        assert "rightHint=(strategy=broadcast)" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_aggregates_by_reference_are_joined_plainly(spark, skewed):
    facts, dim = skewed
    spark.conf.set(joins.BROADCAST_BYTES_CONF, "0")
    spark.conf.set(joins.SALTED_BYTES_CONF, HUGE)
    try:
        counted = facts.groupBy("k").agg(F.sum("v").alias("v"))
        found = [joins.attach_dim(counted, dim, {"k": "k"}, {"name": "name"}, balanced=True), joins.overlay(counted, dim, "k")]
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in found]
    finally:
        spark.conf.unset(joins.BROADCAST_BYTES_CONF)
        spark.conf.unset(joins.SALTED_BYTES_CONF)
    assert not [plan for plan in plans if "_salt" in plan or "strategy=broadcast" in plan]


def test_a_larger_side_is_not_copied(spark, many_robots):
    records = many_robots.select("id", F.col("name").alias("label"))
    facts = spark.range(10).select(F.col("id").cast("int").alias("id"))
    spark.conf.set(joins.BROADCAST_BYTES_CONF, "0")
    try:
        found = joins.lookup(facts, records, ["id"], "inner")
    finally:
        spark.conf.unset(joins.BROADCAST_BYTES_CONF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and len(rows(found)) == 10


@pytest.mark.parametrize("text, found", [("10485760b", 10 << 20), ("256k", 256 << 10), ("1MB", 1 << 20), ("2g", 2 << 30), ("-1", -1)])
def test_lookup_broadcasts_no_more_than_the_session_may(spark, skewed, text, found):
    facts, dim = skewed[0], spark.range(8).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    try:
        assert joins.broadcast_limit(spark) == min(found, joins.DEFAULT_BROADCAST_BYTES)
        plan = joins.lookup(facts, dim, ["k"])._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.set(joins.BROADCAST_BYTES_CONF, "7")
        assert joins.broadcast_limit(spark) == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(joins.BROADCAST_BYTES_CONF)
    assert ("strategy=broadcast" in plan) == (found > 0)


ROBOT_QUERIES = (
    "alert_groups", "battery_share_ranking", "dashboard_diagnostics", "diagnostic_groups", "fleet_assessment",
    "fleet_assessment_every_rule", "fleet_kpis", "freshness_distribution", "freshness_donut", "freshness_gate",
    "latest_per_key", "measurement_gaps", "offline_ids", "on_time_ranking", "operational_metrics", "overlay_robots",
    "project_robot_scope", "queue_wait_ranking", "robot_diagnosis", "status_coverage", "wifi_robot_rows",
    "workload_assessment",
)


@pytest.mark.parametrize("name", ROBOT_QUERIES)
def test_queries_by_robot_send_no_table_beyond_the_limit(spark, data_dir, monkeypatch, name):
    """Broadcasts are built on the driver: what a query asks for stays within the session's limit."""
    sent, plain = [], joins.F
    recorder = SimpleNamespace(**{**vars(plain), "broadcast": lambda df: sent.append(joins.plan_bytes(df)) or plain.broadcast(df)})
    monkeypatch.setattr(joins, "F", recorder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        registered(name)(spark, data_dir)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sent, default=0) <= 1024
