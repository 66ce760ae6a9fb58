from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketebb import schemas
from marketebb.operators import hourly, snapshots
from marketebb.operators import transitions as T
from marketebb.session import stage
from marketebb.sources import driver, readers, sinks
from marketebb.streaming import flow, listing_state, task_state
from tests.conftest import OBS, SF, at, rows
from tests.test_transitions import random_observations

EPOCH = datetime(1970, 1, 1)


def message(ip, task, when, items, error=None):
    """A message as it comes: 64-bit numbers as text, zero fields missing; ``when`` is Tokyo time."""
    doc = {"ipId": str(ip), "taskId": task, "crawledAt": str(int((when - timedelta(hours=9) - EPOCH).total_seconds()))}
    if error:
        doc["errorMessage"] = error
    if items:
        doc["items"] = [
            {"sourceId": s, "price": p, **({"status": "ITEM_STATUS_SOLD"} if status == "sold" else {})}
            for s, status, p in items
        ]
    return json.dumps(doc)


def test_messages(spark, tmp_path):
    when = datetime(2024, 1, 15, 18, 30)
    (tmp_path / "m.json").write_text(
        "\n".join(
            [
                message(7, "t1", when, [("m1", "available", 10), ("m2", "sold", 0), ("", "sold", 5)]),
                message(7, "t2", when, [("m3", "sold", 5)], "net::ERR"),
                message(8, "t3", when, [], "no_items"),
            ]
        )
    )
    results = readers.crawl_results(spark, str(tmp_path))
    assert rows(readers.usable(results), "ip_id", "task_id", "crawl_ts") == [(7, "t1", when), (8, "t3", when)]
    assert rows(readers.observations(results), "pos", "source_id", "status", "price", "title") == [
        (0, "m1", "available", 10, ""),
        (1, "m2", "sold", 0, ""),
    ]
    as_text = spark.read.text(str(tmp_path))
    assert rows(readers.crawl_results_from_text(as_text), "task_id") == [("t1",), ("t2",), ("t3",)]


def test_task_and_seed_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "t.json").write_text('{"ipId":"5","taskId":"a","createdAt":"1705311000"}\n')
    assert rows(readers.task_events(spark, str(tmp_path / "t")), "task_id", "ip_id", "event", "ts", "retry_count") == [
        ("a", 5, "pushed", datetime(2024, 1, 15, 18, 30), 0)
    ]
    (tmp_path / "seed.json").write_text('{"ips": [\n {"name": "A", "tags": ["x"]},\n {"name": "B", "weight": 2.5}\n]}')
    assert rows(readers.seed_entries(spark, str(tmp_path / "seed.json")), "pos", "name", "tags", "weight") == [
        (0, "A", ["x"], None),
        (1, "B", None, 2.5),
    ]


def test_json_columns(spark):
    df = spark.createDataFrame([(1, '["a","b"]'), (2, None), (3, "not json")], "id int, tags string")
    got = df.select("id", readers.tags_from_json(F.col("tags")).alias("t"), readers.bad_tags(F.col("tags")).alias("bad"))
    assert rows(got, "id", "t", "bad") == [(1, ["a", "b"], False), (2, None, False), (3, None, True)]
    back = got.select(readers.tags_to_json(F.col("t")).alias("j"))
    assert rows(back, "j") == [('["a","b"]',), ("[]",), ("[]",)]
    item = spark.createDataFrame([('{"source_id":"m1","price":5}',), ('{"source_id":"","price":5}',)], "j string")
    again = item.select(readers.item_to_json(readers.item_from_json(F.col("j"))).alias("j"))
    assert rows(again, "j") == [('{"source_id":"m1","price":5}',), (None,)]


def test_tables_keep_their_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5), 3, 1, 0.33333)], "ip_id long, hour_bucket timestamp_ntz, inflow long, outflow long, liquidity_index double")
    stored = sinks.conform(df, schemas.HOURS)
    stored.write.parquet(str(tmp_path / "ip_stats_hourly"))
    back = readers.table(spark, str(tmp_path), "ip_stats_hourly")
    assert back.schema == stored.schema
    assert str(back.first()["liquidity_index"]) == "0.3333" and back.first()["min_item"] is None
    with pytest.raises(ValueError):
        readers.jdbc_table(spark, "jdbc:x", "unknown")


def test_partition_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    sinks.overwrite_partitions(one, path, ["p"])
    sinks.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path), "v", "p") == [(1, "a"), (9, "b")]

    def add(old, new):
        return old.unionByName(new).groupBy("p").agg(F.sum("v").cast("int").alias("v")).select("v", "p")

    sinks.merge_partitions(spark.createDataFrame([(5, "b"), (7, "c")], "v int, p string"), path, ["p"], add)
    assert rows(spark.read.parquet(path), "v", "p") == [(1, "a"), (14, "b"), (7, "c")]
    one_part = spark.createDataFrame([(5, "b")], "v int, p string")
    scan = sinks.touched(spark.read.parquet(path), one_part, ["p"])
    assert rows(scan, "v", "p") == [(14, "b")]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "Subquery" in plan
    batches = str(tmp_path / "b")
    for _ in range(2):
        sinks.write_batch(one, batches, 3)
    assert spark.read.parquet(batches).count() == 2
    sinks.append(one, str(tmp_path / "a"))
    sinks.append(one, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert stage(one, "x").count() == 2


def whole_crawl_files(spark, data, folder, parts):
    """Observations as files in order of time, no crawl divided between two."""
    times_ = sorted({r[4] for r in data})
    size = -(-len(times_) // parts)
    for i in range(parts):
        chosen = set(times_[i * size : (i + 1) * size])
        df = spark.createDataFrame([r for r in data if r[4] in chosen], OBS)
        df.coalesce(1).write.mode("append").parquet(str(folder))


def obs_stream(spark, folder, per_trigger=1):
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


def test_state_stream_equals_batch(spark, tmp_path):
    data = random_observations(11, 600)
    whole_crawl_files(spark, data, tmp_path / "in", 3)
    query = (
        listing_state.transition_stream(obs_stream(spark, tmp_path / "in"))
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("late").count() == 0
    counted = got.groupBy("ip_id", "source_id", "crawl_ts", "status", "price", "kind", "prev_price").agg(
        F.count(F.lit(1)).alias("copies")
    )
    columns = ("ip_id", "source_id", "crawl_ts", "status", "price", "kind", "prev_price", "copies")
    moved = T.transitions(spark.createDataFrame(data, OBS))
    assert rows(counted, *columns) == rows(moved, *columns)
    # no time to live has passed, so every listing is still remembered
    known = listing_state.stored_state(spark, str(tmp_path / "cp"))
    columns = ("ip_id", "source_id", "status", "price", "last_seen")
    assert rows(known, *columns) == rows(T.state_table(moved), *columns)


def test_a_bucket_of_listings_is_one_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing_state, "BUCKETS", 2)
    data = random_observations(13, 300)
    whole_crawl_files(spark, data, tmp_path / "in", 2)
    run_stream(listing_state.transition_stream(obs_stream(spark, tmp_path / "in")), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    moved = T.transitions(spark.createDataFrame(data, OBS))
    columns = ("ip_id", "source_id", "crawl_ts", "status", "price", "kind", "prev_status", "prev_price")
    assert sorted(set(rows(got, *columns)), key=str) == rows(moved, *columns)
    # the store holds one record for each bucket, not for each listing
    stored = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "out-cp"))
    known = listing_state.stored_state(spark, str(tmp_path / "out-cp"))
    assert stored.count() == 2 < known.count()
    columns = ("ip_id", "source_id", "status", "price", "last_seen")
    assert rows(known, *columns) == rows(T.state_table(moved), *columns)


def test_late_sightings_come_out_marked(spark, tmp_path):
    for i, times_ in enumerate([["02 12:00"], ["02 06:00", "02 13:00"], ["02 01:00"]]):
        df = spark.createDataFrame([(1, "a", "available", 5, at(ts), i) for ts in times_], OBS)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_stream(listing_state.transition_stream(obs_stream(spark, tmp_path / "in")), tmp_path, "out")
    got = rows(spark.read.parquet(str(tmp_path / "out")), "crawl_ts", "late")
    assert sorted(got) == [(at("02 01:00"), True), (at("02 06:00"), True), (at("02 12:00"), False), (at("02 13:00"), False)]


def test_late_task_events_and_messages_come_out(spark, tmp_path):
    t0 = datetime(2024, 1, 2, 10)
    schema = "task_id string, ip_id long, node string, event string, ts timestamp_ntz, retry_count int, seq long"
    for i, (task, ip, hour) in enumerate([("a", 1, 10), ("b", 2, 3), ("c", 1, 2)]):
        spark.createDataFrame([(task, ip, "n", "pushed", t0 + timedelta(hours=hour), 0, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(task_state.push_gate(stream), tmp_path, "gate")
    assert rows(spark.read.parquet(str(tmp_path / "gate")), "task_id", "accepted", "late") == [("a", True, False), ("b", True, False), ("c", None, True)]

    folder, root, when = tmp_path / "messages", str(tmp_path / "root"), datetime(2024, 1, 15, 12)
    folder.mkdir()
    for i, (task, ip, days) in enumerate([("t1", 1, 0), ("t2", 2, -2), ("t3", 3, -2), ("t2", 2, -2)]):
        (folder / f"{i}.json").write_text(message(ip, task, when + timedelta(days=days), [("m1", "available", 10)]))
        flow.start(readers.crawl_results(spark, str(folder), streaming=True, max_files=1), root, str(tmp_path / "cp")).awaitTermination()
    assert rows(flow.hours(spark, root), "ip_id", "hour_bucket") == [(1, when), (2, when - timedelta(days=2)), (3, when - timedelta(days=2))]


def test_write_path_equals_batch_with_a_restart(spark, tmp_path):
    data = random_observations(12, 500)
    folder, root, cp = tmp_path / "in", str(tmp_path / "root"), str(tmp_path / "cp")
    cut = sorted({r[4] for r in data})[len({r[4] for r in data}) // 2]
    entities = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, weight double")
    for half in ([r for r in data if r[4] < cut], [r for r in data if r[4] >= cut]):
        whole_crawl_files(spark, half, folder, 1)
        flow.start_on_observations(obs_stream(spark, folder), root, cp, entities=entities).awaitTermination()
    whole = spark.createDataFrame(data, OBS)
    moved = T.transitions(whole)
    expected = hourly.hourly(T.crawl_flow(moved), hourly.sold_sample(moved))
    columns = ("ip_id", "hour_bucket", "inflow", "outflow", "avg_price", "median_price", "min_price", "sample_count")
    assert rows(flow.hours(spark, root), *columns) == rows(sinks.conform(expected, schemas.HOURS), *columns)
    snap = ("ip_id", "source_id", "price", "status", "first_seen_at", "sold_at", "price_changed")
    assert rows(flow.snapshots(spark, root), *snap) == rows(snapshots.snapshot_delta(whole), *snap)
    assert not sinks.exists(spark, f"{root}/late/batch_id=0") and not sinks.exists(spark, f"{root}/late/batch_id=1")
    # a batch that is run again leaves everything as it was
    before = rows(flow.hours(spark, root), *columns)
    second = spark.createDataFrame([r for r in data if r[4] >= cut], OBS)
    flow.process(second, None, 1, root, entities)
    assert rows(flow.hours(spark, root), *columns) == before
    # sightings older than the known state go to the side table and change nothing
    flow.process(spark.createDataFrame([r for r in data if r[4] < cut][:20], OBS), None, 2, root, entities)
    assert spark.read.parquet(f"{root}/late").count() == 20
    assert rows(flow.hours(spark, root), *columns) == before
    assert {r.reason for r in spark.read.parquet(f"{root}/late").collect()} == {"late"}
    for name in ("ip_stats_hourly", "ip_alerts", "item_snapshots", "schedule"):
        assert readers.table(spark, root, name).schema.simpleString() == sinks.conform(spark.range(0), schemas.TABLES[name]).schema.simpleString()


def files_of(root, table):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.joinpath(table).rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root, layout = tmp_path / "root", flow.Layout(4, 4)
    data = [(ip, f"m{i}", "available", 100 + i, at("02 06:00"), i) for ip in range(6) for i in range(30)]
    entities = spark.createDataFrame([(i, 1.0) for i in range(6)], "id long, weight double")

    def run(rows_, batch):
        flow.process(spark.createDataFrame(rows_, OBS), None, batch, str(root), entities, layout=layout)

    run(data, 0)
    second = [(3, "m1", "sold", 90, at("02 12:00"), 0), (3, "new", "available", 5, at("02 12:00"), 1)]
    before = {t: files_of(root, t) for t in ("state", "item_snapshots", "schedule")}
    run(second, 1)
    touched = {r.b for r in spark.createDataFrame([(3, "m1"), (3, "new")], "ip_id long, source_id string").select(layout.listing().alias("b")).collect()}
    for table in ("state", "item_snapshots"):
        after = files_of(root, table)
        assert {int(p.split("bucket=")[1].split("/")[0]) for p, _ in set(before[table].items()) ^ set(after.items())} == touched
    assert len({p.split("/")[1] for p, _ in set(before["schedule"].items()) ^ set(files_of(root, "schedule").items())}) == 1

    tables = ("ip_id", "source_id", "status", "price", "first_seen", "last_seen", "expires_at")
    known = rows(flow.state(spark, str(root)), *tables)
    whole = T.transitions(spark.createDataFrame(data + second, OBS))
    assert known == rows(T.state_table(whole), *tables)
    kept = {t: rows(readers.table(spark, str(root), t), "ip_id") for t in ("ip_stats_hourly", "ip_alerts", "item_snapshots")}
    run(second, 1)  # again, as after a failure: the state is as before it
    assert rows(flow.state(spark, str(root)), *tables) == known
    assert {t: rows(readers.table(spark, str(root), t), "ip_id") for t in kept} == kept
    assert rows(flow.hours(spark, str(root)).filter("hour_bucket = '2024-01-02 12:00'"), "inflow", "outflow") == [(1, 1)]
    # listings that no batch has seen for longer than their time go when their bucket is next rewritten
    run([(3, "new", "available", 6, at("05 12:00"), 0)], 2)
    left = {r.source_id for r in flow.state(spark, str(root)).filter("ip_id = 3").collect()}
    same_bucket = {r.source_id for r in spark.createDataFrame([(3, f"m{i}") for i in range(30)], "ip_id long, source_id string").select("source_id", layout.listing().alias("b")).collect() if r.b in {x.b for x in spark.createDataFrame([(3, "new")], "ip_id long, source_id string").select(layout.listing().alias("b")).collect()}}
    assert left == {"new", *(f"m{i}" for i in range(30))} - same_bucket


def test_messages_from_the_future_are_set_aside(spark, tmp_path):
    when = datetime(2024, 1, 15, 12)
    folder, root = tmp_path / "in", str(tmp_path / "root")
    folder.mkdir()
    lots = [[(1, "t1", when + timedelta(days=30))], [(1, "t2", when), (1, "", when)], [(1, "", when + timedelta(hours=1))]]
    for i, lot in enumerate(lots):
        (folder / f"{i}.json").write_text("\n".join(message(ip, task, t, [(f"m{i}", "available", 10)]) for ip, task, t in lot))
        flow.start(readers.crawl_results(spark, str(folder), streaming=True, max_files=1), root, str(tmp_path / "cp"), now=when + timedelta(days=1)).awaitTermination()
    assert rows(spark.read.parquet(f"{root}/late"), "source_id", "reason") == [("m0", "ahead")]
    assert rows(flow.hours(spark, root), "hour_bucket") == [(when,), (when + timedelta(hours=1),)]
    assert rows(spark.read.parquet(f"{root}/messages"), "task_id", "fate") == [("", "taken"), ("", "taken"), ("t1", "taken"), ("t2", "taken")]


def test_message_stream_takes_each_task_once(spark, tmp_path):
    when = datetime(2024, 1, 15, 12)
    folder, root = tmp_path / "in", str(tmp_path / "root")
    folder.mkdir()
    first = message(1, "t1", when, [("m1", "available", 10)])
    (folder / "a.json").write_text("\n".join([first, first, message(1, "t2", when + timedelta(hours=1), [("m2", "sold", 30)])]))
    results = readers.crawl_results(spark, str(folder), streaming=True, max_files=1)
    flow.start(results, root, str(tmp_path / "cp")).awaitTermination()
    (folder / "b.json").write_text("\n".join([first, message(1, "t3", when + timedelta(hours=2), [], "no_items")]))
    flow.start(results, root, str(tmp_path / "cp")).awaitTermination()
    got = rows(flow.hours(spark, root), "hour_bucket", "inflow", "outflow", "sample_count")
    assert got == [(when, 0, 0, 0), (when + timedelta(hours=1), 0, 1, 1), (when + timedelta(hours=2), 0, 0, 0)]


def run_stream(df, tmp_path, name):
    query = (
        df.writeStream.format("parquet")
        .option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def test_messages_are_judged_without_their_items(spark, tmp_path, monkeypatch):
    wide = []

    def noted(df, label):
        if "items" in df.columns:
            wide.append(label)
        return stage(df, label)

    monkeypatch.setattr(flow, "stage", noted)
    folder, when = tmp_path / "messages", datetime(2024, 1, 15, 12)
    folder.mkdir()
    for i, task in enumerate(["t1", "t2", "t1"]):
        (folder / f"{i}.json").write_text(message(1, task, when, [("m1", "available", 10)]))
    got = flow.judged(readers.crawl_results(spark, str(folder)), str(tmp_path / "root"), 0)
    assert rows(got, "task_id", "fate") == [("t1", "repeat"), ("t1", "taken"), ("t2", "taken")]
    assert [len(r["items"]) for r in got.collect()] == [1, 1, 1]
    # the items are written once, before the messages are judged
    assert wide == ["results"]


def test_task_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 2, 10)
    schema = "task_id string, ip_id long, node string, event string, ts timestamp_ntz, retry_count int, seq long"
    batches = [
        [("a", 1, "pushed", 0), ("b", 1, "pushed", 1), ("a", 1, "started", 2), ("x", 2, "pushed", 2), ("x", 2, "started", 3)],
        [("a", 1, "acked", 4), ("c", 1, "pushed", 5)],
        [("z", 3, "pushed", 300)],
        [("z2", 4, "pushed", 301)],
    ]
    seq = 0
    for batch in batches:
        data = []
        for t, ip, e, m in batch:
            data.append((t, ip, f"n{ip}", e, t0 + timedelta(minutes=m), 3 if t == "x" else 0, seq))
            seq += 1
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(task_state.push_gate(stream), tmp_path, "gate")
    got = dict(rows(spark.read.parquet(str(tmp_path / "gate")), "task_id", "accepted"))
    assert got == {"a": True, "b": False, "c": True, "x": True, "z": True, "z2": True}
    run_stream(task_state.stuck_task_stream(stream, timeout_s=1800), tmp_path, "stuck")
    stuck = spark.read.parquet(str(tmp_path / "stuck"))
    assert rows(stuck, "task_id", "retry_count", "outcome") == [("x", 4, "dead")]


def test_block_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 2, 10)
    schema = "node string, task_id long, ts timestamp_ntz, outcome string"
    b, s = "403_forbidden", "success"
    for batch in [[(0, b), (1, b)], [(2, b), (3, s), (4, b)], [(30, b)]]:
        data = [("n", m, t0 + timedelta(minutes=m), o) for m, o in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(task_state.block_streak_stream(stream), tmp_path, "out")
    got = rows(spark.read.parquet(str(tmp_path / "out")), "task_id", "streak", "cooldown")
    assert got == [(0, 1, False), (1, 2, False), (2, 3, True), (30, 1, False), (4, 1, False)]


def test_driver_views_have_the_shape_of_the_domain(spark):
    seen = driver.observations(spark, SF)
    assert [f.simpleString() for f in seen.schema] == [
        "ip_id:bigint", "source_id:string", "status:string", "price:int", "crawl_ts:timestamp_ntz", "pos:bigint",
    ]
    assert seen.count() == spark.read.parquet(f"{SF}/events.parquet").count()
