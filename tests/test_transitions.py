from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketebb.operators import transitions as T
from tests.conftest import OBS, rows


def kinds(df):
    return rows(T.transitions(df).filter("kind IS NOT NULL"), "source_id", "kind", "prev_price", "price")


@pytest.mark.parametrize(
    ("before", "now", "expected"),
    [
        (None, ("available", 1000), ("new_listing", None)),
        (None, ("sold", 3000), ("new_sold", None)),
        (("available", 1000), ("sold", 1000), ("sold", 1000)),
        (("available", 1000), ("available", 900), ("price_change", 1000)),
        (("available", 1000), ("available", 1000), (None, 1000)),
        (("sold", 1000), ("available", 1000), ("relisted", 1000)),
        (("sold", 1000), ("sold", 1000), (None, 1000)),
    ],
)
def test_single_transition(observe, before, now, expected):
    data = [(1, "m1", *before, "02 00:00")] if before else []
    out = T.transitions(observe(*data, (1, "m1", *now, "02 06:00"))).filter("crawl_ts = '2024-01-02 06:00:00'")
    assert rows(out, "kind", "prev_price") == [expected]


def test_batch_and_empty_ids(observe):
    df = observe(
        (1, "m001", "available", 1000, "02 00:00"),
        (1, "m002", "available", 2000, "02 00:00"),
        (1, "m003", "sold", 3000, "02 00:00"),
        (1, "", "sold", 3000, "02 00:00"),
    )
    assert [k[1] for k in kinds(df)] == ["new_listing", "new_listing", "new_sold"]


@pytest.mark.parametrize(
    ("first", "second", "when", "expected"),
    [
        ("available", "available", "03 00:00:00", "new_listing"),  # gone exactly at its time to live
        ("available", "available", "02 23:59:59", None),
        ("sold", "sold", "03 23:00:00", None),
        ("sold", "sold", "04 00:00:00", "new_sold"),
    ],
)
def test_expiry_edge(observe, first, second, when, expected):
    df = observe((1, "m", first, 5, "02 00:00:00"), (1, "m", second, 5, when))
    last = T.transitions(df).orderBy(F.desc("crawl_ts")).first()
    assert last["kind"] == expected


def test_ttl_follows_the_new_status(observe):
    df = observe(
        (1, "m", "sold", 5, "02 00:00"), (1, "m", "available", 5, "02 01:00"), (1, "m", "available", 5, "03 02:00")
    )
    assert [r["kind"] for r in T.transitions(df).orderBy("crawl_ts").collect()] == ["new_sold", "relisted", "new_listing"]


def test_two_sightings_of_one_crawl_compare_with_the_state_before_it(observe):
    df = observe(
        (1, "m", "available", 7, "02 00:00"),
        (1, "m", "sold", 7, "02 00:00"),
        (1, "m", "available", 7, "02 06:00"),
    )
    out = T.transitions(df)
    assert [k[1] for k in kinds(df)] == ["new_listing", "new_sold", "relisted"]
    closing = out.filter("is_close AND crawl_ts = '2024-01-02 00:00:00'").first()
    assert closing["status"] == "sold"
    assert {r["close_price"] for r in out.collect()} == {7}


def test_copies_are_counted_not_repeated(observe):
    df = observe(*[(1, "m", "available", 7, "02 00:00")] * 5)
    out = T.transitions(df).collect()
    assert len(out) == 1 and out[0]["copies"] == 5
    assert T.crawl_flow(T.transitions(df)).first()["new_listings"] == 5


def test_summary(observe):
    seen = [(1, f"p{i}", "available", 10, "02 00:00") for i in range(3)]
    seen += [(1, "s", "available", 5, "02 00:00"), (1, "r", "sold", 5, "02 00:00")]
    seen += [(1, f"p{i}", "available", 11, "02 06:00") for i in range(3)]
    seen += [(1, "s", "sold", 5, "02 06:00"), (1, "r", "available", 5, "02 06:00")]
    seen += [(1, f"n{i}", "available", 9, "02 06:00") for i in range(2)]
    flow = T.crawl_flow(T.transitions(observe(*seen))).filter("crawl_ts > '2024-01-02 00:00:00'").first()
    assert (flow["new_listings"], flow["sold"], flow["price_changes"], flow["relisted"]) == (2, 1, 3, 1)
    assert (flow["first_crawl"], flow["inflow"], flow["outflow"]) == (False, 2, 1)


def test_first_crawl_and_return_after_silence(observe):
    df = observe(
        *[(1, f"a{i}", "available", 5, "02 00:00") for i in range(3)],
        *[(1, f"s{i}", "sold", 5, "02 00:00") for i in range(2)],
        (1, "a0", "available", 5, "02 12:00"),
        (1, "a0", "available", 5, "06 12:00"),
    )
    flow = T.crawl_flow(T.transitions(df)).orderBy("crawl_ts").collect()
    assert [r["first_crawl"] for r in flow] == [True, False, True]
    assert [(r["inflow"], r["outflow"]) for r in flow] == [(0, 0), (0, 0), (0, 0)]


def test_relisting_shortens_the_life_of_an_entity(observe):
    # sold at 00:00 would live to the 4th; relisted at 01:00 it lives to the 3rd 01:00 only
    df = observe(
        (1, "m", "sold", 5, "02 00:00"), (1, "m", "available", 5, "02 01:00"), (1, "x", "available", 5, "03 06:00")
    )
    flow = T.crawl_flow(T.transitions(df)).orderBy("crawl_ts").collect()
    assert [r["first_crawl"] for r in flow] == [True, False, True]


def test_crawls_that_saw_nothing(observe, spark):
    df = observe((1, "m", "available", 5, "02 00:00"))
    crawls = spark.createDataFrame(
        [(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 2, 6)), (2, datetime(2024, 1, 2))], "ip_id long, crawl_ts timestamp_ntz"
    )
    out = rows(T.crawl_flow(T.transitions(df), crawls), "ip_id", "observed", "first_crawl")
    assert out == [(1, 0, False), (1, 1, True), (2, 0, True)]


def simulate(data):
    """Plain sequential replay: crawl by crawl, state as a dict with expiry."""
    ttl = {"available": timedelta(hours=24), "sold": timedelta(hours=48)}
    state, crawls, out, first = {}, {}, [], {}
    for r in data:
        crawls.setdefault((r[4], r[0]), []).append(r)
    for (ts, ip), items in sorted(crawls.items()):
        alive = {k for k, (s, p, seen) in state.items() if ts < seen + ttl[s]}
        first[(ip, ts)] = not any(k[0] == ip for k in alive)
        new = {}
        for _, source, status, price, _, pos in sorted(items, key=lambda x: x[5]):
            key = (ip, source)
            old = state[key][:2] if key in alive else None
            if old is None:
                kind = "new_sold" if status == "sold" else "new_listing"
            elif old[0] != status:
                kind = "sold" if status == "sold" else "relisted"
            else:
                kind = "price_change" if status == "available" and old[1] != price else None
            out.append((ip, source, ts, status, price, kind))
            new[key] = (status, price, ts)
        state.update(new)
    return out, first


def random_observations(seed, n=1500):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    data = []
    for pos in range(n):
        ip = 0 if rng.random() < 0.4 else rng.randrange(4)
        source = "hot" if rng.random() < 0.35 else f"m{rng.randrange(12)}"
        ts = start + timedelta(hours=rng.choice([1, 5, 6]) * rng.randrange(120))
        data.append((ip, source, rng.choice(["available", "available", "sold"]), rng.randrange(1, 5), ts, pos))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sequential_replay_with_a_hot_listing(spark, seed):
    data = random_observations(seed)
    expected, first = simulate(data)
    out = T.transitions(spark.createDataFrame(data, OBS))
    counted = {}
    for e in expected:
        counted[e] = counted.get(e, 0) + 1
    got = {
        (r["ip_id"], r["source_id"], r["crawl_ts"], r["status"], r["price"], r["kind"]): r["copies"] for r in out.collect()
    }
    assert got == counted
    flow = {(r["ip_id"], r["crawl_ts"]): r["first_crawl"] for r in T.crawl_flow(out).collect()}
    assert flow == first


def test_instalments_equal_one_run(spark):
    data = random_observations(3, 800)
    whole = T.crawl_flow(T.transitions(spark.createDataFrame(data, OBS)))
    cut = datetime(2024, 1, 9)
    early = T.transitions(spark.createDataFrame([r for r in data if r[4] < cut], OBS))
    state = T.state_table(early)
    late = T.transitions(spark.createDataFrame([r for r in data if r[4] >= cut], OBS), state)
    columns = ("ip_id", "crawl_ts", "first_crawl", "inflow", "outflow", "price_changes", "relisted")
    assert rows(T.crawl_flow(early), *columns) + rows(T.crawl_flow(late), *columns) == sorted(
        rows(whole, *columns), key=lambda r: (r[1] >= cut, str(r))
    )
    # the look-up table is the same too, up to listings that had expired before the cut
    all_at_once = T.state_table(T.transitions(spark.createDataFrame(data, OBS)))
    assert rows(T.state_table(late), "ip_id", "source_id", "status", "price", "first_seen", "expires_at") == rows(
        all_at_once, "ip_id", "source_id", "status", "price", "first_seen", "expires_at"
    )


def test_first_seen_survives_updates_and_restarts(observe):
    df = observe(
        (1, "m", "available", 5, "02 00:00"), (1, "m", "available", 6, "02 12:00"), (1, "m", "available", 6, "05 00:00")
    )
    seen = [str(r["first_seen"]) for r in T.first_seen(T.transitions(df)).orderBy("crawl_ts").collect()]
    assert seen == ["2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-05 00:00:00"]


def test_live_items_and_forget(observe, spark):
    df = observe(
        (1, "a", "available", 5, "02 00:00"), (1, "b", "sold", 5, "02 00:00"), (2, "c", "available", 5, "02 12:00")
    )
    state = T.state_table(T.transitions(df))
    assert rows(T.live_items(state, "2024-01-03 00:00:00"), "ip_id", "live_items") == [(1, 1), (2, 1)]
    gone = spark.createDataFrame([(1,)], "ip_id long")
    assert rows(T.forget(state, gone), "source_id") == [("c",)]
    one = spark.createDataFrame([(1, "a")], "ip_id long, source_id string")
    assert rows(T.forget(state, listings=one), "source_id") == [("b",), ("c",)]
