"""Queries that once read a part of their tables read them whole."""

import math
from collections import defaultdict

from frond.plans import ordered, registry

SMALL = "/root/testdata/sf0.001"


def test_turning_angles_of_every_user(spark):
    events = [r for r in spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_id", "user_id", "ts", "unix_micros(cast(ts as timestamp)) / 1e9 as x", "value as y").collect()]
    paths = defaultdict(list)
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        paths[r.user_id].append(r)
    want = {}
    for p in paths.values():
        for i, r in enumerate(p):
            want[r.event_id] = None
            if 2 <= i < len(p) - 2:
                a, b = (r.x - p[i - 2].x, r.y - p[i - 2].y), (p[i + 2].x - r.x, p[i + 2].y - r.y)
                want[r.event_id] = math.atan2(a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1])
    got = {r.event_id: r.turn for r in registry.QUERIES["turning_angles"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and len({r.user_id for r in events if r.user_id % 20 != 1}) > 1
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 2e-5) for k, v in want.items())


def test_every_event_and_size(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    assert registry.QUERIES["exif_order"](spark, SMALL).count() == read("events").count()
    assert registry.QUERIES["angular_gaps"](spark, SMALL).count() == read("part").select("p_type", "p_size").distinct().count()
    part = spark.createDataFrame([("a", 1), ("a", 6), ("a", 7)], "p_type string, p_size long")
    assert sorted((r.angle, r.gap) for r in ordered._gaps(part).collect()) == [(7, 35), (42, 7), (49, 318)]
