import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import cachekey, histogram, scalars, sketch
from quillon.operators import health, issues, storage, windows
from quillon.sources import frames


def test_histogram_edges_and_bins(spark):
    assert len(histogram.EDGES) == 38 and histogram.EDGES[-1] == 47453133
    got = spark.createDataFrame([(0,), (127,), (128,), (47453133,)], "d bigint").select(histogram.bin_of(F.col("d")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 38]


def test_sketch_index(spark):
    values = [0.0, 0.5, 1.0, 128.0, 1000.0, 1e6, 8.64e10, 86400000001.0]
    want = [-1, -1, 0, 243, 346, 691, 1260, 1261]
    assert [sketch.index(v) for v in values] == want
    got = spark.createDataFrame([(v,) for v in values], "v double").select(sketch.index_of(F.col("v")).alias("i")).collect()
    assert [r.i for r in got] == want


def test_sketch_pack_round_trip_and_truncation():
    counts = {-1: 9, 0: 200000, 630: 12, 1261: 3}
    data = sketch.pack(counts)
    assert sketch.unpack(data) == counts and sketch.pack({}) == b"" and sketch.unpack(b"") == {}
    with pytest.raises(ValueError):
        sketch.unpack(data[:-1])


def test_sketch_merge_and_accuracy(spark):
    rng = random.Random(7)
    values = [int(10 ** rng.uniform(1, 7)) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "duration bigint")
    whole = sketch.add(df, [])
    halves = sketch.add(df.where("duration % 2 = 0"), []).unionByName(sketch.add(df.where("duration % 2 = 1"), []))
    assert sorted(sketch.merge(halves, []).collect()) == sorted(whole.select("idx", "cnt").collect())
    cells = whole.crossJoin(df.agg(F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration")))
    for p in (0.5, 0.95, 0.99):
        true = sorted(values)[max(1, -(-int(len(values) * p * 100) // 100)) - 1]
        assert abs(sketch.percentile(cells, [], p).first().estimate - true) <= 0.021 * true


def test_cache_key_templates(spark):
    pairs = {
        "user:8213:profile": "user:{int}:profile", "attempts:user@example.com": "attempts:{email}", "stats:2026-07-21": "stats:{date}", "report:2026-07-21T14:30:00Z": "report:{datetime}",
        "user:550e8400-e29b-41d4-a716-446655440000": "user:{uuid}", "session:01HV9AJ0T4Q2S8B3ZDGKM5NPXW": "session:{ulid}", "deadbeef": "{hex}", "color:28554f": "color:28554f",
        "KywllO9sT7khredx3bfte0iFL35hakXGTcnK4OiE": "{session}", "bad-date:2026-13-45": "bad-date:{int}-{int}-{int}", "café:menu": "café:menu", "": "", "é" * 300: "é" * 127,
    }
    got = spark.createDataFrame([(k,) for k in pairs], "k string").select("k", cachekey.template(F.col("k")).alias("t"))
    assert {r.k: r.t for r in got.collect()} == pairs
    again = got.select("t", cachekey.template(F.col("t")).alias("u")).where("t <> u")
    assert again.count() == 0


def test_binary_cache_keys(spark):
    df = spark.createDataFrame([(bytearray(b"k:\xff\xfe\xfd:9"),), (bytearray(b"caf\xc3\xa9:\xff"),)], "k binary")
    assert [r[0] for r in df.select(cachekey.template_bytes(F.col("k"))).collect()] == ["k:{bin}:{int}", "café:{bin}"]


def test_frames(spark):
    def frame(body, version=b"v1", token=b"tok"):
        content = version + b":" + token + b":" + body
        return bytearray(str(len(content)).encode() + b":" + content)

    record = json.dumps([{"t": "request", "duration": 5}, {"x": 1}, {"t": "nope"}]).encode()
    cases = [
        (frame(record), "records"), (frame(b"PING"), "ping"), (frame(record, b"v2"), "error"), (bytearray(b"nocolon"), None), (bytearray(b"0:v1:tok:x"), None), (frame(b"{bad"), None), (frame(b'"s"'), None), (frame(gzip.compress(record)), "records"),
        (frame(gzip.compress(record)[:-9] + b"xxxxxxxxx"), None), (frame(b'[{"t":"log","message":"\xff"}]'), None), (frame(record + b"XX"), None), (frame(record + b",[]"), None), (frame(record) + b"behind", "records"), (frame(record, token=b"t" * 150), "records"),
        (bytearray(b"5:" + frame(record)[3:]), None), (bytearray(b""), None), (bytearray(b":v1:tok:[]"), None), (bytearray(b"5:v1:to"), None), (frame(b'{"a":{"t":"log"}}'), "records"), (frame(b"[]"), "records"), (frame(gzip.compress(b"PING")), "ping"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw binary")
    parsed = frames.parse(df)
    assert [r.kind for r in parsed.orderBy("i").collect()] == [k for _, k in cases]
    assert frames.records(parsed).count() == 5
    assert frames.dead_letters(parsed).count() == sum(k in (None, "error") for _, k in cases)
    one = frames.normalise(frames.records(parsed), "requests", None, 1_700_000_000).first()
    assert (one.method, one.url, one.status_code, one.ts_us) == ("GET", "/", 200, 1_700_000_000_000_000)
    assert frames.parse(df, gzip=False).where("i = 7").first().kind is None


def test_numbers_of_records(spark):
    rows = [{"t": "request", "status_code": v, "duration": 7} for v in ("503", 12.5, 7.0, "x", None, True, [1])]
    body = json.dumps(rows).encode()
    content = b"v1:tok:" + body
    parsed = frames.parse(spark.createDataFrame([(bytearray(str(len(content)).encode() + b":" + content),)], "raw binary"))
    got = [r.status_code for r in frames.normalise(frames.records(parsed), "requests", None, 0).collect()]
    assert got == [503, 12, 7, 200, 1]
    assert [r.fields for r in frames.rejected(parsed).collect()] == ["status_code", "status_code"]


def test_host_metrics(spark, tmp_path):
    (tmp_path / "stat").write_text("cpu  10 0 10 70 5 3 2 0\ncpu0 1\n")
    (tmp_path / "meminfo").write_text("MemTotal: 200 kB\nMemFree: 1 kB\nMemAvailable: 50 kB\n")
    sample = health.host_sample(str(tmp_path))
    assert sample == {"total": 100, "idle": 70, "memory_total": 204_800, "memory_available": 51_200}
    samples = spark.createDataFrame([(1, 100, 70), (2, 200, 95), (3, 200, 95)], "tick int, total bigint, idle bigint").withColumn("host", F.lit("h"))
    assert [r.usage_pct for r in health.cpu_usage(samples, ["host"], "tick").orderBy("tick").collect()] == [None, 75.0, 0.0]
    assert spark.range(1).select(health.memory_usage(F.lit(200), F.lit(50)).alias("p")).first().p == 75.0


def test_lifecycle_forgets(spark):
    ticks = spark.createDataFrame([("c", t) for t in (1, 2, 3, 500, 501)], "code string, tick bigint").withColumn("host", F.lit("h"))
    assert [(r.first_tick, r.alerted, r.resolves) for r in health.lifecycle(ticks, ["host"], "tick", now_tick=510).collect()] == [(500, True, False)]
    assert health.lifecycle(ticks, ["host"], "tick").count() == 2


def test_blocked_order_equals_plain(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(100)) for k in ("a", None) for i in rng.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int")
    for k in ("a", None):
        own = [v for _, v in sorted((i, v) for x, i, v in rows if x == k)]
        mean = own[0]
        for v in own[1:]:
            mean = 0.3 * v + 0.7 * mean
        same = F.col("k").eqNullSafe(F.lit(k))
        assert abs(windows.ewma(df, ["k"], "i", "v", block=64).where(same).first().ewma - mean) < 1e-9
        got = [r.delta for r in windows.rates(df, ["k"], "i", "v", block=64).where(same).orderBy("i").collect()]
        assert got == [0] + [max(b - a, 0) for a, b in zip(own, own[1:])]


def test_concurrency_golden(spark):
    s = 1_000_000
    spans = spark.createDataFrame([(4 * s, 2 * s), (0, 10 * s), (2 * s, 10 * s), (None, 5), (3 * s, -1)], "ts_us bigint, duration bigint")
    assert [tuple(r) for r in windows.concurrency(spans, 0, 600 * s, 600 * s).collect()] == [(0, 0, 3)]
    spans = spark.createDataFrame([(1 * s, 10 * s), (3 * s, 10 * s), (30 * s, 90 * s), (150 * s, 2 * s)], "ts_us bigint, duration bigint")
    got = sorted(tuple(r) for r in windows.concurrency(spans, 0, 600 * s, 600 * s).collect())
    assert got == [(0, 1, 2), (120 * s, -1, 0)]


def test_saturation_is_inclusive_and_breaks_on_gaps(spark):
    rows = [("p", f"2024-01-01 00:0{m}:00", int(v * 1e6)) for m, v in ((0, 108.0), (1, 108.0), (2, 108.0), (4, 200.0), (5, 107.9), (6, 108.0))]
    df = spark.createDataFrame(rows, "environment string, b string, total_duration bigint").withColumn("bucket_start", F.col("b").cast("timestamp_ntz"))
    got = issues.saturation(df, 2, 90, 3, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).collect()
    assert [str(r.bucket_start) for r in got] == ["2024-01-01 00:02:00"]


def test_staleness(spark):
    t = spark.createDataFrame([("a_rollups", 10_000), ("b_rollups", 9_099), ("c_rollups", 9_100), ("a_daily_rollups", 0), ("e_rollups", None)], "name string, max_bucket bigint")
    assert [tuple(r) for r in windows.stale(t).collect()] == [("b_rollups", 901)]


def test_scalars(spark):
    df = spark.createDataFrame([(" On ", "{}"), ("0", "x")], "a string, b string")
    assert [tuple(r) for r in df.select(scalars.truthy(F.col("a")), scalars.null_placeholder(F.col("b"))).collect()] == [(True, None), (False, "x")]


def test_saturation_message_rounds_the_double_itself(spark):
    """Ties go to the even digit, and 6.05 is below its tie as a double; null stays null, as the SQL's printf has it."""
    shown = {75_000_000: "1.2", 105_000_000: "1.8", 363_000_000: "6.0", 435_000_000: "7.2", 87_000_000: "1.4", 3_000_000: "0.1", 0: "0.0", -2_000_000: "-0.0", 10**17: "1666666666.7", None: None}
    df = spark.createDataFrame([(us,) for us in shown], "us bigint").select("us", scalars.saturation_message(90, 4, 2, F.col("us")).alias("m"))
    before = "Avg concurrency held at ≥90% of 4 workers for 2 consecutive minutes (worst minute: "
    assert {r.us: r.m for r in df.collect()} == {us: None if text is None else f"{before}{text} busy)" for us, text in shown.items()}


def test_human_bytes_of_any_long(spark):
    """As the SQL has them: no exponents, halves of ten times the double away from zero, the sign of what rounds to zero."""
    shown = {
        0: "0 KB", 256: "0.3 KB", -256: "-0.3 KB", -10: "-0 KB", -2048: "-2 KB", 1_048_575: "1024 KB", 1_048_576: "1 MB", 1_073_741_824: "1 GB", 3_750_000_000: "3.5 GB", 2_233_509_212_271_411: "2080117.6 GB",
        10_737_418_240_000_000: "10000000 GB", 2**63 - 1: "8589934592 GB", -(2**63): "-9007199254740992 KB", None: None,
    }
    df = spark.createDataFrame([(n,) for n in shown], "n bigint").select("n", scalars.human_bytes(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == shown


def test_dictionary_round_trip_and_trace(spark):
    df = spark.createDataFrame([("x", "T1", "t1"), (None, "T2", "t1"), ("y", "T3", None)], "v string, trace_id string, execution_id string")
    entries = storage.dictionary(df.select(F.lit("k").alias("kind"), F.col("v").alias("value")))
    back = storage.decode(storage.encode(df, entries, {"v": "k"}), entries, {"v": "k"})
    assert sorted(map(str, back.select("v").collect())) == sorted(map(str, df.select("v").collect()))
    assert [r.trace_id for r in storage.dedupe_trace(df).collect()] == [None, "T2", "T3"]


def test_alert_channels_and_scores(spark):
    events = spark.createDataFrame([("new", 1)], "event string, id int")
    channels = spark.createDataFrame([("a", '{"notify_events":["new"]}', True), ("b", '{"notify_events":["old"]}', True), ("c", "{}", True), ("d", "{}", False)], "channel string, config string, enabled boolean")
    assert sorted(r.channel for r in health.for_channels(events, channels).collect()) == ["a", "c"]


def test_percentile_clamps_and_underflow(spark):
    df = spark.createDataFrame([(500,)] * 4, "duration bigint")
    cells = sketch.add(df, []).select("*", F.lit(500).alias("min_duration"), F.lit(500).alias("max_duration"))
    assert sketch.percentile(cells, [], 0.95).first().estimate == 500.0
