import json
import socket
import time

import pytest

from quillon.operators.rollups import SPECS
from quillon.streaming import ingest


def frame(body: bytes, token=b"tok", version=b"v1"):
    content = version + b":" + token + b":" + body
    return str(len(content)).encode() + b":" + content


def test_stream_drains_frames_once(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    now = 1_700_000_000
    for k in range(4):
        body = json.dumps([{"t": "request", "_group": "g", "duration": 100 + k, "timestamp": str(now), "status_code": 500 if k == 0 else None}, {"t": "exception", "class": "E"}]).encode()
        (src / f"{k}.bin").write_bytes(frame(body))
    (src / "bad.bin").write_bytes(frame(b"{x]"))
    (src / "headless.bin").write_bytes(b"no header at all")
    (src / "other.bin").write_bytes(frame(b"[]", b"else"))
    for _ in range(2):  # a second run finds nothing new
        ingest.start(spark, str(src), root, "tok", "production", now, kinds=("requests",)).awaitTermination(120)
    row = ingest.rollup(spark, root, SPECS["req"]).first()
    assert (row.call_count, row.server_error_count, row.min_duration, row.max_duration) == (4, 1, 100, 103)
    assert spark.read.parquet(f"{root}/dead").count() == 2  # a frame without a header too


def test_batch_replay_overwrites(spark, tmp_path):
    body = json.dumps([{"t": "request", "_group": "g", "duration": 7}]).encode()
    batch = spark.createDataFrame([(bytearray(frame(body)),)], "raw binary")
    for _ in range(2):
        ingest.write_batch(batch, 3, str(tmp_path), "tok", None, 1_700_000_000, kinds=("requests",))
    assert ingest.rollup(spark, str(tmp_path), SPECS["req"]).first().call_count == 1


def test_replace_days_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.replace_days(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, day string"), path, "day")
    ingest.replace_days(spark.createDataFrame([(9, "2024-01-02")], "v int, day string"), path, "day")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


def test_batches_keep_users_issues_and_rejects(spark, tmp_path):
    root, now = str(tmp_path), 1_700_000_000
    limits = spark.createDataFrame([(1, "route", None, 1.0)], "seq int, type string, target string, duration_ms double")
    for n, (name, message, us) in enumerate((("Ann", "first", 1500), ("Anna", "second", 900))):
        records = [
            {"t": "user", "id": "u1", "name": name, "username": "a@b"}, {"t": "exception", "class": "E", "message": message, "_group": "0" * 32, "timestamp": str(now + n), "user": "u1"},
            {"t": "request", "_group": "a" * 32, "duration": us, "timestamp": str(now), "route_path": "/x"}, {"t": "request", "duration": "quick"}, {"t": "request", "_group": "a" * 32, "status_code": "503.0", "duration": 5, "timestamp": str(now)},
        ]
        batch = spark.createDataFrame([(bytearray(frame(json.dumps(records).encode())),)], "raw binary")
        for _ in range(2):  # replayed
            ingest.write_batch(batch, n, root, "tok", "p", now, thresholds=limits)
    assert [tuple(r) for r in ingest.users(spark, root).collect()] == [("u1", "Anna", "a@b", 0)]
    state = {r.type: r for r in ingest.issue_state(spark, root).collect()}
    assert (state["exception"].occurrences, state["exception"].message, state["exception"].last_seen) == (2, "second", (now + 1) * 1_000_000)
    assert (state["performance"].occurrences, state["performance"].threshold_ms, state["performance"].triggered_ms) == (1, 1, 2)
    assert spark.read.parquet(f"{root}/rejected").count() == 2
    total = ingest.rollup(spark, root, SPECS["req"]).selectExpr("sum(call_count) as n", "sum(server_error_count) as bad").first()
    assert (total.n, total.bad) == (4, 2)
    minute = ingest.concurrency(spark, root, now * 1_000_000 // 60_000_000 * 60_000_000, now * 1_000_000 + 60_000_000, now * 1_000_000).first()
    assert minute.max_prefix == 4
    ingest.backfill(spark, root, now + 1000, specs=[SPECS["req"]])
    day = spark.read.parquet(f"{root}/tier/day/req").selectExpr("sum(call_count) as n").first()
    assert day.n == 4 and spark.read.parquet(f"{root}/tier/minute/req").count() >= 1
    early = ingest.backfill(spark, root, now + 60, specs=[SPECS["req"]])
    assert early and spark.read.parquet(f"{root}/tier/day/req").count() == 0  # younger than the margin
    with pytest.raises(RuntimeError, match="nothere"):
        ingest.backfill(spark, root, now, specs=[SPECS["req"], type(SPECS["req"])("nothere", "nothere", {})])
    assert "raw" in ingest.clear_all(spark, root) and ingest.clear_all(spark, root) == []


def test_fan_out_and_swap(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    (tmp_path / "blocked").write_text("a file, no folder")
    failed = ingest.fan_out(df, [(f"{tmp_path}/a", "x"), (f"{tmp_path}/a", "x"), (f"{tmp_path}/blocked", "y")])
    assert list(failed) == [f"{tmp_path}/blocked"] and spark.read.parquet(f"{tmp_path}/a").count() == 1

    def ping(path):
        raise ConnectionError(path)

    with pytest.raises(ConnectionError):
        ingest.fan_out(df, [(f"{tmp_path}/b", "x")], ping=ping)
    ingest.swap(spark, df, "served", str(tmp_path), "1")
    ingest.swap(spark, df.unionAll(df), "served", str(tmp_path), "2")
    assert spark.table("served").count() == 2


@pytest.mark.parametrize("protocol", ["tcp", "udp"])
def test_socket_source(spark, tmp_path, protocol):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spark.dataSource.register(ingest.FrameSocket)
    stream = spark.readStream.format("frame_socket").option("port", port).option("protocol", protocol).load()
    query = stream.writeStream.format("memory").queryName(f"got_{protocol}").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            try:
                with socket.socket(socket.AF_INET, socket.SOCK_STREAM if protocol == "tcp" else socket.SOCK_DGRAM) as s:
                    s.connect(("127.0.0.1", port))
                    s.sendall(frame(b"PING"))
                    if protocol == "tcp":
                        assert s.recv(16) == b"2:OK"
            except ConnectionError:
                pass
            if spark.table(f"got_{protocol}").count():
                break
            time.sleep(0.5)
        assert bytes(spark.table(f"got_{protocol}").first().raw) == frame(b"PING")
    finally:
        query.stop()
