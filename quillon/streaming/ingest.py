"""Streaming ingest: frames in, raw tables, rollups, users, issue deltas and dead letters out.

Every micro-batch writes under its own batch number, so a replay overwrites
instead of adding twice. Rollup and issue deltas are stored per batch and
merged on read or by compaction, as all measures are additive; concurrency,
which depends on the order of events, is worked out from raw rows for the
minutes asked for, so late rows count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quillon.operators import issues, storage, windows
from quillon.operators.rollups import SPECS, TIERS, RollupSpec, aggregate, merge, to_tier
from quillon.sources import frames

KINDS = ("requests", "queries", "exceptions", "commands", "jobs", "cache_events", "mail", "notifications", "outgoing", "scheduled", "logs", "users")
#: Issue family of a record kind, and the column that its thresholds name.
TARGETS = {"requests": ("route", "route_path"), "queries": ("query", "connection"), "jobs": ("job", "queue"), "commands": ("command", "command"), "mail": ("mail", "mailable"), "notifications": ("notification", "notification")}
#: A backfill leaves out rows younger than this, as their batches may still come.
SAFETY_S = 120


def write_batch(batch: DataFrame, batch_id: int, root: str, token: str, environment: str | None, now: int, kinds=KINDS, thresholds: DataFrame | None = None) -> None:
    """One batch of raw frames into raw/<kind>, rollup/<spec>, users, issues, dead and rejected, idempotently.

    Dead letters are taken before the token is looked at, as broken frames have
    none. Records whose numbers are none go to rejected, alone of their batch.
    """
    part = f"batch={batch_id}"
    parsed = frames.parse(batch)
    frames.dead_letters(parsed).select("raw", "kind").write.mode("overwrite").parquet(f"{root}/dead/{part}")
    own = frames.authorised(parsed, token)
    frames.rejected(own).write.mode("overwrite").parquet(f"{root}/rejected/{part}")
    rows = frames.records(own).persist()
    try:
        made = {kind: frames.normalise(rows, kind, environment, now) for kind in {*kinds, *(s.source for s in SPECS.values()), "users", "exceptions", *TARGETS}}
        for kind in kinds:
            raw = made[kind].withColumn("event_date", F.to_date("created_at"))
            raw.write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/raw/{kind}/{part}")
        for spec in SPECS.values():
            aggregate(made[spec.source], spec).write.mode("overwrite").parquet(f"{root}/rollup/{spec.name}/{part}")
        people = made["users"].select(F.lit(batch_id).cast("long").alias("seq"), "user_id", "name", "email")
        storage.latest_users(people).select("user_id", "name", "email", F.col("first_seq").alias("seq")).write.mode("overwrite").parquet(f"{root}/users/{part}")
        _issues(made, thresholds).write.mode("overwrite").parquet(f"{root}/issues/{part}")
    finally:
        rows.unpersist()


def _issues(made: dict[str, DataFrame], thresholds: DataFrame | None) -> DataFrame:
    """The batch's exception and performance groups."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("threshold_ms", "long"), ("triggered_ms", "long"))]
    cols = ["group_hash", "type", "environment", "occurrences", "users_count", "first_seen", "last_seen", "class", "message", "threshold_ms", "triggered_ms"]
    e = made["exceptions"].withColumn("id", F.coalesce("trace_id", F.lit("")))
    out = issues.exception_groups(e).withColumn("type", F.lit("exception")).select("*", *none).select(*cols)
    if thresholds is None:
        return out
    for kind, (family, target) in TARGETS.items():
        timed = issues.threshold_of(made[kind].withColumn("target", F.col(target)), thresholds, family)
        groups = issues.performance_groups(timed).withColumn("type", F.lit("performance"))
        ms = lambda c: F.round(F.col(c) / 1000.0).cast("long")
        out = out.unionByName(groups.select("*", F.lit(None).cast("string").alias("class"), F.lit("Duration exceeded threshold").alias("message"), ms("threshold_us").alias("threshold_ms"), ms("triggered_us").alias("triggered_ms")).select(*cols))
    return out


def thresholds_at(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The thresholds as they are now; None without a path or a table."""
    try:
        return None if path is None else spark.read.schema("seq int, type string, target string, duration_ms double").json(path)
    except AnalysisException:
        return None


def start(spark: SparkSession, source: str, root: str, token: str, environment: str | None, now: int | Callable[[], int], kinds=KINDS, settings: str | None = None, files_per_batch: int = 10_000):
    """Drains a folder of binary frame files, one frame a file, then stops.

    A batch takes files_per_batch files at most, so that a backlog does not
    become one batch. Thresholds (JSON lines at `settings`) are read anew for
    every batch.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source).select(F.col("content").alias("raw"))

    def run(batch, n):
        write_batch(batch, n, root, token, environment, now() if callable(now) else now, kinds, thresholds_at(spark, settings))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def rollup(spark: SparkSession, root: str, spec: RollupSpec) -> DataFrame:
    """The merged rollup of all batches."""
    return merge(spark.read.parquet(f"{root}/rollup/{spec.name}"), spec)


def users(spark: SparkSession, root: str) -> DataFrame:
    """The newest name and email of each user, and its first batch."""
    return storage.latest_users(spark.read.parquet(f"{root}/users").select("seq", "user_id", "name", "email"))


def issue_state(spark: SparkSession, root: str) -> DataFrame:
    """Issues folded over all batches: counts add, times widen, the last batch's message and threshold and the longest duration hold."""
    keys, parts = issues.ISSUE_KEYS, spark.read.parquet(f"{root}/issues")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)
    return parts.groupBy(*keys).agg(
        F.sum("occurrences").alias("occurrences"), F.max("users_count").alias("users_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by("class", "batch").alias("class"), newest("message"), newest("threshold_ms"), F.max("triggered_ms").alias("triggered_ms"),
    )


def concurrency(spark: SparkSession, root: str, low_us: int, high_us: int, now_us: int) -> DataFrame:
    """Concurrency of the stored requests for the minutes of [low, high)."""
    return windows.concurrency(spark.read.parquet(f"{root}/raw/requests").select("ts_us", "duration"), low_us, high_us, now_us)


def backfill(spark: SparkSession, root: str, now: int, specs=None, safety_s: int = SAFETY_S) -> dict[str, str]:
    """Rebuilds tier/<tier>/<spec> from raw rows, each tier from the finer stored one, and concurrency.

    Rows of the last safety_s seconds are left out. One spec's failure does not
    stop the others: all failures are raised together at the end.
    """
    failed, written = {}, {}
    ceiling = F.timestamp_seconds(F.lit(now - safety_s)).cast("timestamp_ntz")
    for spec in specs or SPECS.values():
        try:
            made = aggregate(spark.read.parquet(f"{root}/raw/{spec.source}").where(F.col("created_at") < ceiling), spec)
            for tier in TIERS:
                path = f"{root}/tier/{tier}/{spec.name}"
                (made if tier == "minute" else to_tier(made, spec, tier)).write.mode("overwrite").parquet(path)
                made = spark.read.parquet(path)
            written[spec.name] = path
        except Exception as e:  # the others still run
            failed[spec.name] = str(e)
    try:
        concurrency(spark, root, 0, (now - safety_s) * 1_000_000, now * 1_000_000).write.mode("overwrite").parquet(f"{root}/concurrency")
    except Exception as e:
        failed["concurrency"] = str(e)
    if failed:
        raise RuntimeError("backfill failed for " + "; ".join(f"{k}: {v.splitlines()[0]}" for k, v in failed.items()))
    return written


def clear_all(spark: SparkSession, root: str) -> list[str]:
    """Deletes raw rows, rollups, tiers, issues, users and dead letters; dictionaries and settings stay. Missing tables are passed over."""
    conf, gone = spark._jsc.hadoopConfiguration(), []
    for name in ("raw", "rollup", "tier", "concurrency", "issues", "users", "dead", "rejected"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(conf).delete(path, True):
            gone.append(name)
    return gone


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Overwrites only the day partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def fan_out(batch: DataFrame, targets: list[tuple[str, str]], token_col: str = "token", ping: Callable[[str], None] | None = None) -> dict[str, str]:
    """Writes a batch to every distinct (path, token) target; returns failures by path.

    ping, if given, is called with each path first; what it raises is raised,
    before anything is written.
    """
    distinct, failed = list(dict.fromkeys(targets)), {}
    for path, _ in distinct if ping else ():
        ping(path)
    for path, token in distinct:
        try:
            batch.withColumn(token_col, F.lit(token)).write.mode("append").parquet(path)
        except Exception as e:  # one target must not stop the others
            failed[path] = str(e)
    return failed


def swap(spark: SparkSession, df: DataFrame, name: str, root: str, version: str) -> str:
    """Writes df beside the served version of a table and then points the view `name` at it; readers see old or new, never both."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    spark.read.parquet(path).createOrReplaceTempView(name)
    return path


class _SocketReader(SimpleDataSourceStreamReader):
    """Frames of a listening socket, TCP or UDP, as the driver receives them.

    A batch holds what came since the last one; offsets count frames. Frames
    are acknowledged when they are read, so those in the driver's memory are
    lost with it; a folder of files is the durable source. Connections idle
    for idle_s, and frames beyond the size cap, are dropped.
    """

    def __init__(self, options: dict):
        self.most, self.idle = int(options.get("maxFrameBytes", 10 << 20)), float(options.get("idleSeconds", 10))
        self.limit, self.pending = int(options.get("maxFramesPerBatch", 10_000)), int(options.get("maxPending", 100_000))
        self.udp, self.address = options.get("protocol", "tcp") == "udp", (options.get("host", "127.0.0.1"), int(options["port"]))
        self.frames, self.kept = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frames": None, "kept": {}}  # tasks get a copy that does not listen

    def _listen(self) -> None:
        import queue
        import threading

        if self.frames is None:
            self.frames = queue.Queue(self.pending)
            threading.Thread(target=self._datagrams if self.udp else self._connections, daemon=True).start()

    def _datagrams(self) -> None:
        import queue
        import socket

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.bind(self.address)
            while True:
                data, _ = s.recvfrom(65_535)
                try:
                    self.frames.put_nowait(data)  # dropped in silence under back-pressure
                except queue.Full:
                    pass

    def _connections(self) -> None:
        import socket
        import threading

        with socket.create_server(self.address) as server:
            while True:
                connection, _ = server.accept()
                threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection) -> None:
        import queue

        data = b""
        connection.settimeout(self.idle)
        with connection:
            try:
                while len(data) <= self.most:
                    head, colon, rest = data.partition(b":")
                    if colon and (not head.isdigit() or len(rest) >= int(head)):
                        self.frames.put(data, timeout=self.idle)
                        connection.sendall(b"2:OK")
                        return
                    more = connection.recv(65_536)
                    if not more:
                        return
                    data += more
                connection.sendall(b"5:ERROR")
            except (OSError, queue.Full):
                return

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict):
        self._listen()
        found = []
        while len(found) < self.limit and not self.frames.empty():
            found.append((self.frames.get(),))
        end = {"n": start["n"] + len(found)}
        self.kept[start["n"]] = (found, end)
        return iter(found), end

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self.kept.get(start["n"], ([], end))[0])

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["n"]}


class FrameSocket(DataSource):
    """spark.readStream.format("frame_socket"): options port, host, protocol (tcp or udp), maxFramesPerBatch, maxPending, maxFrameBytes, idleSeconds."""

    @classmethod
    def name(cls) -> str:
        return "frame_socket"

    def schema(self) -> str:
        return "raw binary"

    def simpleStreamReader(self, schema):  # noqa: N802
        return _SocketReader(self.options)
