"""Wire frames `length:version:token:payload`, their records, and normalised kinds.

The length counts the bytes after its colon: version, token and payload. What
follows them is not part of the frame.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillon.functions import scalars
from quillon.functions.cachekey import template

MAX_INFLATED = 200 << 20
WIRE_TYPES = ("request", "query", "exception", "command", "queued-job", "job-attempt", "cache-event", "mail", "notification", "outgoing-request", "scheduled-task", "log", "user")

#: Fields of the wire records, read as text; a missing one is null.
FIELDS = (
    "t v timestamp deploy server _group user trace_id execution_id method url route_path route_methods status_code duration sql connection class message code file line handled name command exit_code "
    "job_class queue status attempt_id attempts type key store ttl mailable notification channel queued failed expression cron repeat_seconds level context id username"
).split()
#: Those that hold whole numbers; numbers may come as text or with a fraction.
NUMBERS = ("status_code", "duration", "line", "exit_code", "attempts", "ttl", "repeat_seconds")
_RECORD = "struct<" + ", ".join(f"`{f}`: string" for f in FIELDS) + ">"


@F.pandas_udf(T.StringType())
def inflated(payload: pd.Series) -> pd.Series:
    """gzip payloads as text; null beyond the size cap, on errors and on invalid UTF-8."""

    def one(raw):
        if raw is None:
            return None
        try:
            z = zlib.decompressobj(31)
            out = z.decompress(bytes(raw), MAX_INFLATED)
            return None if z.unconsumed_tail else out.decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return payload.map(one)


def _latin(raw: Column) -> Column:
    """One character for each byte, so that positions in the text are bytes'."""
    return F.decode(raw, "ISO-8859-1")


def _declared(text: Column) -> Column:
    digits = F.regexp_extract(F.substring_index(text, ":", 1), r"^[ \t\n\r\x0B\f]*\+?([0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0))


def complete(raw: Column) -> Column:
    """The frame holds as many bytes as its length says."""
    text = _latin(raw)
    return (F.instr(text, ":") > 0) & (F.octet_length(raw) >= F.instr(text, ":") + _declared(text))


def parse(frames: DataFrame, raw: str = "raw", gzip: bool = True) -> DataFrame:
    """frames with version, token, text, and kind: records, ping, error for an unsupported version, or null.

    raw is binary. A payload is gzip if its first two bytes say so, else text;
    it must be valid UTF-8 and PING, or one JSON array or object with nothing
    behind it. Only gzip payloads go to Python.
    """
    text = _latin(F.col(raw))
    part = lambda n, k: F.regexp_extract(text, "^" + "([^:]*):" * n, k)
    out = _bound(frames, _declared=_declared(text), _head=F.octet_length(part(1, 1)), _v=F.when(text.rlike("^[^:]*:[^:]*:"), part(2, 2)), _t=F.when(text.rlike("^[^:]*:[^:]*:[^:]*:"), part(3, 3)))
    room = F.col("_declared") - F.length("_v") - 1  # bytes behind the version's colon
    framed = room - F.length("_t") - 1 >= 0
    start = F.col("_head") + F.length("_v") + F.length("_t") + 4
    payload = F.substring(F.col(raw), start, (room - F.length("_t") - 1).cast("int"))
    out = _bound(out, version=F.when(room >= 0, F.col("_v")), token=F.when(framed, F.col("_t")), payload=F.when(framed, payload)).drop("_declared", "_head", "_v", "_t")
    plain = F.try_validate_utf8(F.col("payload").cast("string"))
    if gzip:
        zipped = F.substring("payload", 1, 2) == F.unhex(F.lit("1F8B"))
        out = out.withColumn("_inflated", inflated(F.when(zipped, F.col("payload"))))
        out = _bound(out, text=F.when(zipped, F.col("_inflated")).otherwise(plain)).drop("_inflated")
    else:
        out = _bound(out, text=plain)
    alone = F.concat(F.lit("["), "text", F.lit("]"))  # nothing may follow the value
    json = F.col("text").rlike(r"^[ \t\n\r]*[\[{]") & F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1)
    kind = F.when(F.col("version") != "v1", "error").when(F.col("payload").isNull(), None).when(F.col("text") == "PING", "ping").when(json, "records")
    return _bound(out, kind=kind)


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def authorised(parsed: DataFrame, token: str) -> DataFrame:
    return parsed.where((F.col("kind") == "ping") | (F.col("token") == token))


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Frames that hold no records, whatever their token: what a quarantine keeps."""
    return parsed.where("kind is null or kind = 'error'")


def _listed(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Records of known type as text fields, with _error, the number fields that hold no number."""
    one = F.when(F.col("text").rlike(r"^[ \t\n\r]*\["), F.from_json("text", f"array<{_RECORD}>")).otherwise(F.map_values(F.from_json("text", f"map<string, {_RECORD}>")))
    rows = parsed.where("kind = 'records'").select(*keep, F.explode(one).alias("r")).select(*keep, "r.*").where(F.col("t").isin(*WIRE_TYPES))
    wrong = [F.when(F.col(c).isNotNull() & scalars.whole(F.col(c)).isNull(), F.lit(c)) for c in NUMBERS]
    return rows.withColumn("_error", F.concat_ws(",", *wrong))


def records(parsed: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row a record of known type, numbers cast; those whose numbers are none are left to rejected()."""
    return _listed(parsed, keep).where("_error = ''").drop("_error").withColumns({c: scalars.whole(F.col(c)) for c in NUMBERS})


def rejected(parsed: DataFrame) -> DataFrame:
    """Records with a number field that holds no number, as JSON, and the fields' names: rows that would fail a batch."""
    return _listed(parsed, []).where("_error <> ''").select(F.to_json(F.struct(*FIELDS)).alias("record"), F.col("_error").alias("fields"))


def type_counts(parsed: DataFrame) -> DataFrame:
    return records(parsed).groupBy("t").agg(F.count("*").alias("n"))


def normalise(rows: DataFrame, kind: str, environment: str | None, now: int) -> DataFrame:
    """Records of one kind under their stored names, types and defaults."""
    t = {"requests": ["request"], "queries": ["query"], "exceptions": ["exception"], "commands": ["command"], "jobs": ["queued-job", "job-attempt"], "cache_events": ["cache-event"], "mail": ["mail"],
         "notifications": ["notification"], "outgoing": ["outgoing-request"], "scheduled": ["scheduled-task"], "logs": ["log"], "users": ["user"]}[kind]
    clock = F.lit(now).cast("long")
    seconds = scalars.event_seconds(F.col("timestamp"), clock)
    created = F.timestamp_seconds(seconds).cast("timestamp_ntz")
    micros = F.when(seconds == F.floor(F.col("timestamp").try_cast("double")).cast("long"), F.floor(F.col("timestamp").try_cast("double") * 1e6)).otherwise(clock * 1_000_000).cast("long")
    group, user = F.col("_group").alias("group_hash"), F.col("user").alias("user_id")
    c, clamp = F.coalesce, scalars.clamped
    common = [created.alias("created_at"), micros.alias("ts_us"), F.lit(environment).cast("string").alias("environment"), "server", "trace_id"]
    status = c("status_code", F.lit(200)).alias("status_code")
    flags = [scalars.truthy(F.col(x)).alias(x) for x in ("queued", "failed")]
    own = {
        "requests": [group, user, c("method", F.lit("GET")).alias("method"), clamp(c("url", F.lit("/"))).alias("url"), status, "duration", c("route_methods", F.lit("[]")).alias("route_methods"), clamp(F.col("route_path")).alias("route_path")],
        "queries": [group, user, "execution_id", c("sql", F.lit("")).alias("sql_query"), "connection", "duration", "file", "line"],
        "exceptions": [user, "execution_id", c("class", F.lit("Unknown")).alias("class"), "message", c(scalars.truthy(F.col("handled")), F.lit(False)).alias("handled"), "code", "file", "line", "_group"],
        "commands": [group, user, c("command", "name", F.lit("unknown")).alias("command"), "exit_code", "duration"],
        "jobs": [group, user, "attempt_id", "status", c("name", "job_class", F.lit("Unknown")).alias("job_class"), "queue", c("attempts", F.lit(1)).alias("attempts"), "duration"],
        "cache_events": [user, c("type", F.lit("unknown")).alias("event_type"), c("key", F.lit("")).alias("raw_key"), template(c("key", F.lit(""))).alias("key"), "store", "ttl", "duration"],
        "mail": [group, user, c("class", "mailable").alias("mailable"), *flags, "duration"],
        "notifications": [group, user, c("class", "notification").alias("notification"), "channel", *flags, "duration"],
        "outgoing": [group, user, c("method", F.lit("GET")).alias("method"), c("url", F.lit("")).alias("url"), "status_code", "duration"],
        "scheduled": [group, c("name", "command", F.lit("unknown")).alias("command"), c("cron", "expression").alias("expression"), c("repeat_seconds", F.lit(0)).alias("repeat_seconds"), "status", "exit_code", "duration"],
        "logs": [user, c("level", F.lit("info")).alias("level"), "message", scalars.null_placeholder(F.col("context")).alias("context"), "channel"],
        "users": [F.col("id").alias("user_id"), "name", F.col("username").alias("email")],
    }
    out = rows.where(F.col("t").isin(*t)).select(*common, *own[kind])
    if kind == "exceptions":
        from quillon.operators.issues import fingerprint

        return out.withColumn("fingerprint", scalars.hex32(fingerprint(*[F.col(x) for x in ("class", "code", "file", "line")], F.col("_group")))).drop("_group")
    return out.where("user_id is not null and trim(user_id) <> ''") if kind == "users" else out
