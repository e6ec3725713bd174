"""The few spellings in which Spark SQL and the oracle's SQL differ."""

from __future__ import annotations


class Spark:
    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))"

    def trunc(self, unit: str, ts: str) -> str:
        return f"cast(date_trunc('{unit}', {ts}) as timestamp_ntz)"

    def from_micros(self, us: str) -> str:
        return f"cast(timestamp_micros({us}) as timestamp_ntz)"

    def json(self, text: str, key: str) -> str:
        return f"get_json_object({text}, '$.{key}')"


class Duck:
    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def trunc(self, unit: str, ts: str) -> str:
        return f"date_trunc('{unit}', {ts})"

    def from_micros(self, us: str) -> str:
        return f"make_timestamp({us})"

    def json(self, text: str, key: str) -> str:
        return f"json_extract_string({text}, '$.{key}')"


SPARK, DUCK = Spark(), Duck()
