"""Cache key templates: volatile parts of a key become placeholders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

_W = r"[A-Za-z0-9[^\x00-\x7F]]"
_B, _E = f"(?<!{_W})", f"(?!{_W})"
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d(?::(?:[0-5]\d|60))?+(?:\.\d{1,9}+)?+(?:[Zz]|[+-]\d\d(?::\d\d|\d\d)?+)?+"

#: In the order in which they apply.
RULES = (
    (f"{_B}{_DATE}[Tt _]{_TIME}{_E}", "{datetime}"),
    (f"{_B}{_DATE}{_E}", "{date}"),
    (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z]{2,}(?![A-Za-z0-9])", "{email}"),
    (f"{_B}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}(?!-){_E}", "{uuid}"),
    (rf"{_B}\d+{_E}", "{int}"),
    (f"{_B}[0-9A-HJKMNP-TV-Z]{{26}}{_E}", "{ulid}"),
    (f"{_B}(?:[0-9a-f]{{8,}}|[0-9A-F]{{8,}}){_E}", "{hex}"),
    (f"{_B}(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{{40}}{_E}", "{session}"),
)
MAX_BYTES = 255


def template(key: Column) -> Column:
    """The key with placeholders, cut to 255 bytes at a character's start."""
    for pattern, name in RULES:
        key = F.regexp_replace(key, pattern, name.replace("{", r"\{"))
    head = F.make_valid_utf8(F.substring(key.cast("binary"), 1, MAX_BYTES).cast("string"))
    return F.when(F.octet_length(key) <= MAX_BYTES, key).otherwise(F.regexp_replace(head, "\ufffd$", ""))


def template_bytes(key: Column) -> Column:
    """Template of a raw byte key: tokens that are mostly invalid UTF-8 become
    {bin}, other invalid bytes are dropped."""

    @F.pandas_udf("string")
    def repaired(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            out, token = [], bytearray()

            def close():
                good = bytes(token).decode("utf-8", "ignore")
                out.append("{bin}" if 2 * len(good.encode()) < len(token) else good)
                token.clear()

            for x in bytes(b):
                if x > 127 or chr(x).isalnum():
                    token.append(x)
                else:
                    close()
                    out.append(chr(x))
            close()
            return "".join(out)

        return raw.map(one)

    return template(repaired(key))
