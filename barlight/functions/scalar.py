"""Row expressions: null handling, time buckets, draws, text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.schema import MARKET_TIME_ZONE


def finite(x: Column) -> Column:
    """NaN and infinities become null: missing values have one form only."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over several columns that skips nulls; null only when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(known > 0, total / known)


def clipped_signal(x: Column) -> Column:
    """Missing becomes 0, then limited to [-1, 1]."""
    return F.least(F.greatest(F.coalesce(finite(x), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))


def utc_instant(text: Column) -> Column:
    """ISO text to a UTC wall-clock time; null when it cannot be read."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def market_time(utc: Column) -> Column:
    """UTC wall-clock time to naive New York time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_TIME_ZONE), utc)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock_minutes(text: str) -> int:
    hour, minute = text.split(":", 1)
    return int(hour) * 60 + int(minute)


def wall_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, read off its fields: the session's time zone plays no part."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def bucket_end(ts: Column, micros: int) -> Column:
    """Right edge of the right-closed bucket of ``micros`` microseconds, counted from 1970 in wall-clock time."""
    ahead = F.pmod(-wall_micros(ts), F.lit(micros)).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ahead.cast("decimal(18,6)"))


def uniform(*parts: Column | str | int) -> Column:
    """Portable uniform draw in [0, 1) from a text key."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def uniforms(key: Sequence[Column | str | int], tails: Sequence[str], count: Column) -> Column:
    """The draws of ``uniform`` for a key with each of the first ``count`` tails, as an array; the key's text is hashed once."""
    ends = [f":{tail}".encode() for tail in tails]

    def draws(text: str, n: int) -> np.ndarray:
        begun, digests = hashlib.md5(text.encode(), usedforsecurity=False), []
        for end in ends[:n]:
            one = begun.copy()
            one.update(end)
            digests.append(one.digest())
        return (np.frombuffer(b"".join(digests), ">u8")[::2] >> np.uint64(12)) / float(2**52)

    def of_all(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([draws(text, n) for text, n in zip(texts, counts)], dtype=object)

    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in key])
    return F.pandas_udf(of_all, T.ArrayType(T.DoubleType()))(text, count)


def fast_uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) from a 64-bit hash; same contract, cheaper."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*columns), F.lit(2**53)) / F.lit(float(2**53))


def slug(text: Column) -> Column:
    """Model id to a folder-safe name."""
    plain = F.regexp_replace(F.replace(text, F.lit("::"), F.lit("__")), r"[^a-zA-Z0-9._-]+", "_")
    plain = F.lower(F.regexp_replace(plain, r"^[._]+|[._]+$", ""))
    return F.when(plain == "", "model").otherwise(plain)


def _pretty(part: Column) -> Column:
    title = F.initcap(F.replace(part, F.lit("_"), F.lit(" ")))
    title = F.regexp_replace(title, r"\bKmeans\b", "KMeans")
    return F.regexp_replace(title, r"\bHmm\b", "HMM")


def display_label(model_id: Column) -> Column:
    """'a_b::c_hmm' to 'A B / C HMM'."""
    family = F.regexp_extract(model_id, r"^.*?::(.*)$", 1)
    candidate = F.regexp_extract(model_id, r"^(.*?)::", 1)
    return F.when(
        F.contains(model_id, F.lit("::")), F.concat(_pretty(candidate), F.lit(" / "), _pretty(family))
    ).otherwise(_pretty(model_id))


def contract_pattern(root: str) -> str:
    """Outright contracts of a root symbol; spreads do not match."""
    return rf"^{re.escape(root)}[HMUZ]\d{{1,2}}$"
