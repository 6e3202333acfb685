"""Channel-name, time and text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns, region ranges, annotation keywords and the clustering gap.
CONTACT = r"^(?:EEG\s+)?([A-Za-zА-Яа-я]+'?)\s*(\d+)$"
CONTACT_NUMBERS = r"([A-Za-z]+)\s*(\d+)(?:-(\d+))?"
MARKER = r"(?i)^MKR\s*\d+\+?$"
REGION = (("PM", 3, 8), ("CC", 8, 10))
KEYWORDS = ("приступ", "судорог", "seizure", "ictal", "бткп", "tcs")
CLUSTER_GAP_SECONDS = 10.0


def _group(name: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(F.trim(name), pattern, index), F.lit(""))


def shaft(name: Column) -> Column:
    return _group(name, CONTACT, 1)


def contact(name: Column) -> Column:
    return _group(name, CONTACT, 2).cast("int")


def is_marker(name: Column) -> Column:
    return F.trim(name).rlike(MARKER)


def in_region(name: Column, region=REGION) -> Column:
    """Contact, or either end of a pair label, lies in one of the (shaft, first, last) ranges."""
    label = _group(name, CONTACT_NUMBERS, 1)
    ends = [_group(name, CONTACT_NUMBERS, k).cast("int") for k in (2, 3)]
    hits = [(label == s) & reduce(lambda a, b: a | b, [F.coalesce(e.between(lo, hi), F.lit(False)) for e in ends])
            for s, lo, hi in region]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def mentions(text: Column, keywords=KEYWORDS) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keywords])


def clock_offset(clock: Column, start: Column, duration: Column, strict: bool = False) -> Column:
    """Seconds from ``start`` to the next time the clock shows HH:MM:SS[.ffffff]; NULL (or an
    error when strict) for malformed text or a time outside [0, duration]."""
    shape = clock.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$")
    moment = F.try_to_timestamp(F.concat_ws(" ", F.date_format(start, "yyyy-MM-dd"), F.when(shape, clock)))
    moment = F.when(moment < start, moment + F.expr("INTERVAL 1 DAY")).otherwise(moment)
    offset = (F.unix_micros(moment) - F.unix_micros(start)) / F.lit(1e6)
    ok = offset.between(F.lit(0.0), duration)
    return F.when(ok, offset).otherwise(
        F.raise_error(F.concat(F.lit("clock outside the recording or malformed: "), clock)).cast("double")
        if strict else F.lit(None).cast("double")
    )


def to_microvolts(volts: Column) -> Column:
    return volts * 1e6


def sample_to_seconds(i: Column, sfreq) -> Column:
    return i / sfreq


def seconds_to_sample(t: Column, sfreq) -> Column:
    """Half-to-even rounding, as for window lengths."""
    return F.bround(t * sfreq).cast("bigint")


def window_of(t: Column, window_seconds) -> Column:
    return F.floor(t / window_seconds).cast("bigint")
