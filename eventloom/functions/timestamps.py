"""Timestamps in the formats that event logs use; a text without a zone is UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order after ISO 8601, as Spark datetime patterns.
PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss:SSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss z", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss")
_JS = re.compile(r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{1,2} \d{4} \d\d:\d\d:\d\d) GMT([+-]\d{4})(?: \(.*\))?$")


def parse(text: Column, custom: str | None = None) -> Column:
    """A timestamp from text by the first format that fits, else null; ``custom`` is tried first."""
    js = F.regexp_replace(text, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{1,2} \d{4} \d\d:\d\d:\d\d) GMT([+-]\d{4})( \(.*\))?$", "$1 $2")
    mail = F.regexp_replace(text, r"^[A-Z][a-z]{2}, ", "")  # Spark reads no names of days
    tries = [F.try_to_timestamp(text, F.lit(custom))] if custom else []
    tries += [text.try_cast("timestamp")] + [F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS]
    tries += [F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(js, F.lit("MMM d yyyy HH:mm:ss Z"))]
    return F.coalesce(*tries)


def parse_python(text: str, custom: str | None = None) -> datetime | None:
    """The same for a single value on the driver or in a parser; ``custom`` is a strptime format."""
    text = text.strip()
    found = None
    if custom:
        try:
            found = datetime.strptime(text, custom)
        except ValueError:
            pass
    if found is None and (m := _JS.match(text)):
        found = datetime.strptime(f"{m[1]} {m[2]}", "%b %d %Y %H:%M:%S %z")
    if found is None:
        iso = re.sub(r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d):(\d{3})", r"\1.\2", text).replace(" UTC", "+00:00")
        iso = re.sub(r"(\.\d{6})\d+", r"\1", iso)
        try:
            found = datetime.fromisoformat(iso)
        except ValueError:
            pass
    for form in () if found else ("%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S"):
        try:
            found = found or datetime.strptime(text, form)
        except ValueError:
            continue
    if found is None:
        try:
            found = parsedate_to_datetime(text)
        except (ValueError, TypeError, IndexError):
            return None
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


def iso(value: datetime) -> str:
    """RFC 3339 text in UTC."""
    value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    return value.isoformat()


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MILLISECOND = timedelta(milliseconds=1)
