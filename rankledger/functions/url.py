"""URL checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_source(url: Column, hosts: Column) -> Column:
    """https, no user, no port, host in the list (any letter case)."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    authority = part("AUTHORITY")
    host = F.lower(part("HOST"))
    fine = (F.lower(part("PROTOCOL")) == "https") & ~authority.contains("@") & ~authority.rlike(r":\d*$") & F.array_contains(F.transform(hosts, lambda h: F.lower(h)), host)
    return F.coalesce(fine, F.lit(False))


def digits_param(url: Column, name: str) -> Column:
    """A query parameter that is all digits, else null."""
    v = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return F.when(v.rlike(r"^\d+$"), v)


def media_type_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"), F.lit(False))
