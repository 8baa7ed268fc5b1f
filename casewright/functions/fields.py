"""Column functions for normalization and identity."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def utc_timestamp(c: Column, zone: str = "UTC") -> Column:
    """A timestamp; an offset in the text counts, texts without one are in ``zone``. Null if malformed."""
    has_offset = c.rlike(r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(has_offset, F.try_to_timestamp(c)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(c), zone))


@F.pandas_udf(StringType())
def _ipv6(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return str(ipaddress.IPv6Address(v)) if v else None
        except ValueError:
            return v

    return values.map(one, na_action="ignore")


def ip_address(c: Column, ipv6: bool = False) -> Column:
    """IPv4 without leading zeros; with ``ipv6`` its shortest form too (the one function that runs in Python). Else unchanged."""
    parts = F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int").cast("string"), x))
    v4 = F.when(c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.array_join(parts, "."))
    return F.coalesce(v4, F.when(c.contains(":"), _ipv6(c)).otherwise(c)) if ipv6 else F.coalesce(v4, c)


def base_name(path: Column) -> Column:
    """The last part of a path; null for a path that ends in a separator."""
    return blank_to_null(F.regexp_extract(path, r"([^\\/]+)$", 1))


def account_name(user: Column) -> Column:
    """The account of ``DOMAIN\\user`` and ``user@domain``; null where a domain stands alone."""
    return blank_to_null(F.regexp_extract(F.regexp_replace(user, r"^.*\\", ""), r"^([^@]+)", 1))


def file_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def account_domain(user: Column) -> Column:
    """The domain of ``DOMAIN\\user`` and ``user@domain``; null where there is none."""
    domain = F.coalesce(blank_to_null(F.regexp_extract(user, r"^(.*)\\", 1)), blank_to_null(F.regexp_extract(user, r"@(.+)$", 1)))
    return F.when(user.isNotNull(), domain)


def user_key(user: Column) -> Column:
    """``account`` or ``account@domain`` in lower case, however the domain is written: accounts of two domains are two users."""
    account, domain = account_name(user), account_domain(user)
    return F.lower(F.when(domain.isNotNull(), F.concat(account, F.lit("@"), domain)).otherwise(account))


def account_key(user: Column) -> Column:
    """A rule for sources that write one account with several domains or none: the account's name alone counts."""
    return F.lower(account_name(user))


def host_key(host: Column) -> Column:
    return F.upper(host)


def process_key(host: Column, process: Column) -> Column:
    """Process identity holds within a host; without a host there is no key."""
    return F.concat(F.upper(host), F.lit("|"), base_name(process))


@dataclass(frozen=True)
class Identity:
    """One function for each entity type, from the event's fields to the key; configured rules replace some of them."""

    user: Callable[[Column], Column] = user_key
    host: Callable[[Column], Column] = host_key
    process: Callable[[Column, Column], Column] = process_key
    file: Callable[[Column], Column] = file_path


IDENTITY = Identity()


def host_type(host: Column, pattern: str = "-SRV-") -> Column:
    """Whether a host is a server, by its name's pattern; a configured role goes before (``entities.with_roles``)."""
    return F.when(F.contains(F.upper(host), F.lit(pattern)), "Server").otherwise("Host")


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
