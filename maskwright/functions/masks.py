"""Typed masks: 18 functions with five strategies, as SQL expressions over a string.

Every mask turns a null or empty value into a fixed mask; an unknown strategy
leaves the value as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK, Spark
from .hashing import hash_sql

_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _stars(n: str) -> str:
    return f"repeat('*', cast(greatest({n}, 0) as int))"


def _all_stars(v: str) -> str:
    return _stars(f"length({v})")


def _edges(v: str, first: int, last: int, least: int) -> str:
    """The first and last characters with stars between, if longer than least."""
    tail = f"right({v}, {last})" if last else "''"
    return f"case when length({v}) <= {least} then '***' else concat(left({v}, {first}), {_stars(f'length({v}) - {first + last}')}, {tail}) end"


def _digits(d: Spark, v: str) -> str:
    return d.replace(v, r"\D")


def _email(d: Spark, v: str, strategy: str) -> str:
    parts = d.split(v, "@")
    local, domain = f"coalesce({d.item(parts, 0)}, '')", f"coalesce({d.item(parts, 1)}, '')"
    labels = d.split(domain, r"\.")
    last = d.item(labels, f"{d.size(labels)} - 1")
    partial_local = f"case when length({local}) > 2 then concat(left({local}, 1), {_stars(f'length({local}) - 2')}, right({local}, 1)) else '***' end"
    partial_domain = f"case when {d.size(labels)} > 1 then concat(left({d.item(labels, 0)}, 1), '***.', {last}) else '***' end"
    out = {
        "partial": f"concat({partial_local}, '@', {partial_domain})",
        "full": "'***@***.***'",
        "structural": f"concat({_all_stars(local)}, '@', {_all_stars(domain)})",
        "hash": f"concat({d.short_hash(v)}, '@masked.email')",
        "redact": "'[EMAIL REDACTED]'",
    }[strategy]
    return f"case when {local} = '' or {domain} = '' then '***' else {out} end"


def _phone(d: Spark, v: str, strategy: str) -> str:
    prefix = d.first(v, r"^\+?\d{1,3}[-.\s]?")
    rest = f"substring({v}, length({prefix}) + 1)"
    digits = _digits(d, rest)
    return {
        "partial": f"concat({prefix}, case when length({digits}) <= 2 then '***' else concat({_stars(f'length({digits}) - 2')}, right({digits}, 2)) end)",
        "full": "'***'",
        "structural": f"concat({prefix}, {d.replace(rest, r'\d', '*')})",
        "hash": d.short_hash(v),
        "redact": "'[PHONE REDACTED]'",
    }[strategy]


def _ssn(d: Spark, v: str, strategy: str) -> str:
    parts = d.split(v, "-")
    return {
        "partial": f"case when {d.size(parts)} = 3 then concat('***-**-', {d.item(parts, 2)}) else '***' end",
        "full": "'***-**-****'",
        "structural": _all_stars(v),
        "hash": d.short_hash(v),
        "redact": "'[SSN REDACTED]'",
    }[strategy]


def _card(d: Spark, v: str, strategy: str) -> str:
    digits, groups = _digits(d, v), d.count(v, r"\d{4}")
    return {
        "partial": f"case when length({digits}) < 4 then '***' when {groups} > 0 then concat(repeat('**** ', cast({groups} - 1 as int)), right({digits}, 4)) else concat('**** **** **** ', right({digits}, 4)) end",
        "full": "'***'",
        "structural": _all_stars(v),
        "hash": d.short_hash(v),
        "redact": "'[CARD REDACTED]'",
    }[strategy]


def _dob(d: Spark, v: str, strategy: str, strict_compat: bool = False) -> str:
    sep = f"case when {d.position("'-'", v)} > 0 then '-' when {d.position("'/'", v)} > 0 then '/' when {d.position("'.'", v)} > 0 then '.' when {d.position("' '", v)} > 0 then ' ' else '-' end"
    named, plain = d.split(v, r"[-/.\s]+"), f"split({v}, {sep})" if d.name == "duckdb" else f"split({v}, concat('[', {sep}, ']'), -1)"
    is_named = f"{d.has(v, rf'(?i)(?:^|[^0-9A-Za-z_])(?:{_MONTHS})[a-z]*(?:$|[^0-9A-Za-z_])')} and {d.size(named)} = 3"
    part = [f"coalesce({d.item(plain, i)}, '')" for i in range(3)]
    shapeless = f"concat('****', {sep}, '**', {sep}, '**')"
    hidden = v if strict_compat else {"hash": hash_sql("dateOfBirth", v, d), "redact": "'[DOB REDACTED]'"}.get(strategy, v)

    def shape(partial: list[str], full: list[str]) -> str:
        joined = {"partial": partial, "full": full}
        if strategy in joined:
            a, b, c = joined[strategy]
            return f"concat({a}, {sep}, {b}, {sep}, {c})"
        return _all_stars(v) if strategy == "structural" else hidden

    by_name = shape(["'**'", "'***'", f"coalesce({d.item(named, 2)}, '')"], ["'**'", "'***'", "'****'"])
    year_first = shape([part[0], "'**'", "'**'"], ["'****'", "'**'", "'**'"])
    year_last = shape(["'**'", "'**'", part[2]], ["'**'", "'**'", "'****'"])
    empty = " or ".join(f"{p} = ''" for p in part)
    return f"case when {is_named} then {by_name} when {d.size(plain)} <> 3 or {empty} then {shapeless} when length({part[0]}) = 4 then {year_first} when length({part[2]}) = 4 then {year_last} else {shapeless} end"


def _bsb(d: Spark, v: str, strategy: str) -> str:
    sep = f"case when {d.position("'-'", v)} > 0 then '-' when {d.position("' '", v)} > 0 then ' ' else '' end"
    digits = _digits(d, v)
    return {
        "partial": f"case when length({digits}) = 6 then concat('***', {sep}, '*', right({digits}, 1)) else '***' end",
        "full": "'***'",
        "structural": _all_stars(v),
        "hash": d.short_hash(v),
        "redact": "'[BSB REDACTED]'",
    }[strategy]


def _account(d: Spark, v: str, strategy: str) -> str:
    digits = _digits(d, v)
    return {
        "partial": f"case when length({digits}) < 3 then '***' else concat('***', right({digits}, 3)) end",
        "full": "'***'",
        "structural": _all_stars(v),
        "hash": d.short_hash(v),
        "redact": "'[ACCOUNT REDACTED]'",
    }[strategy]


def _ip(d: Spark, v: str, strategy: str) -> str:
    six, dots = f"{d.position("':'", v)} > 0", d.split(v, r"\.")
    return {
        "partial": f"case when {six} then concat({d.item(d.split(v, ':'), 0)}, ':', repeat('*', 10)) when {d.size(dots)} = 4 then concat({d.item(dots, 0)}, '.*.*.*') else '***' end",
        "full": f"case when {six} then '****:****:****:****' else '*.*.*.*' end",
        "structural": _all_stars(v),
        "hash": d.short_hash(v),
        "redact": "'[IP REDACTED]'",
    }[strategy]


def _plain(partial: Callable[[str], str], label: str, full: str = "'***'", structural: Callable[[str], str] = _all_stars) -> Callable[[Spark, str, str], str]:
    def mask(d: Spark, v: str, strategy: str) -> str:
        return {"partial": partial(v), "full": full, "structural": structural(v), "hash": d.short_hash(v), "redact": f"'[{label}]'"}[strategy]

    return mask


def _fixed(mask: str) -> Callable[[str], str]:
    return lambda v: f"'{mask}'"


_MASKS: dict[str, Callable[[Spark, str, str], str]] = {
    "generic": _plain(lambda v: _edges(v, 1, 1, 3), "REDACTED"),
    "email": _email,
    "phone": _phone,
    "ssn": _ssn,
    "card": _card,
    "address": _plain(_fixed("[ADDRESS REDACTED]"), "ADDRESS REDACTED", "'[ADDRESS REDACTED]'"),
    "dob": _dob,
    "passport": _plain(lambda v: _edges(v, 1, 1, 3), "PASSPORT REDACTED"),
    "license": _plain(lambda v: _edges(v, 1, 1, 3), "LICENSE REDACTED"),
    "national_id": _plain(lambda v: _edges(v, 2, 2, 4), "ID REDACTED"),
    "bsb": _bsb,
    "account": _account,
    "tfn": _plain(_fixed("*** *** ***"), "TFN REDACTED", "'*** *** ***'"),
    "abn": _plain(_fixed("** *** *** ***"), "ABN REDACTED", "'** *** *** ***'"),
    "medicare": _plain(_fixed("**** ***** *"), "MEDICARE REDACTED", "'**** ***** *'"),
    "ip": _ip,
    "iban": _plain(lambda v: _edges(v, 2, 4, 6), "IBAN REDACTED", structural=lambda v: f"concat(left({v}, 2), {_stars(f'length({v}) - 2')})"),
    "swift": _plain(lambda v: _edges(v, 4, 0, 4), "SWIFT REDACTED"),
}
FUNCTIONS = tuple(_MASKS)


def mask_sql(function: str, v: str, strategy: str, dialect: Spark = SPARK, strict_compat: bool = False) -> str:
    """SQL for the masked value of the SQL expression v."""
    if strategy not in ("partial", "full", "structural", "hash", "redact"):
        return v
    empty = "'****-**-**'" if function == "dob" else "'***'"
    own = _dob(dialect, v, strategy, strict_compat) if function == "dob" else _MASKS[function](dialect, v, strategy)
    return f"case when coalesce({v}, '') = '' then {empty} else {own} end"


def register_mask(name: str, builder: Callable[[Spark, str, str], str]) -> None:
    """Add a mask function: (dialect, SQL of the value, strategy) -> SQL."""
    _MASKS[name] = builder


def mask(column: str, function: str, strategy: str = "partial") -> Column:
    """The mask of a column, by name."""
    return F.expr(mask_sql(function, f"`{column}`", strategy))
