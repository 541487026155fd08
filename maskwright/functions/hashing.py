"""Deterministic pseudonyms: salted SHA-256, in forms that keep a value's format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK, Spark, text

#: The salt of values without a form of their own. Pseudonyms only agree under the same salt, so a
#: caller that has to agree with another tool's passes that tool's.
DEFAULT_SALT = "maskwright-pseudonyms"


def salted(v: str, salt: str = DEFAULT_SALT, length: int = 8, dialect: Spark = SPARK) -> str:
    return f"substring({dialect.sha256(f'concat({text(salt)}, {v})')}, 1, {length})"


def _email(v: str, d: Spark, salt: str, preserve_domain: bool = True) -> str:
    parts = d.split(v, "@")
    local, domain = (f"coalesce({d.item(parts, i)}, '')" for i in (0, 1))
    own = domain if preserve_domain else f"concat({salted(domain, 'email-domain', dialect=d)}, '.com')"
    return f"case when {d.size(parts)} <> 2 or {local} = '' or {domain} = '' then {salted(v, salt, dialect=d)} else concat({salted(local, 'email-local', dialect=d)}, '@', {own}) end"


def _phone(v: str, d: Spark, salt: str) -> str:
    code = d.first(v, r"^\+(\d{1,3})", 1)
    rest = d.replace(f"substring({v}, length({code}) + 2)", r"\D")
    return f"case when {code} <> '' then concat('+', {code}, '-', {salted(rest, 'phone', 10, d)}) else {salted(d.replace(v, r'\D'), 'phone', 12, d)} end"


def _card(v: str, d: Spark, salt: str) -> str:
    digits = d.replace(v, r"\D")
    return f"case when length({digits}) < 13 then {salted(v, salt, dialect=d)} else concat(upper({salted(f'left({digits}, cast(length({digits}) - 4 as int))', 'cc', 8, d)}), '-', right({digits}, 4)) end"


def _ssn(v: str, d: Spark, salt: str) -> str:
    digits = d.replace(v, r"\D")
    own = f"upper({salted(f'left({digits}, 5)', 'ssn', 5, d)})"
    return f"case when length({digits}) <> 9 then '***-**-****' else concat(substring({own}, 1, 3), '-', substring({own}, 4, 2), '-', substring({digits}, 6)) end"


def _dob(v: str, d: Spark, salt: str) -> str:
    parts = d.split(v, "[-/]")
    a, b, c = (f"coalesce({d.item(parts, i)}, '')" for i in range(3))

    def rest(x: str, y: str) -> str:
        return f"upper({salted(f"concat({x}, '-', {y})", 'dob', 4, d)})"

    return f"case when {d.size(parts)} <> 3 then {salted(v, salt, dialect=d)} when length({a}) = 4 then concat({a}, '-', {rest(b, c)}) when length({c}) = 4 then concat({rest(a, b)}, '-', {c}) else {salted(v, salt, dialect=d)} end"


def _address(v: str, d: Spark, salt: str) -> str:
    code = d.first(v, r"(?:^|[^0-9A-Za-z_])(\d{4,5})(?:$|[^0-9A-Za-z_])", 1)
    at = d.position(code, v)
    without = f"concat(substring({v}, 1, cast({at} - 1 as int)), substring({v}, cast({at} + length({code}) as int)))"
    trimmed = d.replace(without, r"^\s+|\s+$")
    return f"case when {code} <> '' then concat(upper({salted(trimmed, 'address', 8, d)}), ', ', {code}) else upper({salted(v, 'address', 12, d)}) end"


def _generic(v: str, d: Spark, salt: str) -> str:
    return f"upper({salted(v, 'generic', 8, d)})"


_HASHES: dict[str, Callable[[str, Spark, str], str]] = {
    "email": _email, "phone": _phone, "creditCard": _card, "creditCardVisa": _card, "creditCardMastercard": _card,
    "creditCardAmex": _card, "creditCardGeneric": _card, "ssn": _ssn, "dateOfBirth": _dob, "address": _address, "generic": _generic,
}
TYPES = tuple(_HASHES)


def register_hash(type_: str, builder: Callable[[str, Spark, str], str]) -> None:
    """Add or replace the pseudonym of a type: (SQL of the value, dialect, salt) -> SQL."""
    _HASHES[type_] = builder


def hash_sql(type_: str, v: str, dialect: Spark = SPARK, salt: str = DEFAULT_SALT) -> str:
    """SQL for the pseudonym of v as the type; other types have the generic one. "BASE64_SHORT": unsalted, 8 characters."""
    if type_ == "BASE64_SHORT":
        return dialect.short_hash(v)
    return _HASHES.get(type_, _generic)(v, dialect, salt)


def hash_email_sql(v: str, preserve_domain: bool, dialect: Spark = SPARK, salt: str = DEFAULT_SALT) -> str:
    return _email(v, dialect, salt, preserve_domain)


def pseudonym(column: str, type_: str = "generic", salt: str = DEFAULT_SALT) -> Column:
    return F.expr(hash_sql(type_, f"`{column}`", salt=salt))
