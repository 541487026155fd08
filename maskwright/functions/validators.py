"""Checksum and format validators as SQL expressions; null and empty values are never valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK, Spark, text

# The weights of the checksums.
TFN_8 = (10, 7, 8, 4, 6, 3, 5, 2)
TFN_9 = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
TEST_DOMAINS = ("example.com", "test.com", "sample.com", "localhost", "example.net", "example.org", "noreply@")

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(v: str, d: Spark) -> str:
    return d.replace(f"coalesce({v}, '')", r"\D")


def _trimmed(v: str, d: Spark) -> str:
    return d.replace(f"coalesce({v}, '')", r"^\s+|\s+$")


def luhn(v: str, d: Spark = SPARK) -> str:
    return d.bind("x_", _digits(v, d), f"case when length(x_) between 13 and 19 then {d.luhn('x_')} else false end")


def _weighted(x: str, weights: tuple[int, ...], d: Spark) -> str:
    return d.total(f"length({x})", f"cast(substring({x}, cast(i_ as int), 1) as int) * {d.item(d.array(*weights), 'i_ - 1')}")


def tfn(v: str, d: Spark = SPARK, lengths: tuple[int, ...] = (8, 9)) -> str:
    cases = " ".join(f"when length(x_) = {n} then {_weighted('x_', {8: TFN_8, 9: TFN_9}[n], d)} % 11 = 0" for n in lengths)
    return d.bind("x_", _digits(v, d), f"case {cases} else false end")


def tfn_nine(v: str, d: Spark = SPARK) -> str:
    """Nine digits only."""
    return tfn(v, d, (9,))


def abn(v: str, d: Spark = SPARK) -> str:
    return d.bind("x_", _digits(v, d), f"case when length(x_) = 11 then ({_weighted('x_', ABN, d)} - {ABN[0]}) % 89 = 0 else false end")


def iban(v: str, d: Spark = SPARK, need_country: bool = True) -> str:
    """Blanks out, upper case, 15 to 34 letters or digits, remainder 1 modulo 97."""
    values = d.each(d.chars("concat(substring(x_, 5), substring(x_, 1, 4))"), f"cast({d.position('c_', text(_ALPHABET))} - 1 as int)")
    shape = "^[A-Z]{2}[A-Z0-9]{13,32}$" if need_country else "^[A-Z0-9]{15,34}$"
    body = f"case when {d.has('x_', shape)} then {d.fold(values, '(a_ * case when c_ > 9 then 100 else 10 end + c_) % 97')} = 1 else false end"
    return d.bind("x_", f"upper({d.replace(f"coalesce({v}, '')", r'\s+')})", body)


def iban_any(v: str, d: Spark = SPARK) -> str:
    return iban(v, d, need_country=False)


_YEAR_FIRST, _YEAR_LAST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"


def _with_age(v: str, as_of: str, body: str, d: Spark) -> str:
    """body over p_ (shaped: is it written as a date; y, m, day), b_ (shaped, parts: are they all above 0; born) and e_ (as b_, and the age)."""
    first, last = d.has("x_", _YEAR_FIRST), d.has("x_", _YEAR_LAST)
    parts = {n: f"cast(nullif(case when {first} then {d.first('x_', _YEAR_FIRST, i)} else {d.first('x_', _YEAR_LAST, 4 - i)} end, '') as int)" for i, n in ((1, "y"), (2, "m"), (3, "day"))}
    born = d.day("case when p_.y < 100 then p_.y + 1900 else p_.y end", "p_.m", "p_.day")
    before = f"(month({as_of}) < month(b_.born) or (month({as_of}) = month(b_.born) and day({as_of}) < day(b_.born)))"
    age = f"(year({as_of}) - year(b_.born) - case when {before} then 1 else 0 end)"
    with_age = d.bind("e_", d.record(shaped="b_.shaped", parts="b_.parts", born="b_.born", age=age), body)
    with_born = d.bind("b_", d.record(shaped="p_.shaped", parts="(p_.y > 0 and p_.m > 0 and p_.day > 0)", born=born), with_age)
    return d.bind("x_", _trimmed(v, d), d.bind("p_", d.record(shaped=f"({first} or {last})", **parts), with_born))


def birth_date(v: str, as_of: str, d: Spark = SPARK) -> str:
    """Struct (is_valid, confidence, reason); days and months may run over, as of a given date."""

    def result(ok: bool, confidence: float, reason: str | None) -> str:
        return d.record(is_valid="true" if ok else "false", confidence=f"cast({confidence} as double)", reason="cast(null as string)" if reason is None else text(reason))

    body = (
        f"case when coalesce({v}, '') = '' then {result(False, 0.0, 'Empty or invalid input')} when not e_.shaped then {result(False, 0.0, 'Malformed date')} "
        f"when not e_.parts then {result(False, 0.0, 'Malformed date parts')} when e_.born > {as_of} then {result(False, 0.2, 'Future date')} "
        f"when e_.age < 18 then {result(False, 0.2, 'Age < 18')} when e_.age > 120 then {result(False, 0.2, 'Age > 120')} else {result(True, 0.95, None)} end"
    )
    return _with_age(v, as_of, body, d)


def birth_date_format(v: str, as_of: str, d: Spark = SPARK) -> str:
    """Whether the exact age is 0 to 129."""
    return _with_age(v, as_of, "case when e_.shaped and e_.parts then e_.age >= 0 and e_.age < 130 else false end", d)


def plausible_birth_date(v: str, as_of: str, d: Spark = SPARK) -> str:
    """A true calendar date, the difference of years 18 to 120."""
    parts = d.split(v, "[-/]")
    a, b, c = (f"coalesce({d.item(parts, i)}, '')" for i in range(3))

    def number(x: str) -> str:
        return f"cast(nullif({d.first(x, r'^\s*\d+')}, '') as int)"

    year = number(f"case when length({a}) = 4 then {a} else {c} end")
    month, day = number(b), number(f"case when length({a}) = 4 then {c} else {a} end")
    real = f"month({d.day(year, month, day)}) = {month} and day({d.day(year, month, day)}) = {day} and {month} between 1 and 12 and {day} between 1 and 31"
    return f"coalesce(case when {d.size(parts)} = 3 and {b} <> '' and {a} <> '' and {c} <> '' and (length({a}) = 4 or length({c}) = 4) then {real} and {year} >= 100 and year({as_of}) - {year} between 18 and 120 else false end, false)"


_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def email(v: str, d: Spark = SPARK) -> str:
    """Struct (is_valid, confidence, reason)."""
    x = "x_"
    test = " or ".join(f"{d.position(text(t), x)} > 0" for t in TEST_DOMAINS)
    none = "cast(null as string)"

    def result(ok: str, confidence: float, reason: str) -> str:
        return d.record(is_valid=ok, confidence=f"cast({confidence} as double)", reason=reason)

    body = f"case when coalesce({v}, '') = '' then {result('false', 0.0, "'Empty or invalid'")} when not {d.has(x, _EMAIL)} then {result('false', 0.0, "'Malformed email'")} when {test} then {result('false', 0.2, "'Test/example email'")} else {result('true', 0.9, none)} end"
    return d.bind("x_", f"lower({_trimmed(v, d)})", body)


def email_basic(v: str, d: Spark = SPARK) -> str:
    return d.has(f"coalesce({v}, '')", r"@.+\..+")


def email_format(v: str, d: Spark = SPARK) -> str:
    return d.has(_trimmed(v, d), _EMAIL)


def phone_format(v: str, d: Spark = SPARK) -> str:
    return f"length({_digits(v, d)}) between 7 and 15"


def bsb_format(v: str, d: Spark = SPARK) -> str:
    return f"length({_digits(v, d)}) = 6"


def iban_format(v: str, d: Spark = SPARK) -> str:
    return d.has(d.replace(f"coalesce({v}, '')", r"\s"), r"^[A-Z]{2}\d{2}[A-Z0-9]{1,30}$")


def ipv4(v: str, d: Spark = SPARK) -> str:
    """Four parts that begin with a number up to 255; what follows the number doesn't matter."""
    parts = d.split(f"coalesce({v}, '')", r"\.")
    lead = d.first("c_", r"^\s*[+-]?0*(\d{1,9})", 1)
    negative = d.has("c_", r"^\s*-0*[1-9]")
    return f"({d.size(parts)} = 4 and {d.all(parts, f'coalesce(cast(nullif({lead}, {text("")}) as int), 999) <= 255 and not {negative}')})"


def ipv6(v: str, d: Spark = SPARK) -> str:
    x = f"coalesce({v}, '')"
    groups = d.split(x, ":")
    return f"case when {d.position("'::'", x)} > 0 then {d.size(groups)} <= 8 else {d.size(groups)} = 8 and {d.all(groups, d.has('c_', '^[0-9A-Fa-f]{1,4}$'))} end"


# Confidence if passed and if failed, and the reasons.
_RESULTS: dict[str, tuple[Callable[[str, Spark], str], float, float, str, str]] = {
    "creditCard": (luhn, 0.95, 0.2, "Luhn check passed", "Luhn check failed"),
    "australianTFN": (tfn, 0.92, 0.2, "TFN checksum passed", "TFN invalid"),
    "australianABN": (abn, 0.92, 0.2, "ABN checksum passed", "ABN invalid"),
    "iban": (iban, 0.9, 0.1, "IBAN checksum OK", "IBAN invalid"),
}

#: Whether a value has the format of a type.
_FORMATS: dict[str, Callable[[str, Spark], str]] = {
    "creditCard": luhn, "australianTFN": tfn, "australianABN": abn, "iban": iban_format, "email": email_format, "phone": phone_format,
    "australianBSB": bsb_format, "ipv4": ipv4, "ipv6": ipv6,
}


def register_validator(type_: str, check: Callable[[str, Spark], str], passed: float, failed: float, yes: str, no: str) -> None:
    """Add or replace the check of a type: (SQL of the value, dialect) -> SQL; with its confidences and reasons."""
    _RESULTS[type_] = (check, passed, failed, yes, no)


def register_format(type_: str, check: Callable[[str, Spark], str]) -> None:
    """Add or replace the format of a type: (SQL of the value, dialect) -> SQL."""
    _FORMATS[type_] = check


def format_sql(type_: str, v: str, d: Spark = SPARK) -> str:
    """Whether v has the format of the type; types without one accept everything."""
    return _FORMATS[type_](v, d) if type_ in _FORMATS else "true"


def validate_sql(type_: str, v: str, d: Spark = SPARK, as_of: str = "current_date()") -> str:
    """Struct (is_valid, confidence, reason) for creditCard, australianTFN, australianABN, dateOfBirth, email, iban and registered types."""
    if type_ in _RESULTS:
        check, passed, failed, yes, no = _RESULTS[type_]
        confidence = f"case when ok_ then cast({passed} as double) else cast({failed} as double) end"
        return d.bind("ok_", check(v, d), d.record(is_valid="ok_", confidence=confidence, reason=f"case when ok_ then {text(yes)} else {text(no)} end"))
    if type_ == "dateOfBirth":
        return birth_date(v, as_of, d)
    if type_ == "email":
        return email(v, d)
    raise KeyError(type_)


def validate(column: str, type_: str, as_of: str = "current_date()") -> Column:
    return F.expr(validate_sql(type_, f"`{column}`", as_of=as_of))
