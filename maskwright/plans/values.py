"""Queries of the scalar functions: masks, pseudonyms, validators, over values built from table keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import hashing, masks, validators
from ..functions.dialect import DUCK, SPARK
from ..functions.safe import cast_or_sql

AS_OF = "date '2025-06-15'"

#: Per kind: (table, key, SQL of the value) in words both engines share.
_K = "cast(c_custkey as string)"
_P9, _P16 = f"lpad({_K}, 9, '1')", "lpad(cast(c_custkey * 7919 as string), 16, '4532')"
SOURCES: dict[str, str] = {
    "generic": "c_name",
    "email": f"case when c_custkey % 11 = 0 then 'not-an-email' when c_custkey % 13 = 0 then concat('ab@host', {_K}) else concat('user.', {_K}, '@mail', cast(c_custkey % 7 as string), '.company.com') end",
    "phone": f"case when c_custkey % 3 = 0 then concat('+61 4', lpad({_K}, 2, '0'), ' ', lpad({_K}, 3, '5'), ' 678') when c_custkey % 3 = 1 then concat('0412 ', lpad({_K}, 6, '7')) else concat('+1-', lpad({_K}, 10, '2')) end",
    "ssn": f"case when c_custkey % 5 = 0 then {_P9} else concat(substring({_P9}, 1, 3), '-', substring({_P9}, 4, 2), '-', substring({_P9}, 6, 4)) end",
    "card": f"case when c_custkey % 4 = 0 then {_P16} when c_custkey % 4 = 1 then concat(substring({_P16}, 1, 4), ' ', substring({_P16}, 5, 6), ' ', substring({_P16}, 11, 5)) when c_custkey % 4 = 2 then concat(substring({_P16}, 1, 4), '-', substring({_P16}, 5, 4), '-', substring({_P16}, 9, 4), '-', substring({_P16}, 13, 4)) else {_K} end",
    "address": f"concat({_K}, ' Main Street, Melbourne VIC ', lpad({_K}, 4, '3'))",
    "dob": "case c_custkey % 6 when 0 then concat('19', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(c_custkey % 12 + 1 as string), 2, '0'), '-', lpad(cast(c_custkey % 31 + 1 as string), 2, '0')) when 1 then concat(lpad(cast(c_custkey % 31 + 1 as string), 2, '0'), '/', lpad(cast(c_custkey % 14 as string), 2, '0'), '/19', cast(c_custkey % 90 + 10 as string)) when 2 then concat(cast(c_custkey % 28 + 1 as string), ' May 1986') when 3 then concat('20', lpad(cast(c_custkey % 40 as string), 2, '0'), '-01-15') when 4 then concat(cast(c_custkey % 28 + 1 as string), '.02.1990') else 'no date' end",
    "passport": f"concat('N', lpad({_K}, 7, '1'))",
    "license": f"concat('DL', {_K})",
    "national_id": f"concat('AB', lpad({_K}, 6, '0'), 'C')",
    "bsb": f"case when c_custkey % 3 = 0 then lpad({_K}, 6, '6') when c_custkey % 3 = 1 then concat(lpad({_K}, 4, '0'), '-456') else concat('123 ', lpad(cast(c_custkey % 1000 as string), 3, '0')) end",
    "account": f"case when c_custkey % 7 = 0 then cast(c_custkey % 90 as string) else concat('CUST-', lpad({_K}, 8, '0')) end",
    "tfn": f"case when c_custkey % 3 = 0 then {_P9} when c_custkey % 3 = 1 then '123 456 782' else lpad({_K}, 8, '3') end",
    "abn": f"case when c_custkey % 3 = 0 then '51 824 753 556' else concat('51', lpad({_K}, 9, '824753556')) end",
    "medicare": f"lpad({_K}, 10, '2')",
    "ip": f"case when c_custkey % 4 = 0 then concat('fe80:0:0:0:0:0:0:', {_K}) when c_custkey % 4 = 1 then concat('::', {_K}) when c_custkey % 4 = 2 then concat('10.', cast(c_custkey % 300 as string), '.1.', cast(c_custkey % 256 as string)) else concat('1.2.', {_K}) end",
    "iban": f"case when c_custkey % 4 = 0 then 'GB82 WEST 1234 5698 7654 32' when c_custkey % 4 = 1 then 'DE89370400440532013000' when c_custkey % 4 = 2 then concat('GB82WEST', lpad({_K}, 14, '1')) else concat('GB', {_K}) end",
    "swift": f"case when c_custkey % 2 = 0 then 'CTBAAU2S' else concat('CTBA', {_K}) end",
}

QueryMap = dict[str, Callable[[SparkSession, str], DataFrame]]


def _over_customers(kind: str, columns: dict[str, Callable], results: dict[str, Callable] | None = None, sql: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """The query and its SQL: columns computed from v by builders that take (v, dialect).

    results: builders of structs, whose fields become columns <name>_<field>,
    from one evaluation. sql: a query written by hand instead of one made by the
    builders, over the rows (k, v) called ``given``.
    """
    results = results or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", f"{SOURCES[kind]} as v")
        computed = rows.selectExpr("k", "v", *(f"{b('v', SPARK)} as {name}" for name, b in columns.items()), *(f"{b('v', SPARK)} as _{name}" for name, b in results.items()))
        return computed.selectExpr("k", "v", *columns, *(f"_{name}.{f} as {name}_{f}" for name in results for f in _FIELDS))

    inner = f"SELECT c_custkey AS k, {SOURCES[kind]} AS v FROM customer"
    if sql is not None:
        return run, f"WITH given AS ({inner}) {sql}"
    made = [f"{b('v', DUCK)} AS {name}" for name, b in columns.items()] + [f"({b('v', DUCK)}).{f} AS {name}_{f}" for name, b in results.items() for f in _FIELDS]
    return run, f"SELECT k, v, {', '.join(made)} FROM ({inner})"


_FIELDS = ("is_valid", "confidence", "reason")


def _mask_columns(function: str) -> dict[str, Callable]:
    return {f"{s}_mask": (lambda v, d, s=s: masks.mask_sql(function, v, s, d)) for s in ("partial", "full", "structural", "hash", "redact", "unknown")}


VALIDATORS: dict[str, tuple[str, dict[str, Callable], Callable | None]] = {
    "luhn": ("card", {"ok": validators.luhn}, lambda v, d: validators.validate_sql("creditCard", v, d)),
    "tfn": ("tfn", {"ok": validators.tfn, "nine": validators.tfn_nine}, lambda v, d: validators.validate_sql("australianTFN", v, d)),
    "abn": ("abn", {"ok": validators.abn}, lambda v, d: validators.validate_sql("australianABN", v, d)),
    "iban": ("iban", {"ok": validators.iban, "any_country": validators.iban_any, "format": validators.iban_format}, lambda v, d: validators.validate_sql("iban", v, d)),
    "birth_date": ("dob", {"plausible": lambda v, d: validators.plausible_birth_date(v, AS_OF, d), "format_ok": lambda v, d: validators.birth_date_format(v, AS_OF, d)}, lambda v, d: validators.birth_date(v, AS_OF, d)),
    "email": ("email", {"basic": validators.email_basic, "format": validators.email_format}, validators.email),
    "phone": ("phone", {"ok": validators.phone_format}, None),
    "bsb": ("bsb", {"ok": validators.bsb_format}, None),
    "ip": ("ip", {"v4": validators.ipv4, "v6": validators.ipv6}, None),
}

#: SQL written by hand, apart from the builders, for some functions of each kind; over given(k, v).
BY_HAND = {
    "validate_luhn": r"""
      , digits AS (SELECT k, v, regexp_replace(v, '[^0-9]', '', 'g') AS x FROM given),
      doubled AS (SELECT k, v, x, unnest(range(length(x))) AS i FROM digits),
      sums AS (SELECT k, sum(CASE WHEN i % 2 = 0 THEN n ELSE (2 * n) // 10 + (2 * n) % 10 END) AS total FROM (SELECT k, i, ascii(reverse(x)[i + 1]) - 48 AS n FROM doubled) GROUP BY k),
      checked AS (SELECT k, v, length(x) BETWEEN 13 AND 19 AND total % 10 = 0 AS ok FROM digits JOIN sums USING (k))
      SELECT k, v, ok, ok AS result_is_valid, CASE WHEN ok THEN 0.95::DOUBLE ELSE 0.2::DOUBLE END AS result_confidence, CASE WHEN ok THEN 'Luhn check passed' ELSE 'Luhn check failed' END AS result_reason FROM checked""",
    "validate_bsb": "SELECT k, v, length(regexp_replace(v, '[^0-9]', '', 'g')) = 6 AS ok FROM given",
    "validate_phone": "SELECT k, v, length(regexp_replace(v, '[^0-9]', '', 'g')) IN (7, 8, 9, 10, 11, 12, 13, 14, 15) AS ok FROM given",
    "mask_email": r"""
      , parts AS (SELECT k, v, split_part(v, '@', 1) AS u, split_part(v, '@', 2) AS h, contains(v, '@') AS whole FROM given)
      SELECT k, v,
        CASE WHEN NOT whole THEN '***' ELSE CASE WHEN length(u) > 2 THEN u[1] || repeat('*', length(u) - 2) || u[-1] ELSE '***' END || '@' || CASE WHEN contains(h, '.') THEN h[1] || '***.' || string_split(h, '.')[-1] ELSE '***' END END AS partial_mask,
        CASE WHEN whole THEN '***@***.***' ELSE '***' END AS full_mask, CASE WHEN whole THEN repeat('*', length(u)) || '@' || repeat('*', length(h)) ELSE '***' END AS structural_mask,
        CASE WHEN whole THEN replace(replace(to_base64(unhex(sha256(v))), '+', '-'), '/', '_')[1:8] || '@masked.email' ELSE '***' END AS hash_mask, CASE WHEN whole THEN '[EMAIL REDACTED]' ELSE '***' END AS redact_mask, v AS unknown_mask FROM parts""",
    "mask_account": r"""
      SELECT k, v, CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 THEN '***' || regexp_replace(v, '[^0-9]', '', 'g')[-3:] ELSE '***' END AS partial_mask, '***' AS full_mask, repeat('*', length(v)) AS structural_mask,
        replace(replace(to_base64(unhex(sha256(v))), '+', '-'), '/', '_')[1:8] AS hash_mask, '[ACCOUNT REDACTED]' AS redact_mask, v AS unknown_mask FROM given""",
    "hash_creditCard": r"""
      SELECT k, v, CASE WHEN length(x) < 13 THEN sha256('maskwright-pseudonyms' || v)[1:8] ELSE upper(sha256('cc' || x[1:-5])[1:8]) || '-' || x[-4:] END AS pseudonym,
        replace(replace(to_base64(unhex(sha256(v))), '+', '-'), '/', '_')[1:8] AS short FROM (SELECT k, v, regexp_replace(v, '[^0-9]', '', 'g') AS x FROM given)""",
    "hash_generic": r"""
      SELECT k, v, upper(sha256('generic' || v)[1:8]) AS pseudonym, replace(replace(to_base64(unhex(sha256(v))), '+', '-'), '/', '_')[1:8] AS short, sha256('maskwright-pseudonyms' || v)[1:8] AS salted, sha256('another' || v)[1:12] AS other_salt FROM given""",
}

_HASH_SOURCES = {"email": "email", "phone": "phone", "creditCard": "card", "ssn": "ssn", "dateOfBirth": "dob", "address": "address", "generic": "generic"}


def _registered() -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A mask, a pseudonym, a check and a format of a user's own, registered and used by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        masks.register_mask("customerCode", lambda d, v, s: f"concat('C-', right({v}, 3))")
        hashing.register_hash("customerCode", lambda v, d, salt: f"concat('H-', {hashing.salted(v, salt, 6, d)})")
        validators.register_validator("customerCode", lambda v, d: d.has(f"coalesce({v}, '')", "[02468]$"), 0.7, 0.3, "even", "odd")
        validators.register_format("customerCode", lambda v, d: f"length({v}) = 18")
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", "c_name as v")
        own = rows.selectExpr("k", "v", f"{masks.mask_sql('customerCode', 'v', 'partial')} as mask", f"{hashing.hash_sql('customerCode', 'v', salt='ours')} as hash", f"{validators.validate_sql('customerCode', 'v')} as r", f"{validators.format_sql('customerCode', 'v')} as format_ok")
        return own.selectExpr("k", "v", "mask", "hash", "format_ok", "r.is_valid", "r.confidence", "r.reason")

    return run, r"""SELECT c_custkey AS k, c_name AS v, 'C-' || c_name[-3:] AS mask, 'H-' || sha256('ours' || c_name)[1:6] AS hash, length(c_name) = 18 AS format_ok, c_name[-1:]::INT % 2 = 0 AS is_valid,
      CASE WHEN c_name[-1:]::INT % 2 = 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence, CASE WHEN c_name[-1:]::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS reason FROM customer"""


def _fallbacks() -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Values that can't be read as a number or a date give the fallback."""
    value = "case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then concat(cast(c_custkey as string), ' ') else '1999-02-30' end"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", f"{value} as v")
        return rows.selectExpr("k", f"{cast_or_sql('v', 'int', '-1')} as number", f"cast({cast_or_sql('v', 'date', DATE)} as string) as day")

    return run, """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN c_custkey::INT ELSE -1 END AS number,
      CASE WHEN c_custkey % 3 = 1 AND length(c_custkey::VARCHAR) = 4 THEN c_custkey || '-01-01' ELSE '1970-01-01' END AS day FROM customer"""


DATE = "date'1970-01-01'"


def _queries() -> dict[str, tuple[Callable, str]]:
    out = {"registered_functions": _registered()}
    for function in masks.FUNCTIONS:
        out[f"mask_{function}"] = _over_customers(function, _mask_columns(function), sql=BY_HAND.get(f"mask_{function}"))
    for type_, kind in _HASH_SOURCES.items():
        columns = {"pseudonym": lambda v, d, t=type_: hashing.hash_sql(t, v, d), "short": lambda v, d: hashing.hash_sql("BASE64_SHORT", v, d)}
        if type_ == "email":
            columns["both_parts"] = lambda v, d: hashing.hash_email_sql(v, False, d)
        if type_ == "generic":
            columns["salted"] = lambda v, d: hashing.salted(v, dialect=d)
            columns["other_salt"] = lambda v, d: hashing.salted(v, "another", 12, d)
        out[f"hash_{type_}"] = _over_customers(kind, columns, sql=BY_HAND.get(f"hash_{type_}"))
    for name, (kind, columns, result) in VALIDATORS.items():
        out[f"validate_{name}"] = _over_customers(kind, columns, {"result": result} if result else None, BY_HAND.get(f"validate_{name}"))
    out["fallbacks"] = _fallbacks()
    return out


def queries() -> QueryMap:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _queries().items()}
