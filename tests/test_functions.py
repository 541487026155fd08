"""Fixtures of the scalar functions, with results written out."""

import hashlib

import pytest

from maskwright.functions import hashing, masks, validators
from maskwright.functions.dialect import DUCK, SPARK

AS_OF = "date '2025-06-15'"


def evaluate(spark, sql_by_name: dict[str, str], values: list):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.selectExpr("i", *(f"{sql} as {name}" for name, sql in sql_by_name.items())).orderBy("i").collect()
    return [tuple(r[1:]) for r in rows]


MASKS = [
    ("email", "john.doe@example.com", "j******e@e***.com", "***@***.***", "********@***********"),
    ("email", "ab@c.d", "***@c***.d", "***@***.***", "**@***"),
    ("email", "nobody", "***", "***", "***"),
    ("phone", "0412 345 678", "041*****78", "***", "041* *** ***"),
    ("phone", "+61 412 345 678", "+61 *******78", "***", "+61 *** *** ***"),
    ("ssn", "123-45-6789", "***-**-6789", "***-**-****", "*" * 11),
    ("card", "4532 1234 5678 9010", "**** **** **** 9010", "***", "*" * 19),
    ("card", "3714 4963 5398 431", "**** **** 8431", "***", "*" * 18),
    ("dob", "1986-05-28", "1986-**-**", "****-**-**", "*" * 10),
    ("dob", "28 May 1986", "** *** 1986", "** *** ****", "*" * 11),
    ("dob", "28/05/1986", "**/**/1986", "**/**/****", "*" * 10),
    ("dob", "x", "****-**-**", "****-**-**", "****-**-**"),
    ("bsb", "123-456", "***-*6", "***", "*" * 7),
    ("account", "CUST-00012345", "***345", "***", "*" * 13),
    ("passport", "N1234567", "N******7", "***", "*" * 8),
    ("national_id", "AB123456C", "AB*****6C", "***", "*" * 9),
    ("ip", "192.168.1.50", "192.*.*.*", "*.*.*.*", "*" * 12),
    ("ip", "fe80:1::2", "fe80:**********", "****:****:****:****", "*" * 9),
    ("iban", "GB82WEST12345698765432", "GB****************5432", "***", "GB" + "*" * 20),
    ("swift", "CTBAAU2S", "CTBA****", "***", "*" * 8),
    ("generic", "abc", "***", "***", "***"),
    ("generic", "abcd", "a**d", "***", "****"),
    ("tfn", "123456782", "*** *** ***", "*** *** ***", "*" * 9),
    ("abn", "51824753556", "** *** *** ***", "** *** *** ***", "*" * 11),
    ("medicare", "2123456701", "**** ***** *", "**** ***** *", "*" * 10),
    ("address", "1 Main St", "[ADDRESS REDACTED]", "[ADDRESS REDACTED]", "*" * 9),
]


@pytest.mark.parametrize("function", sorted({m[0] for m in MASKS}))
def test_masks(spark, function):
    cases = [m for m in MASKS if m[0] == function]
    got = evaluate(spark, {s: masks.mask_sql(function, "v", s) for s in ("partial", "full", "structural")}, [c[1] for c in cases])
    assert got == [c[2:] for c in cases]


def test_masks_of_nothing_and_unknown_strategy(spark):
    for function in masks.FUNCTIONS:
        empty = "****-**-**" if function == "dob" else "***"
        got = evaluate(spark, {"p": masks.mask_sql(function, "v", "partial"), "u": masks.mask_sql(function, "v", "nope")}, [None, "", "Zz9"])
        assert got[0] == (empty, None) and got[1] == (empty, "") and got[2][1] == "Zz9"


def test_birth_dates_never_leak(spark):
    sql = {"h": masks.mask_sql("dob", "v", "hash"), "r": masks.mask_sql("dob", "v", "redact"), "c": masks.mask_sql("dob", "v", "hash", strict_compat=True)}
    (got,) = evaluate(spark, sql, ["1986-05-28"])
    assert got[0].startswith("1986-") and "05-28" not in got[0] and got[1] == "[DOB REDACTED]" and got[2] == "1986-05-28"


def _salted(salt, v, n):
    return hashlib.sha256((salt + v).encode()).hexdigest()[:n]


def test_pseudonyms(spark):
    cases = {
        ("BASE64_SHORT", "abc"): "ungWv48B",
        ("email", "a@b.com"): _salted("email-local", "a", 8) + "@b.com",
        ("email", "a@b@c"): _salted(hashing.DEFAULT_SALT, "a@b@c", 8),
        ("phone", "+61412345678"): "+614-" + _salted("phone", "12345678", 10),
        ("phone", "04 12"): _salted("phone", "0412", 12),
        ("creditCard", "4532-1234-5678-9010"): _salted("cc", "453212345678", 8).upper() + "-9010",
        ("ssn", "12345"): "***-**-****",
        ("dateOfBirth", "28-05-1986"): _salted("dob", "28-05", 4).upper() + "-1986",
        ("address", "123 Main Street, Melbourne VIC 3000"): _salted("address", "123 Main Street, Melbourne VIC", 8).upper() + ", 3000",
        ("address", "nowhere"): _salted("address", "nowhere", 12).upper(),
        ("other", "x"): _salted("generic", "x", 8).upper(),
    }
    for (type_, value), want in cases.items():
        assert evaluate(spark, {"h": hashing.hash_sql(type_, "v")}, [value]) == [(want,)], (type_, value)


VALID = [
    (validators.luhn, ["4532015112830366", "4532-0151-1283-0366", "4532 0151 1283 0366", "5425233430109903", "374245455400126", "0000000000000"], ["4532015112830367", "5425233430109904", "123456789012", "12345678901234567890", "", "1234567890123", "null", None]),
    (validators.tfn, ["123456782", "123 456 782", "123-456-782"], ["123456789", "1234567890", "111111111", "", None]),
    (validators.abn, ["51824753556", "51 824 753 556", "51-824-753-556"], ["51824753557", "61824753556", "5182475355", "518247535567", "", None]),
    (validators.iban, ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606"], ["GB82WEST12345698765433", "GB82WEST", "82WEST12345698765432", "A234567890123456", "", None]),
    (validators.phone_format, ["1234567", "+1 (212) 555-0187"], ["123456", "1234567890123456", None]),
    (validators.bsb_format, ["123-456", "123456"], ["12345", None]),
    (validators.iban_format, ["GB82WEST1234", "GB82 W"], ["gb82WEST", "GB8", None]),
    (validators.ipv4, ["1.2.3.4", "255.255.255.255", "12abc.0.0.1"], ["256.1.1.1", "1.2.3", "a.b.c.d", "-1.2.3.4", "", None]),
    (validators.ipv6, ["::1", "1:2:3:4:5:6:7:8", "fe80::1"], ["1:2:3", "1:2:3:4:5:6:7:g", "", None]),
    (validators.email_basic, ["a@b.c"], ["a@b", "@", None]),
    (validators.email_format, ["a@b.c", " a@b.c "], ["a b@c.d", "a@b", None]),
]


@pytest.mark.parametrize("case", VALID, ids=lambda c: c[0].__name__)
def test_validators(spark, case):
    check, good, bad = case
    got = evaluate(spark, {"ok": check("v")}, good + bad)
    assert [g[0] for g in got] == [True] * len(good) + [False] * len(bad)


def test_birth_dates(spark):
    values = ["1986-05-28", "28/05/1986", "1986-02-30", "1986-13-01", "2008-06-15", "2008-06-14", "2007-06-16", "1900-01-01", "2026-01-01", "1986-05", "not-a-date", "0000-01-01", "", None]
    got = evaluate(spark, {"r": validators.birth_date("v", AS_OF), "p": validators.plausible_birth_date("v", AS_OF)}, values)
    reasons = {v: (g[0]["is_valid"], g[0]["reason"]) for v, g in zip(values, got, strict=True)}
    assert reasons["1986-05-28"] == reasons["28/05/1986"] == reasons["1986-02-30"] == reasons["1986-13-01"] == (True, None)
    assert reasons["2008-06-15"] == (False, "Age < 18") and reasons["2007-06-16"] == (False, "Age < 18")
    assert reasons["1900-01-01"] == (False, "Age > 120") and reasons["2026-01-01"] == (False, "Future date")
    assert reasons["1986-05"] == reasons["not-a-date"] == (False, "Malformed date") and reasons["0000-01-01"] == (False, "Malformed date parts")
    assert reasons[""] == reasons[None] == (False, "Empty or invalid input")
    plausible = {v for v, g in zip(values, got, strict=True) if g[1]}
    assert plausible == {"1986-05-28", "28/05/1986", "2007-06-16"}


def test_email_results(spark):
    got = evaluate(spark, {"r": validators.email("v")}, ["john.doe@company.com", "test@example.com", "user@test.com", "not-an-email", "@example.com", "user@", None])
    assert [g[0]["confidence"] for g in got] == [0.9, 0.2, 0.2, 0.0, 0.0, 0.0, 0.0]
    assert got[1][0]["reason"] == "Test/example email"


def test_columns_named_like_lambda_variables(spark):
    df = spark.createDataFrame([("4532015112830366", "51824753556")], "i_x string, c string")
    assert df.select(validators.validate("i_x", "creditCard").alias("r"), validators.validate("c", "australianABN").alias("q")).first().asDict(True) == {
        "r": {"is_valid": True, "confidence": 0.95, "reason": "Luhn check passed"},
        "q": {"is_valid": True, "confidence": 0.92, "reason": "ABN checksum passed"},
    }


def test_other_salts(spark):
    sql = {"a": hashing.hash_sql("email", "v", salt="theirs"), "b": hashing.hash_sql("creditCard", "v", salt="theirs"), "c": hashing.salted("v", "theirs")}
    assert evaluate(spark, sql, ["a@b@c"]) == [(_salted("theirs", "a@b@c", 8),) * 3]


def test_registering_a_hash_and_a_validator(spark):
    hashing.register_hash("plate", lambda v, d, salt: f"concat('P-', {hashing.salted(v, salt, 4, d)})")
    validators.register_validator("plate", lambda v, d: d.has(f"coalesce({v}, '')", "^[A-Z]{3}$"), 0.8, 0.1, "plate", "no plate")
    validators.register_format("plate", lambda v, d: f"length({v}) = 3")
    sql = {"h": hashing.hash_sql("plate", "v", salt="s"), "ok": f"({validators.validate_sql('plate', 'v')}).reason", "f": validators.format_sql("plate", "v"), "any": validators.format_sql("nothing known", "v")}
    assert evaluate(spark, sql, ["ABC", "abcd"]) == [("P-" + _salted("s", "ABC", 4), "plate", True, True), ("P-" + _salted("s", "abcd", 4), "no plate", False, True)]
    del hashing._HASHES["plate"], validators._RESULTS["plate"], validators._FORMATS["plate"]
    with pytest.raises(KeyError):
        validators.validate_sql("plate", "v")


def test_registering_a_mask(spark):
    masks.register_mask("shout", lambda d, v, s: f"upper({v})")
    assert evaluate(spark, {"m": masks.mask_sql("shout", "v", "partial")}, ["a"]) == [("A",)]
    del masks._MASKS["shout"]
    assert SPARK.name == "spark" and DUCK.name == "duckdb"
