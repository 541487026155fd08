import re

import pytest

from maskwright.config import MaskingConfig
from maskwright.functions import registry as reg
from maskwright.operators import detect
from maskwright.plans import detection

from .conftest import SF

# The decision table: prior -> which contexts (0 none, P positive, F field, B both) pass under xml/json, csv, plain text.
TABLE = {
    0.90: ("0PFB", "0PFB", "0PFB"), 0.85: ("0PFB", "0PFB", "0PFB"), 0.80: ("0PFB", "0PFB", "PFB"), 0.75: ("0PFB", "0PFB", "PFB"),
    0.70: ("0PFB", "0PFB", "FB"), 0.65: ("0PFB", "PFB", "FB"), 0.60: ("0PFB", "PFB", "B"), 0.50: ("PFB", "FB", ""),
}


def test_decision_table(spark):
    bonus = {"0": 0.0, "P": 0.1, "F": 0.2, "B": 0.1 + 0.2}
    words = {"0": "zz", "P": "zz user", "F": "zz card", "B": "zz user card"}
    for prior, expected in TABLE.items():
        for structure, passing in zip(("json", "csv", "plain_text"), expected, strict=True):
            need = detect.threshold_of(0.7, structure, "email", "auto")
            df = spark.createDataFrame([(k, w) for k, w in words.items()], "k string, w string")
            rows = df.selectExpr("k", f"{detect.confidence_sql(f'{prior!r}D', '1.0D', 'w')} as c").collect()
            got = "".join(r["k"] for r in sorted(rows, key=lambda r: "0PFB".index(r["k"])) if r["c"] >= need)
            assert got == passing, (prior, structure, bonus)


def test_thresholds():
    assert detect.threshold_of(0.7, "xml", "referenceNumber", "auto") == pytest.approx(0.7)
    assert detect.threshold_of(0.7, "plain_text", "email", "manual") == 0.95
    assert detect.threshold_of(0.3, "json", "email", "auto") == 0.5
    assert detect.threshold_of(0.7, "csv", "email", "strict") == pytest.approx(0.8)


def test_field_name_guard(spark):
    cases = [
        ("<bsb>345-678</bsb>", "bsb", True), ("<bsb>345-678</bsb>", "345-678", False), ('{"accountNumber": "123456"}', "accountNumber", True),
        ('{"account": "accountNumber123"}', "accountNumber123", False), ("accountNumber: 123", "accountNumber", False), ("<tag without closing bracket bsb>123</tag>", "bsb", True),
    ]
    rows = [(t[: t.index(v)], t[t.index(v) + len(v) :], want) for t, v, want in cases]
    df = spark.createDataFrame(rows, "b string, a string, want boolean")
    assert df.where(f"{detect.inside_name_sql('b', 'a')} <> want").count() == 0


def test_anomalies(spark):
    cases = [("111111", "x", 0.2), ("12345", "ssn", 0.3), ("12345", "nmi", 1.0), ("TEST-9", "x", 0.1), ("aaaa", "x", 0.15), ("4929963689861572", "creditCardVisa", 1.0), ("XXXX", "x", 0.1)]
    df = spark.createDataFrame(cases, "v string, t string, want double")
    assert df.where(f"{detect.anomaly_sql('v', 't')} <> want").count() == 0


def test_every_pattern_has_a_hit_and_equals_python(spark):
    from pyspark.sql import functions as F

    from maskwright.functions.spans import spans_sql

    df = detection.texts(spark, SF).where("src <> 'page'")
    texts = {(r["src"], r["id"]): r["text"] for r in df.collect()}
    for name in reg.REGISTRY.types():
        d = reg.REGISTRY.get(name)
        rows = df.select("src", "id", F.explode(F.expr(spans_sql("text", d.java, maybe=d.hint("text", "lower(text)")))).alias("s")).collect()
        got = sorted((r["src"], r["id"], r["s"]["pos"], r["s"]["value"]) for r in rows)
        rx = re.compile(d.source, re.ASCII | (re.IGNORECASE if d.ignore_case else 0))
        want = sorted((s, i, m.start(), m.group()) for (s, i), t in texts.items() for m in rx.finditer(t))
        assert got == want and want, name


def test_many_matches_keep_their_offsets(spark):
    from pyspark.sql import functions as F

    from maskwright.functions.spans import spans_sql

    text = "é1 22, 333 " * 1500
    df = spark.createDataFrame([(text,)], "t string")
    rows = df.select(F.explode(F.expr(spans_sql("t", "[0-9]+"))).alias("s")).select("s.*").collect()
    assert [(r["pos"], r["value"]) for r in rows] == [(m.start(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_places_in_long_texts(spark):
    from maskwright.functions import spans

    text = "é\nab" * 700 + "x" * 3000 + "\n" + "日\n" * 600 + "tail"
    df = spark.createDataFrame([(text,), ("",), ("one",)], "t string").selectExpr("t", f"{spans.parts_sql('t')} as p").selectExpr("t", "p", f"{spans.marks_sql('p')} as m")
    places = [0, 1, 2, 1023, 1024, 1025, 2047, 2048, 2800, 5000, 5799, 5800, 5801, 5802, 6144, len(text) - 1]
    columns = [f"array({spans.line_at_sql('p', 'm', str(i))}, {spans.column_at_sql('p', 'm', str(i))}) as c{i}" for i in places]
    pieces = [(0, 0), (0, 5), (1000, 24), (1000, 25), (1024, 1024), (5, 5000), (len(text) - 3, 3), (0, len(text))]
    cut = [f"{spans.part_sql('p', str(a), str(n))} as p{k}" for k, (a, n) in enumerate(pieces)]
    row = df.selectExpr(*columns, *cut, "t").where("length(t) > 3").first()
    for i in places:
        assert row[f"c{i}"] == [text[:i].count("\n") + 1, i - text[:i].rfind("\n") - 1], i
    assert [row[f"p{k}"] for k in range(len(pieces))] == [text[a : a + n] for a, n in pieces]
    values = spark.createDataFrame([(["b", None, "a", "b", "a", None, "c"],), ([],)], "v array<string>")
    assert [r[0] for r in values.selectExpr(spans.firsts_sql("v")).collect()] == [[True, False, True, False, False, False, True], []]


def test_plain_text_of_a_cdata_section_counts_as_xml(spark):
    df = spark.createDataFrame([(1, "mail a.bc@firm.net now")], "id long, text string")
    plain, inside = (detect.candidates(df, "text", MaskingConfig(inside_cdata=x)).first() for x in (False, True))
    assert plain["structure"] == "plain_text" and inside["structure"] == "xml" and inside["threshold"] < plain["threshold"]


def test_disabled_and_empty(spark):
    df = spark.createDataFrame([(1, "user card 4929963689861572"), (2, None), (3, "")], "id long, text string")
    assert detect.detect(df, "text", MaskingConfig(enabled=False)).count() == 0
    assert [r["id"] for r in detect.detect(df).collect()] == [1]
    assert detect.detect(df.limit(0)).count() == 0 and detect.candidates(df.limit(0)).count() == 0


def test_presets_and_registry():
    assert MaskingConfig(preset="financial").effective_types() == MaskingConfig().effective_types()
    strict = MaskingConfig(preset="strict").effective_types()
    assert strict["custom"] and strict["ipAddress"] and not strict["nmi"]
    registry = reg.Registry()
    registry.register("badge", r"\bBDG\d{4}\b")
    assert registry.has("badge") and registry.get("badge").priority == 37 and registry.get("none") is None
    assert reg.java_regex("[[{]a") == r"[\[{]a"


def test_column_names():
    config = MaskingConfig()
    assert reg.column_type("c_custkey") == "creditCardGeneric" and reg.column_type("MedicareNumber") == "custom"
    assert not reg.is_sensitive_column("MedicareNumber", config) and reg.is_sensitive_column("PatientName", config)
    assert reg.is_sensitive_column("anything", MaskingConfig(allow_list=("email",))) and not reg.is_sensitive_column("Email", MaskingConfig(allow_list=("e-mail",)))
    assert reg.is_sensitive_column("email", MaskingConfig(deny_list=("mail",), allow_list=("email",)))


def test_business_dates(spark):
    df = spark.createDataFrame([("Payment due: ",), ("dob ",)], "b string")
    assert [r[0] for r in df.selectExpr(detect.business_date_sql("b")).collect()] == [True, False]


def test_business_dates_of_whole_texts(spark):
    late = "x" * 500 + " payment on 2024-03-01, " + "y" * 120 + " dob 12/03/1980"
    edge = "premium " + "é" * 91 + " 2024-01-02"  # the word begins 100 characters before the date, below 101
    rows = [(1, late), (2, edge), (3, "." + edge), (4, edge.replace("é", "éé", 1)), (5, "payment without a date"), (6, None)]
    found = detect.business_dates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [
        (1, "12/03/1980", late.index("12/"), False), (1, "2024-03-01", late.index("2024"), True), (2, "2024-01-02", 100, True), (3, "2024-01-02", 101, True), (4, "2024-01-02", 101, False),
    ]


def test_business_dates_query_looks_at_whole_texts(spark, tmp_path):
    from maskwright.plans import tables

    late = "x" * 500 + " payment on 2024-03-01"
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "<p>dob 12/03/1980</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = tables.queries()["business_dates"](spark, str(tmp_path)).where("src <> 'line'").collect()
    assert sorted(tuple(r) for r in found) == [("doc", 1, "2024-03-01", late.index("2024"), True), ("page", 1, "12/03/1980", 7, False)]
