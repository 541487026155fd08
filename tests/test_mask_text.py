import pytest

from maskwright.config import CustomPattern, MaskingConfig
from maskwright.operators import mask_text
from maskwright.plans.detection import LINES

from . import model
from .conftest import SF

AS_OF = "2025-06-15"
XML = """<orders><order id="1">
<customerEmail>alice.smith@company.com</customerEmail>
<notes><![CDATA[Call 0412 345 678 or mail bob@firm.org
second line 4532 1234 5678 9010 and BSB 063-123]]></notes>
<description>  <![CDATA[bob@firm.org at start is left]]> </description>
<copy><![CDATA[Call 0412 345 678 or mail bob@firm.org
second line 4532 1234 5678 9010 and BSB 063-123]]></copy>
<blank><![CDATA[   ]]></blank>
<bsb>062-000</bsb><total>100</total><dob>1986-05-28</dob>
</order></orders>"""
JSON = """{"customers": [{"id": "C1", "email": "a.b@corp.com", "phone": "0412 345 678", "card": 4532123456789010,
 "banking": {"bsb": "063-123", "accountNumber": "12345678"}, "tax": {"tfn": "123 456 782"}, "name": "Jo"},
 {"id": "C2", "email": "a.b@corp.com", "note": "swift CTBAAU2S, iban DE89370400440532013000"}]}"""
TEXTS = [*LINES, XML, JSON, "", None, "no data", "user 4929963689861572 and user 4929963689861572", '"x": 12-34', "<a>1</a>" * 3]
CONFIGS = [
    MaskingConfig(as_of=AS_OF),
    MaskingConfig(as_of=AS_OF, strategy="full", confidence_threshold=0.5),
    MaskingConfig(as_of=AS_OF, strategy="structural", types={"ipAddress": True, "custom": True}, confidence_threshold=0.5),
    MaskingConfig(as_of=AS_OF, preset="privacy", mode="strict", custom_patterns=(CustomPattern("w", r"\b[Ww]ay\b", "[W]"), CustomPattern("off", "a", "b", False))),
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_equals_model(spark, cfg):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = TEXTS + docs
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(8)
    for row in mask_text.with_masked_text(df, "text", cfg).collect():
        text = texts[row["id"]]
        if text is None:
            assert row["masked_text"] is None and row["detections"] == []
            continue
        want, found = model.mask_text(text, cfg)
        got = [(d["type"], d["original_value"], d["masked_value"], d["line"], d["column"]) for d in row["detections"]]
        assert got == found, text
        assert row["masked_text"] == want
        assert row["masking_applied"] == bool(found)


def test_disabled_is_identity(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = mask_text.with_masked_text(df, "text", MaskingConfig(enabled=False)).collect()
    assert all(r["masked_text"] == r["text"] and not r["masking_applied"] for r in rows)


def test_cdata_keeps_length_and_lines(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "text string")
    for r in mask_text.mask_cdata(df, "text").collect():
        assert len(r["masked"]) == len(r["text"]) and r["masked"].count("\n") == r["text"].count("\n")


def test_second_occurrence_stays_clear_unless_safe(spark):
    text = "user card 4929963689861572 and again 4929963689861572"
    df = spark.createDataFrame([(text,)], "text string")
    assert mask_text.with_masked_text(df).first()["masked_text"].count("4929963689861572") == 1
    assert "4929963689861572" not in mask_text.with_masked_text(df, safe=True).first()["masked_text"]


def test_very_many_matches(spark):
    """Thousands of edits that keep or change the length, over many lines, equal the model."""
    text = "".join(f"user mail é.{i}@corp.org and card 4929963689861572 of ann{i}@firm.net\n" for i in range(1500))
    df = spark.createDataFrame([(text,)], "text string")
    row = mask_text.with_masked_text(df, "text", MaskingConfig(as_of=AS_OF)).first()
    want, found = model.mask_text(text, MaskingConfig(as_of=AS_OF))
    assert row["masked_text"] == want and not row["has_overlap"]
    assert [(d["type"], d["original_value"], d["masked_value"], d["line"], d["column"]) for d in row["detections"]] == found and len(found) > 2900


def test_messages(spark):
    df = spark.createDataFrame([("mail private a.bc@corp.org, user d.ef@corp.org, user card 4929963689861572 x",), ("none",)], "text string")
    cfg = MaskingConfig(include_stats=True)
    out = mask_text.with_stats(mask_text.with_masked_text(df, "text", cfg), "masked_text", cfg)
    rows = out.selectExpr("output", f"{mask_text.notification_sql()} as note", f"{mask_text.indicator_sql()} as mark").collect()
    assert rows[0]["output"].endswith("\n// Data masked: 2 emails, 1 creditCardVisa")
    assert rows[0]["note"] == "Copied with 3 items masked: 2 emails, 1 creditCardVisa" and rows[0]["mark"] == "3 masked"
    assert rows[1]["output"] == "none" and rows[1]["note"] is None and rows[1]["mark"] == "Masking Active"


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("x", "y", "user 4929963689861572")], "_mt_text string, _scored string, text string")
    row = mask_text.mask_text(df).first()
    assert row["_mt_text"] == "x" and row["_scored"] == "y" and row["text"] == "user **** **** **** 1572"
