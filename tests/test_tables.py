import random

import pytest

from maskwright.config import MaskingConfig, RenderConfig, next_output_mode
from maskwright.functions import delimited as dl
from maskwright.operators import location, render, tabular
from maskwright.sources import lines as sources


def test_parsers_equal_a_state_machine(spark):
    def machine(line: str, delimiter: str, quotes: str) -> list[str]:
        out, cur, open_, i = [], "", "", 0
        while i < len(line):
            c = line[i]
            if open_:
                if c == open_ and line[i + 1 : i + 2] == open_:
                    cur, i = cur + c, i + 1
                elif c == open_:
                    open_ = ""
                else:
                    cur += c
            elif c in quotes:
                open_ = c
            elif c == delimiter:
                out.append(cur.strip())
                cur = ""
            else:
                cur += c
            i += 1
        return [*out, cur.strip()]

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \"\"',|;\t") for _ in range(rng.randrange(0, 16))) for _ in range(1500)] + ['"John Doe",john@example.com,"555-1234"', '"Say ""Hello""",world', "it's, fine", '"' * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string").repartition(8)
    for delimiter in (",", "|", "\t"):
        rows = df.selectExpr("i", f"{dl.parse('line', delimiter)} as a", f"{dl.parse('line', delimiter, True)} as b").collect()
        for r in rows:
            t = texts[r["i"]]
            assert r["a"] == machine(t, delimiter, '"') == location.parse_line(t, delimiter), repr(t)
            assert r["b"] == machine(t, delimiter, "\"'"), repr(t)


def test_first_line_delimiter(spark):
    cases = [("a,b,c", ","), ("a\tb", "\t"), ("a|b", "|"), ("a;b\nx,y,z", ";"), ("", ","), ("a:b", ":"), ("a;b,c", ","), ("a;;b,c", ";")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert df.where(f"{dl.first_line_delimiter('t')} <> want").count() == 0


def test_numbers(spark):
    numbers = ["1", " 2.5 ", "1e3", ".5", "5.", "-3", "0x1F", "Infinity", "0b11"]
    others = ["", " ", "12d", "1,000", "abc", "--1", "inf", "0x", "NaN"]
    df = spark.createDataFrame([(x,) for x in numbers + others], "v string")
    rows = df.selectExpr(f"{dl.is_number('v')} as ok", f"{dl.number('v')} as n", f"{dl.is_number_or_blank('v')} as b").collect()
    assert [r["ok"] for r in rows] == [True] * len(numbers) + [False] * len(others)
    assert [r["n"] for r in rows][: len(numbers)] == [1.0, 2.5, 1000.0, 0.5, 5.0, -3.0, 31.0, float("inf"), 3.0]
    assert [r["b"] for r in rows][len(numbers) :] == [True, True] + [False] * 7


def test_profile(spark):
    df = spark.createDataFrame([("yes", "1.5", "x", None), ("no", "2", "y", None), ("1", "n/a", "x", None), ("true", "4", "x", None)], "flag string, num string, cat string, empty string")
    got = {r["column"]: r for r in tabular.profile(df).collect()}
    assert got["flag"]["type"] == "Boolean" and got["flag"]["alignment"] == "center"
    assert got["num"]["type"] == "Float" and (got["num"]["min"], got["num"]["max"], got["num"]["mean"]) == (1.5, 4.0, 2.5)
    assert got["cat"]["type"] == "String" and not got["cat"]["is_category"] and got["cat"]["mean"] is None
    assert got["empty"]["alignment_filled"] == "left" and got["empty"]["n_distinct"] == 1
    assert all(r["n"] == 0 and r["type"] == "String" for r in tabular.profile(df.limit(0)).collect())


def test_mask_delimited(spark):
    lines = spark.createDataFrame([("Bob,bob.b@corp.org,'a, b',063-123",), ("",), ("Al, ,x",)], "line string")
    rows = tabular.mask_delimited(lines, "Name,Email,Notes,BSB").collect()
    assert rows[0]["masked_line"] == "***,b***b@c***.org,a, b,***-*3" and [d["type"] for d in rows[0]["detections"]] == ["custom", "email", "australianBSB"]
    assert rows[0]["detections"][1]["column_context"].asDict() == {"name": "Email", "index": 1}
    assert rows[1]["masked_line"] == "" and rows[2]["masked_line"] == "***,,x"
    untouched = tabular.mask_delimited(lines, "Notes,Status", MaskingConfig(allow_list=("notes", "status"))).first()
    assert untouched["masked_line"] == "Bob,bob.b@corp.org,a, b,063-123" and untouched["detections"] == []


def test_mask_columns_keeps_blanks(spark):
    df = spark.createDataFrame([("Jo Doe", None, " "), ("", "x", "555-123-4567")], "name string, status string, phone string")
    assert [tuple(r) for r in tabular.mask_columns(df).collect()] == [("J****e", None, " "), ("", "x", "555-" + "*" * 5 + "67")]


def test_numbered_lines(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "t string")
    assert df.selectExpr(f"{render.numbered_lines('t', '10')} as x").first()[0] == "10: a\n11: b\n12: c"
    assert df.selectExpr(f"{render.numbered_lines('t', '8', padding=True)} as x").first()[0] == " 8: a\n 9: b\n10: c"
    assert df.selectExpr(f"{render.numbered_lines('t', '8', show=False)} as x").first()[0] == "a\nb\nc"


def test_html(spark):
    df = spark.createDataFrame([('<script>alert("hello & goodbye");</script>',)], "t string")
    assert df.selectExpr(f"{render.escape_html('t')} as x").first()[0] == "&lt;script&gt;alert(&quot;hello &amp; goodbye&quot;);&lt;/script&gt;"
    code = spark.createDataFrame([("const a = 1;",)], "t string")
    assert code.selectExpr(f"{render.highlight('t', 'javascript')} as x").first()[0].startswith('<span style=<span style="color: #CE9178">"color: #569CD6"</span>>const</span>')


def test_render_formats(spark):
    df = spark.createDataFrame([("a.py", 3, 4, "A > f", "x\ny")], "name string, start_line int, end_line int, context string, text string")
    assert render.render(df).first()["output"] == "// a.py:3-4 (A > f)\n3: x\n4: y"
    assert render.render(df, "markdown", language="python").first()["output"] == "// a.py:3-4 (A > f)\n```python\n3: x\n4: y\n```"
    assert render.render(df, "ansi", RenderConfig(show_context_path=False)).first()["output"] == "\x1b[32m// a.py:3-4\x1b[0m\n3: x\n4: y"
    assert "<pre" in render.render(df, "html").first()["output"]


def test_tables():
    table = render.ascii_table([["1", "yes"], ["22", "no"]], ["id", "flag"])
    assert table.split("\n") == ["┌───────┬───────┐", "│ id    │ flag  │", "├───────┼───────┤", "│     1 │  yes  │", "│    22 │  no   │", "└───────┴───────┘"]
    cut = render.ascii_table([["a", "b", "c"]] * 3, ["x", "y", "z"], RenderConfig(table_max_columns=2, table_max_rows=1))
    assert "(2 more)" in cut and cut.endswith("... 2 more rows (increase maxRows to see all)")
    assert render.simple_table(["a"], [["bcd"], [""]]).split("\n")[3:5] == ["│ bcd │", "│     │"]
    assert render.ascii_table([], ["a"]) == ""


def test_reports(spark):
    df = spark.createDataFrame([(2, "k1", "5"), (3, "k2", "7")], "number int, key string, size string")
    smart = [r["line"] for r in render.smart_report(df, "t.csv", "number").orderBy("seq").collect()]
    assert smart == ["// t.csv:2-3", "// Columns: key, size", "// Types: String, Integer", "", "2: k1, 5", "3: k2, 7"]
    detailed = [r["line"] for r in render.detailed_report(df, "t.csv", "number").orderBy("seq").collect()]
    assert "  size: min=5.00, max=7.00, avg=6.00" in detailed and detailed[-1] == "// Summary: 2 rows × 2 columns" and "//   Identifier columns: key" in detailed
    assert render.table_report(df, "t.csv").startswith("// t.csv:1-3 | 2 records\n")


JSON = '{"users": [{"name": "Jo", "tags": ["a", "b"]}, {"name": "Al"}], "n": 3}'


@pytest.mark.parametrize(
    ("text", "at", "want"),
    [
        (JSON, JSON.index("Jo"), "users[0].name"), (JSON, JSON.index('"b"'), "users[0].tags[1]"), (JSON, JSON.index("Al"), "users[1].name"),
        (JSON, JSON.index("3}"), "n"), (JSON, 0, None), ("[1, 2]", 4, None), ("", 0, None), (None, 0, None), ('{"a\\"b": {"c": 1', 15, 'a"b.c'), ('{"open', 3, None),
    ],
)
def test_json_path(text, at, want):
    assert location.json_path(text, at) == want


XML = "<root><items><item>a</item><item>b</item></items><other><item>c</item></other></root>"


def test_xml_path():
    assert location.xml_path(XML, XML.index("b<")) == "root > items > item[1]"
    assert location.xml_path(XML, XML.index("c<")) == "root > other > item[0]"
    assert location.xml_path(XML, XML.index("c<"), "global") == "root > other > item[2]"
    assert location.xml_path("", 0) is None and location.xml_path(None, 0) is None


def test_delimited_columns():
    fields = ["alpha", "beta", "gamma"]
    assert location.column_range(fields, 0, 5) == (0, 0) and location.column_range(fields, 2, 10) == (1, 1)
    assert location.column_range(fields, 5, 16) == (1, 2) and location.inclusive_column_range(fields, 2, 7) == (0, 1)
    text = "Name,Email,Phone\nBob,b@c.d,123\nAl,a@c.d,456"
    assert location.delimited_context(text, (1, 0), (1, 3)) == "CSV (Comma-Separated) > Name"
    assert location.delimited_context("\nx", (1, 0), (1, 1)) == "CSV (Comma-Separated)"
    full = ["a,b,c", "d,e,f"]
    assert location.aligned_lines(full, ["b,c", "d,e,f"], 2, 2, ",") == (["b,c", "d,e,f"], 1, [1, 0])
    assert location.aligned_lines(full, full, 1, 0, ",") == (full, 0, [0, 0])


def test_with_context(spark):
    rows = [("json", "a.json", JSON, 0, JSON.index("Jo")), ("json", "a.json", "[]", 0, 0), ("xml", "b.xml", XML, 0, XML.index("b<")), ("python", "c.py", "def f():\n    x", 1, 4), ("text", "d.txt", "x", 0, 0), ("json", "e.json", "{}\n" * 3000, 2, 0), ("csv", "f.csv", "a,b", 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, language string, path string, text string, line int, character int")
    got = [r["context"] for r in location.with_context(df).orderBy("i").collect()]
    assert got == ["users[0].name", "JSON", "root > items > item[1]", "f", None, "JSON (Large File)", None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    rows = sources.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(0, "one"), (1, "two"), (2, "")]
    assert sources.header_line(sources.read_lines(spark, str(tmp_path)), "path").first()["header"] == "one"
    df = spark.createDataFrame([("ab\ncd\nef", 0, 1, 2, 1), ("ab\ncd", 1, 1, 1, 1), ("ab", 5, 0, 5, 0)], "text string, start_line int, start_char int, end_line int, end_char int")
    assert [r["selected"] for r in sources.select_text(df).collect()] == ["b\ncd\ne", "cd", ""]
    sources.write_text(spark.createDataFrame([(1, "x"), (0, "y")], "k int, output string"), str(tmp_path / "out"), order_by="k")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["y", "x"]


def test_output_modes():
    assert [next_output_mode(m) for m in ("minimal", "smart", "table", "detailed", "?")] == ["smart", "table", "detailed", "minimal", "minimal"]


def test_mask_delimited_texts(spark):
    df = spark.createDataFrame([("Name,Email\nBob,b.b@c.org\n,x", None), ("Bob,b.b@c.org", "Notes,Mail"), (None, None)], "t string, h string")
    rows = tabular.mask_delimited_texts(df, "t", header_col="h").collect()
    assert rows[0]["masked_text"] == "Name,Email\n***,b*b@c***.org\n,***" and [(d["line"], d["column"]) for d in rows[0]["detections"]] == [(2, 0), (2, 1), (3, 1)]
    assert rows[1]["masked_text"] == "Bob,b*b@c***.org" and rows[1]["detections"][0]["column_context"]["name"] == "Mail"
    assert rows[2]["masked_text"] is None
    denied = tabular.mask_delimited_texts(df, "t", MaskingConfig(deny_list=("notes",), allow_list=("mail",)), "h").collect()[1]
    assert denied["masked_text"] == "***,b.b@c.org"


def test_copy_with_context(spark):
    from maskwright.operators.copying import copy_with_context

    csv = "Name,Email,Phone\nBob Roe,b.b@c.org,555-123-4567\nAl Poe,a.a@c.org,555-765-4321"
    rows = [
        ("a.csv", "a.csv", "csv", csv, 1, 8, 2, 15),
        ("b.json", "b.json", "json", '{"user": {"card": "4929963689861572"}}', 0, 20, 0, 20),
        ("c.py", "c.py", "python", "def f():\n    x = 1\n    y = 2", 1, 0, 2, 9),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, path string, language string, text string, start_line int, start_char int, end_line int, end_char int")
    got = [r["output"] for r in copy_with_context(df, MaskingConfig()).orderBy("i").collect()]
    assert got[0] == "// a.csv:2-3 (CSV (Comma-Separated) > Name, Email, Phone)\n2: b*b@c***.org,555-*****67\n3: A****e,a*a@c***.or"
    assert got[1] == '// b.json:1 (user.card)\n1: {"user": {"card": "**** **** **** 1572"}}'
    assert got[2] == "// c.py:2-3 (f)\n2: x = 1\n3: y = 2"
    clear = [r["output"] for r in copy_with_context(df, None, fmt="markdown").orderBy("i").collect()]
    assert clear[2] == "// c.py:2-3 (f)\n```python\n2: x = 1\n3: y = 2\n```" and "4929963689861572" in clear[1]
    assert copy_with_context(df.limit(0)).count() == 0


def test_copy_with_context_query_takes_whole_texts(spark, tmp_path):
    import hashlib

    from maskwright.plans import tables

    texts = ["user one\nline two\nuser mail b.b@c.org", "user mail b.b@c.org", "a\n", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["digest"], r["n"]) for r in tables.queries()["copy_with_context"](spark, str(tmp_path)).collect()}
    want = ["// doc0.txt:1-3\n1: user one\n2: line two\n3: user mail b*b@c***.org", "// doc1.txt:1\n1: user mail b*b@c***.org", "// doc2.txt:1-2\n1: a\n2: ", "// doc3.txt:1\n1: "]
    assert got == {i: (hashlib.sha256(w.encode()).hexdigest(), n) for i, (w, n) in enumerate(zip(want, (1, 1, 0, 0), strict=True))}


def test_union_of_ranges(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 0, 1), (2, 5, 5)], "f int, start_column int, end_column int")
    assert sorted(tuple(r) for r in tabular.union_ranges(df, "f").collect()) == [(1, 0, 3), (2, 5, 5)]


@pytest.mark.parametrize("table", ["lineitem", "orders", "events"])
def test_whole_profiles_take_every_column(spark, table):
    from maskwright.plans import tables

    from .conftest import SF

    rows = tables.queries()[f"profile_{table}"](spark, SF).orderBy("position").collect()
    assert [r["column"] for r in rows] == spark.read.parquet(f"{SF}/{table}.parquet").columns


CSV = "Name,Segment,Key\nann,A,1\n  \nbob,B,2.5\ncid,A,x"


def _copy(spark, text, start, end, mode, masking=None, language="csv"):
    from maskwright.config import RenderConfig
    from maskwright.operators import copying

    df = spark.createDataFrame([("f.csv", "f.csv", language, text, *start, *end)], "name string, path string, language string, text string, start_line int, start_char int, end_line int, end_char int")
    return copying.copy_with_context(df, masking, RenderConfig(output_mode=mode)).first()["output"]


def test_delimited_selections_as_reports(spark):
    whole = ((0, 0), (4, 7))
    assert _copy(spark, CSV, *whole, "smart") == "// f.csv:1-5\n// Columns: Name, Segment, Key\n// Types: String, String, String\n\n2: ann, A, 1\n3: bob, B, 2.5\n4: cid, A, x"
    assert _copy(spark, CSV, (1, 0), (3, 9), "smart") == "// f.csv:2-4\n// Columns: Segment, Key\n// Types: String, Float\n\n2: ann, A, 1\n3: bob, B, 2.5".replace("Segment, Key", "Column_1, Column_2, Column_3").replace("String, Float", "String, String, Float")
    table = _copy(spark, CSV, *whole, "table").split("\n")
    assert table[0] == "// f.csv:1-5 | 3 records" and table[2] == "┌───────┬─────────┬───────┐" and table[-1] == "// Summary: 3 rows × 3 columns" and len(table) == 11
    detailed = _copy(spark, CSV.replace("x", "4"), *whole, "detailed")
    assert "  Key: min=1.00, max=4.00, avg=2.50" in detailed and "//   Identifier columns: Key" in detailed and "//   Category columns" not in detailed
    assert _copy(spark, "a,b\n \n", (1, 0), (1, 1), "smart") == "// f.csv:2 (CSV (Comma-Separated) > Column 1)\n2:  "  # nothing but blanks: as it is
    assert _copy(spark, "plain text", (0, 0), (0, 5), "table", language="plaintext").startswith("// f.csv:1 | 1 record")  # told by the extension
    from maskwright.config import MaskingConfig

    masked = _copy(spark, "Name;Email\nann smith;a.b@corp.org\n", (0, 0), (1, 23), "smart", MaskingConfig())
    assert "a.b@corp.org" not in masked


def test_a_long_header_is_not_cut(spark):
    from maskwright.config import MaskingConfig

    names = [f"c{i}" for i in range(1200)] + ["Email"]
    text = ",".join(names) + "\n" + ",".join(["x"] * 1200 + ["a.b@corp.org"])
    line = text.split("\n")[1]
    assert _copy(spark, text, (1, 0), (1, len(line)), "minimal", MaskingConfig()).endswith(",x,a*b@c***.org")


def test_every_line_is_masked_by_the_columns_it_begins_in(spark):
    from maskwright.config import MaskingConfig

    text = "Note,Email,Phone\nann x,b.b@c.org,555-123-4567\nal y,a.a@c.org,555-765-4321"
    whole = _copy(spark, text, (1, 0), (2, 28), "minimal", MaskingConfig())
    assert whole.endswith("2: ann x,b*b@c***.org,555-*****67\n3: al y,a*a@c***.org,555-*****21")
    later = _copy(spark, text, (1, 6), (2, 28), "minimal", MaskingConfig())
    assert later.endswith("2: b*b@c***.org,555-*****67\n3: al y,a*a@c***.org,555-*****21")
    one = _copy(spark, text, (2, 15), (2, 27), "minimal", MaskingConfig())
    assert one.endswith("3: 555-*****21")


def test_errors_become_fallbacks(spark):
    from maskwright.functions.safe import cast_or_sql, or_else

    assert or_else(int)("x") is None and or_else(int, 7)("x") == 7 and or_else(int)("3") == 3
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.selectExpr(cast_or_sql("v", "int", "-1")).collect()] == [1, -1, -1]


def test_numbers_of_five_digits_are_no_dates(spark, tmp_path):
    from maskwright.functions.safe import cast_or_sql
    from maskwright.plans import catalog

    fallback = "date'1970-01-01'"
    texts = ["9999 ", "10000 ", "0012345", "12345-01-02", "+10000", "1999-02-28", "1999-02-30", "x", None, "2001-02-03 04:05:06"]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    days = [r[0] for r in df.selectExpr(f"cast({cast_or_sql('v', 'date', fallback)} as string)").collect()]
    assert days == ["9999-01-01", "1970-01-01", "1970-01-01", "1970-01-01", "1970-01-01", "1999-02-28", "1970-01-01", "1970-01-01", "1970-01-01", "2001-02-03"]
    times = [r[0] for r in df.selectExpr(f"cast({cast_or_sql('v', 'timestamp')} as string)").collect()]
    assert times == ["9999-01-01 00:00:00", None, None, None, None, "1999-02-28 00:00:00", None, None, None, "2001-02-03 04:05:06"]
    far, seconds = cast_or_sql("date_add(date'9999-12-31', 1)", "date"), cast_or_sql("12345L", "timestamp")
    typed = spark.sql(f"select {far} = make_date(10000, 1, 1), {seconds} = timestamp_seconds(12345)").first()
    assert typed[0] and typed[1]

    keys = [1000, 9997, 10000, 10003, 99999, 100000, 899998]
    spark.createDataFrame([(k, "BUILDING") for k in keys], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["k"]: (r["number"], r["day"]) for r in catalog.queries()["fallbacks"](spark, str(tmp_path)).collect()}
    numbers = {k: k if k % 3 == 1 else -1 for k in keys}
    assert got == {k: (n, f"{k}-01-01" if k in (1000, 9997) else "1970-01-01") for k, n in numbers.items()}
