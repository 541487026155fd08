"""Queries of the tabular, location and rendering operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OUTPUT_MODES, MaskingConfig, RenderConfig, next_output_mode
from ..functions import delimited as dl
from ..functions import registry as reg
from ..functions.dialect import DUCK, SPARK, text
from ..functions.masks import mask_sql
from ..operators import copying, detect, location, mask_text, render, tabular
from ..sources import lines as sources
from ..streaming import detect as streaming
from . import detection

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_of(table: str, select: Callable) -> Query:
    """A projection written once for both engines: select(dialect) -> list of SQL columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).selectExpr(*select(SPARK))

    return run, f"SELECT {', '.join(select(DUCK))} FROM {table}"


# ---- delimited lines built from tables ----

_LINE = "case c_custkey % 5 when 0 then concat_ws(',', {f}) when 1 then concat_ws(chr(9), {f}) when 2 then concat_ws('|', {f}) when 3 then concat_ws(';', {f}) else concat_ws(':', {f}) end".format(
    f="cast(c_custkey as string), c_name, c_mktsegment, cast(c_nationkey as string)"
)
_FILE = f"concat({_LINE}, chr(10), c_name, ',', c_mktsegment)"
_QUOTED = "concat('\"', c_name, ', Jr\",', c_mktsegment, ',\"say \"\"', cast(c_nationkey as string), '\"\"\", plain')"


def _first_line(d) -> list[str]:
    found = dl.first_line_delimiter(_FILE, d)
    return ["c_custkey", f"{found} as delimiter", f"{dl.delimiter_name(found)} as name", f"{dl.has_header_line(_FILE, d)} as has_header", f"{dl.has_header_line(_LINE, d)} as one_line_header"]


def _delimiter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "customer").selectExpr("c_nationkey * 5 + c_custkey % 5 as file", f"concat({_LINE}, case when c_custkey % 3 = 0 then ' \"a,b;c\"' else '' end) as line")
    return tabular.detect_delimiters(lines, "file")


def _delimiter_sample_sql() -> str:
    columns = ", ".join(f"avg({dl.unquoted_count('line', c, DUCK)}) AS m{i}, var_pop({dl.unquoted_count('line', c, DUCK)}) AS v{i}" for i, c in enumerate(dl.DELIMITERS))
    best = " UNION ALL ".join(f"SELECT file, {i} AS rank, {dl.char(c)} AS delimiter, m{i} * 10 - v{i} AS score FROM sums WHERE m{i} >= 1 AND m{i} * 10 - v{i} > 0" for i, c in enumerate(dl.DELIMITERS))
    return f"""WITH lines AS (SELECT c_nationkey * 5 + c_custkey % 5 AS file, concat({_LINE}, case when c_custkey % 3 = 0 then ' "a,b;c"' else '' end) AS line FROM customer),
    sums AS (SELECT file, {columns} FROM lines WHERE length(trim(line)) >= 3 GROUP BY file), best AS ({best}),
    top AS (SELECT file, delimiter, row_number() OVER (PARTITION BY file ORDER BY score DESC, rank) AS n FROM best)
    SELECT file, coalesce(delimiter, ',') AS delimiter FROM (SELECT DISTINCT file FROM lines) LEFT JOIN (SELECT * FROM top WHERE n = 1) USING (file)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{dl.parse(_QUOTED)} as f", f"{dl.parse(_QUOTED, both_quotes=True)} as g")
    return fields.selectExpr("c_custkey", "size(f) as n", "f[0] as f0", "f[1] as f1", "f[2] as f2", "f[3] as f3", "f = g as same")


_PARSED_SQL = "SELECT c_custkey, 4 AS n, c_name || ', Jr' AS f0, c_mktsegment AS f1, 'say \"' || c_nationkey || '\"' AS f2, 'plain' AS f3, true AS same FROM customer"
_SPACED = "concat(' \"', c_name, '\" ,', c_mktsegment, ', ', cast(c_nationkey as string))"


def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"array_join({dl.naive_fields(_SPACED)}, '/') as fields")


def _header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "'key,name,balance' as first", "case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then 'a,b,c' else concat_ws(',', cast(c_custkey as string), c_name, cast(c_acctbal as string)) end as second")
    return rows.selectExpr("c_custkey", f"{tabular.header_by_numbers('first', 'second')} as has_header")


_KINDS = [(k, p) for k in ("csv", "json", "html", "python", "plaintext", "tsv", "markdown") for p in ("A.CSV", "b.jsonc", "c.xml", "d.py", "e.txt", "f.dsv", "g.psd1", "csv")]


def _kind_columns(d) -> list[str]:
    return ["language", "path", f"{dl.is_delimited('language', 'path', d)} as delimited", f"{location.document_kind_sql('language', 'path', d)} as kind", f"{location.large_label_sql('language', 'path', d)} as large_label"]


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_KINDS, "language string, path string").selectExpr(*_kind_columns(SPARK))


_LOOKUPS_SQL = f"SELECT {', '.join(_kind_columns(DUCK))} FROM (VALUES {', '.join(f'({text(k)}, {text(p)})' for k, p in _KINDS)}) AS t(language, path)"


# ---- profiles ----

#: Every column of each table.
_PROFILED = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}


def _profile(table: str, columns: tuple[str, ...]) -> Query:
    shown = ["column", "position", "n", "n_distinct", "type", "min", "max", "round(mean, 4) as mean", "is_category", "is_identifier", "is_date", "alignment", "alignment_filled"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tabular.profile(_table(spark, sf_dir, table), list(columns)).selectExpr(*shown)

    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"""SELECT '{c}' AS "column", {i} AS position, count(*) AS n, count(DISTINCT v) AS n_distinct, count(*) FILTER ({dl.is_number('v', DUCK)}) AS num,
            count(*) FILTER ({dl.is_one_of('v', dl.BOOLEANS)}) AS bool, count(*) FILTER ({dl.is_one_of('v', dl.BOOLEANS_LONG)}) AS boollong, count(*) FILTER (trim(v) <> '') AS filled,
            coalesce(bool_or(contains(v, '.')), false) AS dec, min({dl.number('v', DUCK)}) AS lo, max({dl.number('v', DUCK)}) AS hi, sum({dl.number('v', DUCK)}) AS total FROM (SELECT coalesce(cast({c} AS string), '') AS v FROM {table})"""
        )
    sql = f"""SELECT "column", position, n, n_distinct,
      CASE WHEN bool > n * 0.7::DOUBLE THEN 'Boolean' WHEN num > n * 0.7::DOUBLE THEN CASE WHEN dec THEN 'Float' ELSE 'Integer' END ELSE 'String' END AS type,
      CASE WHEN num > n * 0.7::DOUBLE THEN lo END AS min, CASE WHEN num > n * 0.7::DOUBLE THEN hi END AS max, CASE WHEN num > n * 0.7::DOUBLE THEN round(total / num, 4) END AS mean,
      n_distinct > 1 AND n_distinct < n * 0.5::DOUBLE AS is_category,
      lower("column") LIKE '%id%' OR lower("column") LIKE '%key%' OR lower("column") LIKE '%number%' AS is_identifier, lower("column") LIKE '%date%' OR lower("column") LIKE '%time%' AS is_date,
      CASE WHEN boollong > n * 0.7::DOUBLE THEN 'center' WHEN num > n * 0.7::DOUBLE THEN 'right' ELSE 'left' END AS alignment,
      CASE WHEN filled = 0 THEN 'left' WHEN num / filled > 0.8::DOUBLE THEN 'right' WHEN bool / filled > 0.8::DOUBLE THEN 'center' ELSE 'left' END AS alignment_filled FROM ({' UNION ALL '.join(parts)})"""
    return run, sql


# ---- columns ----

NAMES = (
    "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "o_custkey", "o_orderdate", "l_linenumber", "l_discount", "p_brand", "user_id", "EmployeeID", "MedicareNumber",
    "PatientName", "Date Of Birth", "Credit-Card", "TFN", "BSB", "ABN", "Client Number", "email_address", "Home Phone", "postcode", "passport no", "Drivers License", "ref_no", "Policy No",
    "TXN id", "IBAN", "swift code", "routing", "NMI", "notes", "sort code", "uuid", "status",
)


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = MaskingConfig()
    rows = [(n, reg.is_sensitive_column(n, config), reg.column_type(n)) for n in NAMES]
    return spark.createDataFrame(rows, "name string, sensitive boolean, type string")


def _classify_sql() -> str:
    known = r"regexp_replace(lower(name), '[_\s-]', '', 'g')"
    rows = ", ".join(f"({text(n)})" for n in NAMES)
    cases, off = [], {k for k, v in MaskingConfig().effective_types().items() if v is False}
    hits = []
    for category, words in reg.COLUMN_CATEGORIES.items():
        alternatives = "|".join(w.replace(" ", "").replace("_", "").replace("-", "") for w in words)
        result = "CASE WHEN contains(k, 'nmi') THEN 'nmi' ELSE 'accountNumber' END" if category == "identifier" else text(reg.CATEGORY_TYPES.get(category, "custom"))
        cases.append(f"WHEN regexp_matches(k, '{alternatives}') THEN {result}")
        if category not in off:
            hits.append(f"regexp_matches(k, '{alternatives}')")
    return f"SELECT name, {' OR '.join(hits)} AS sensitive, CASE {' '.join(cases)} ELSE 'custom' END AS type FROM (SELECT name, {known} AS k FROM (VALUES {rows}) AS t(name))"


def _classify_in_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return df.selectExpr("name", f"{mask_text.column_type_sql('name')} as type")


#: Expected masks by column, written out: (table, columns, {column: mask function}).
_MASKED = {
    "customer": (("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), {"c_custkey": "card", "c_name": "generic", "c_acctbal": "account"}),
    "supplier": (("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), {"s_name": "generic", "s_acctbal": "account"}),
    "orders": (("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), {}),
    "events": (("event_id", "user_id", "event_type", "props"), {"event_id": "account", "user_id": "account"}),
}


def _mask_columns(table: str, strategy: str) -> Query:
    columns, masks = _MASKED[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tabular.mask_columns(_table(spark, sf_dir, table).select(*columns), MaskingConfig(strategy=strategy))

    return run, f"SELECT {', '.join(f'{mask_sql(masks[c], f"cast({c} as string)", strategy, DUCK)} AS {c}' if c in masks else c for c in columns)} FROM {table}"


def _mask_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "customer").selectExpr("c_custkey as line_no", "concat_ws(',', c_name, concat('user', cast(c_custkey as string), '@corp.org'), c_mktsegment, '') as line")
    masked = tabular.mask_delimited(lines, "Name,Email,Segment,Phone")
    return masked.selectExpr("line_no", "masked_line", "size(detections) as n", "detections[1].column_context.name as second")


def _mask_delimited_sql() -> str:
    email = "'user' || c_custkey || '@corp.org'"
    return f"SELECT c_custkey AS line_no, {mask_sql('generic', 'c_name', 'partial', DUCK)} || ',' || {mask_sql('email', f'({email})', 'partial', DUCK)} || ',' || c_mktsegment || ',' AS masked_line, 2 AS n, 'Email' AS second FROM customer"


def _mask_delimited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('Name,Email,Segment', chr(10), c_name, ',user', cast(c_custkey as string), '@corp.org,', c_mktsegment) as text", "if(c_custkey % 2 = 0, 'Segment,Phone,Client No', null) as h")
    masked = tabular.mask_delimited_texts(rows, "text", header_col="h")
    return masked.selectExpr("c_custkey", "masked_text", "size(detections) as n")


def _mask_delimited_texts_sql() -> str:
    email = "('user' || c_custkey || '@corp.org')"
    own = f"'Name,Email,Segment' || chr(10) || {mask_sql('generic', 'c_name', 'partial', DUCK)} || ',' || {mask_sql('email', email, 'partial', DUCK)} || ',' || c_mktsegment"
    given = f"'Name,' || {mask_sql('phone', text('Email'), 'partial', DUCK)} || ',' || {mask_sql('account', text('Segment'), 'partial', DUCK)} || chr(10) || c_name || ',' || {mask_sql('phone', email, 'partial', DUCK)} || ',' || {mask_sql('account', 'c_mktsegment', 'partial', DUCK)}"
    return f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {given} ELSE {own} END AS masked_text, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 2 END AS n FROM customer"


# ---- text, tags, rendering ----

_INDENTED = "concat('    if x:', chr(10), '        ', c_name, chr(10), chr(10), '    y = ', cast(c_custkey as string))"
_OFFSET = "concat(c_name, chr(10), c_mktsegment, chr(10), 'last line')"


def _numbered(d) -> list[str]:
    return [
        "c_custkey",
        f"{render.numbered_lines(_INDENTED, 'c_custkey', d=d)} as numbered",
        f"{render.numbered_lines(_INDENTED, 'c_custkey', padding=True, d=d)} as padded",
        f"{render.numbered_lines('c_name', '1', d=d)} as one",
    ]


def _documents_numbered(d) -> list[str]:
    return ["doc_id", f"{d.sha256(render.numbered_lines('text', '10', d=d))} as digest"]


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", *(f"{location.offset_sql(_OFFSET, str(line), '2')} as l{line}" for line in (0, 1, 2, 5)))


_OFFSETS_SQL = "SELECT c_custkey, 2 AS l0, length(c_name) + 3 AS l1, length(c_name) + length(c_mktsegment) + 4 AS l2, length(c_name) + length(c_mktsegment) + 4 AS l5 FROM customer"


def _rendered(fmt: str) -> Query:
    head = "'// doc:' || (doc_id % 50 + 1) || '-' || (doc_id % 50 + 9) || ' (en > x)'"
    body = render.numbered_lines("text", "(doc_id % 50 + 1)", d=DUCK)
    made = {"plain": f"{head} || chr(10) || {body}", "markdown": f"{head} || chr(10) || '```python' || chr(10) || {body} || chr(10) || '```'", "ansi": f"chr(27) || '[32m' || {head} || chr(27) || '[0m' || chr(10) || {body}"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "'doc' as name", "doc_id % 50 + 1 as start_line", "doc_id % 50 + 9 as end_line", "'en > x' as context", "text")
        return render.render(rows, fmt, language="python").selectExpr("doc_id", "sha2(output, 256) as digest")

    return run, f"SELECT doc_id, sha256({made[fmt]}) AS digest FROM documents"


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").selectExpr("page_id", "url as name", "1 as start_line", "9 as end_line", "'' as context", "html as text")
    return render.render(rows, "html", language="xml").selectExpr("page_id", "sha2(output, 256) as digest", "length(output) as n")


_HTML_SQL = f"""SELECT page_id, sha256(o) AS digest, length(o) AS n FROM (SELECT page_id, {render.html("('// ' || url || ':1-9')", render.numbered_lines('html', '1', d=DUCK), 'xml', DUCK)} AS o FROM pages)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return location.xml_tags(_table(spark, sf_dir, "pages"), "page_id", "html")


_TAGS_SQL = r"""WITH m AS (SELECT page_id AS id, regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>') AS m, regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>', 1) AS t, string_split_regex(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>') AS g FROM pages),
  e AS (SELECT id, m[i] AS tagtext, t[i] AS tag, i, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS int) AS pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
  k AS (SELECT *, CASE WHEN starts_with(tagtext, '</') THEN 'close' WHEN ends_with(tagtext, '/>') THEN 'single' ELSE 'open' END AS kind FROM e)
  SELECT id, pos, tag, kind, cast(coalesce(sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS depth,
  cast(coalesce(sum(CASE WHEN kind <> 'close' THEN 1 ELSE 0 END) OVER (PARTITION BY id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS global_index,
  cast(sum(CASE WHEN kind <> 'close' THEN 1 ELSE 0 END) OVER (PARTITION BY id, tag) AS int) AS tag_count FROM k"""


def _siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return location.sibling_ordinals(_table(spark, sf_dir, "pages"), "page_id", "html")


def _siblings_sql() -> str:
    return f"""WITH tags AS ({_TAGS_SQL}), o AS (SELECT * FROM tags WHERE kind <> 'close'),
    p AS (SELECT o.id, o.pos, o.tag, o.depth, coalesce((SELECT max(q.pos) FROM o q WHERE q.id = o.id AND q.kind = 'open' AND q.depth = o.depth - 1 AND q.pos < o.pos), -1) AS parent_pos FROM o)
    SELECT id, pos, tag, depth, parent_pos, cast(row_number() OVER (PARTITION BY id, parent_pos, tag ORDER BY pos) - 1 AS int) AS local_index, cast(count(*) OVER (PARTITION BY id, parent_pos, tag) AS int) AS n_siblings FROM p"""


def _tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", *(location.tag_count("html", t).cast("long").alias(f"n_{t}") for t in ("p", "div", "a", "li")))


_TAG_COUNTS_SQL = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}\\b[^>]*>'))::BIGINT AS n_{t}" for t in ("p", "div", "a", "li")) + " FROM pages"


#: A record made of an event's columns, and per event the word in it whose place is asked for, with the path there.
_RECORD = "concat('{\"user\": {\"id\": ', cast(user_id as string), ', \"events\": [', props, ', {\"kind\": \"', event_type, '\", \"value\": ', cast(cast(value * 100 as bigint) as string), '}]}, \"tail\": [[1], [22, 333], \"', event_type, '\"]}')"
_ASKED = (("concat('\"id\": ', cast(user_id as string))", "6", "'user.id'"), ("'\"kind\": \"'", "9", "'user.events[1].kind'"), ("'\"value\": '", "9", "'user.events[1].value'"), ("'22, 333'", "0", "'tail[1][0]'"), ("'22, 333'", "5", "'tail[1][1]'"), ("concat('333], \"', event_type)", "7", "'tail[2]'"), ("'{\"user'", "0", "null"))


def _json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = " ".join(f"when {i} then instr(t, {word}) - 1 + {skip}" for i, (word, skip, _) in enumerate(_ASKED))
    events = _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id", f"{_RECORD} as t").selectExpr("event_id", "t", f"cast(case event_id % {len(_ASKED)} {at} end as int) as at")
    return events.select("event_id", "at", location.path_udf("json")("t", "at").alias("path"))


def _json_paths_sql() -> str:
    at = " ".join(f"when {i} then strpos(t, {word}) - 1 + {skip}" for i, (word, skip, _) in enumerate(_ASKED))
    path = " ".join(f"when {i} then {path}" for i, (_, _, path) in enumerate(_ASKED))
    return f"SELECT event_id, cast(case event_id % {len(_ASKED)} {at} end as int) AS at, case event_id % {len(_ASKED)} {path} end AS path FROM (SELECT *, {_RECORD} AS t FROM events)"


def _xml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "html", "cast(length(html) / 2 as int) as at")
    return pages.select("page_id", location.path_udf("xml")("html", "at").alias("path"), location.path_udf("xml", "global")("html", "at").alias("global_path"))


def _xml_paths_sql() -> str:
    """Paths by folding the tags of each page.

    stack: the tags open at the offset, where a closing tag only takes off the
    last. The box of an open tag: the first tag still open before it that was
    opened one level up (here a closing tag takes off the last of its name, and
    always a level), up to the next closing tag of that name; its local index is
    the number of like tags in the box before it. A box named by the plural or a
    usual parent doesn't occur in the pages (neither lis, ps, ... nor the fixed names).
    """
    step = """CASE x[1].kind WHEN 'open' THEN list_concat([{'name': '', 'pos': 0, 'kind': '', 'level': a[1].level + 1}], a[2:], [{'name': x[1].name, 'pos': x[1].pos, 'kind': '', 'level': a[1].level}])
      WHEN 'close' THEN list_concat([{'name': '', 'pos': 0, 'kind': '', 'level': a[1].level - 1}], list_filter(a[2:], lambda o: NOT (o.name = x[1].name AND o.pos = coalesce(list_max(list_transform(list_filter(a[2:], lambda p: p.name = x[1].name), lambda p: p.pos)), -1)))) ELSE a END"""
    start = "[{'name': '', 'pos': 0, 'kind': '', 'level': 0}]"
    return rf"""WITH m AS (SELECT page_id AS id, html, (length(html) / 2)::DOUBLE AS half, regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>') AS m, regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>', 1) AS t, string_split_regex(html, '</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>') AS g FROM pages),
    tags AS (SELECT id, html, floor(half)::INT AS place, t[i] AS name, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS int) AS pos,
      CASE WHEN starts_with(m[i], '</') THEN 'close' WHEN ends_with(m[i], '/>') THEN 'single' ELSE 'open' END AS kind, m[i] AS whole FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
    lists AS (SELECT id, any_value(place) AS place, any_value(html) AS html, list([{{'name': name, 'pos': pos, 'kind': kind, 'level': 0}}] ORDER BY pos) AS all_tags FROM tags GROUP BY id),
    stacks AS (SELECT id, html, all_tags, list_reduce(list_prepend(all_tags[1][1:0], list_filter(all_tags, lambda x: x[1].pos <= place)),
      lambda a, x: CASE x[1].kind WHEN 'open' THEN list_concat(a, x) WHEN 'close' THEN CASE WHEN len(a) > 0 AND a[-1].name = x[1].name THEN a[1:len(a) - 1] ELSE a END ELSE a END) AS stack FROM lists),
    items AS (SELECT id, html, all_tags, i, stack[i].name AS name, stack[i].pos AS pos FROM (SELECT *, unnest(range(1, len(stack) + 1)) AS i FROM stacks)),
    states AS (SELECT *, list_reduce(list_prepend({start}, list_filter(all_tags, lambda x: x[1].pos < pos)), lambda a, x: {step}) AS open_ FROM items),
    boxes AS (SELECT *, list_filter(open_[2:], lambda o: o.level = open_[1].level - 1) AS parents FROM states),
    boxed AS (SELECT *, parents[1].pos AS box, CASE WHEN strpos(substring(html, parents[1].pos + 1), '</' || parents[1].name || '>') = 0 THEN length(html) ELSE parents[1].pos + strpos(substring(html, parents[1].pos + 1), '</' || parents[1].name || '>') - 1 END AS box_end FROM boxes),
    counted AS (SELECT b.id, b.i, b.name, count(*) FILTER (t.pos < b.pos) AS global_index, count(*) AS total, coalesce(count(*) FILTER (len(b.parents) > 0 AND t.pos >= b.box AND t.pos < least(b.pos, b.box_end)), 0) AS local_index
      FROM boxed b JOIN tags t ON t.id = b.id AND (t.name = b.name OR starts_with(t.name, b.name || '-')) AND t.kind <> 'close' GROUP BY b.id, b.i, b.name, b.pos)
    SELECT p.page_id, string_agg(name || CASE WHEN total > 1 OR local_index > 0 THEN '[' || local_index || ']' ELSE '' END, ' > ' ORDER BY i) AS path,
      string_agg(name || CASE WHEN total > 1 OR global_index > 0 THEN '[' || global_index || ']' ELSE '' END, ' > ' ORDER BY i) AS global_path FROM pages p LEFT JOIN counted c ON c.id = p.page_id GROUP BY p.page_id"""


#: Elements in boxes named by their plural, by a usual parent, or by nothing but their depth; <k> and <n> as for code.
_FORMS = "<r><Items><Item>a<k></Item><Item>b</Item></Items><Items><Item>c</Item><Item>d<n></Item></Items><FormInstance><Question>e</Question><Question>f<k></Question></FormInstance><x><y>g</y></x><x><y>h</y><y>i<n></y></x></r>"
_FORM_PLACES = ((">a", "r > Items[0] > Item[0]"), (">c", "r > Items[1] > Item[0]"), (">d", "r > Items[1] > Item[1]"), (">f", "r > FormInstance > Question[1]"), (">g", "r > x[0] > y[0]"), (">i", "r > x[1] > y[1]"))


def _xml_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = " ".join(f"when {i} then instr(t, '{word}')" for i, (word, _) in enumerate(_FORM_PLACES))
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_filled(_FORMS)} as t").selectExpr("c_custkey", "t", f"case c_custkey % {len(_FORM_PLACES)} {at} end as at")
    return rows.select("c_custkey", location.path_udf("xml")("t", "at").alias("path"))


_XML_BOXES_SQL = f"SELECT c_custkey, CASE c_custkey % {len(_FORM_PLACES)} {' '.join(f'WHEN {i} THEN {text(path)}' for i, (_, path) in enumerate(_FORM_PLACES))} END AS path FROM customer"


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions without a path: valid JSON is still JSON, broken JSON and plain text are nothing, large documents get a label."""
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 4 when 2 then 'plaintext' when 3 then 'csv' else 'json' end as language", "'e' as path", "case event_id % 4 when 0 then concat(props, ' ') when 1 then concat(props, ']') when 3 then repeat('a,b', 40) else props end as text", "0 as line", "if(event_id % 4 = 0, length(props), if(event_id % 4 = 1, length(props), 0)) as character")
    return location.with_context(rows, RenderConfig(large_char_threshold=100)).select("event_id", "context")


_CONTEXTS_SQL = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'JSON' WHEN 3 THEN 'CSV (Large File)' END AS context FROM events"


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{location.is_large_sql('text', RenderConfig(large_line_threshold=12, large_char_threshold=3000))} as large")


_LARGE_SQL = "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) >= 12 OR length(text) > 3000 AS large FROM documents"


def _header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.header_line(sources.explode_lines(_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def _range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_nationkey", "array(c_name, c_mktsegment, 'x') as f", "cast(c_custkey % 30 as int) as a", "cast(c_custkey % 30 + c_custkey % 11 as int) as b")
    return tabular.union_ranges(rows.selectExpr("c_nationkey", f"{location.inclusive_column_range_sql('f', 'a', 'b')} as r").select("c_nationkey", "r.*"), "c_nationkey")


_LISTS = MaskingConfig(deny_list=("brand", "Status"), allow_list=("email", "phone", "c_name"))


def _classify_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string").selectExpr("name", f"{tabular.is_sensitive_sql('name', _LISTS)} as sensitive")


_CLASSIFY_LISTS_SQL = f"SELECT name, contains(k, 'brand') OR contains(k, 'status') OR NOT (contains(k, 'email') OR contains(k, 'phone') OR contains(k, 'cname')) AS sensitive FROM (SELECT name, replace(replace(replace(lower(name), '_', ''), ' ', ''), '-', '') AS k FROM (VALUES {', '.join(f'({text(n)})' for n in NAMES)}) AS t(name))"


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m, next_output_mode(m)) for m in (*OUTPUT_MODES, "unknown")], "mode string, next string")


_MODES_SQL = "SELECT * FROM (VALUES ('minimal', 'smart'), ('smart', 'table'), ('table', 'detailed'), ('detailed', 'minimal'), ('unknown', 'minimal')) AS t(mode, next)"


def _simple_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [[str(r["r_regionkey"]), r["r_name"]] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame([(i, line) for i, line in enumerate(render.simple_table(["k", "name"], rows).split("\n"))], "seq int, line string")


_SIMPLE_TABLE_SQL = """WITH w AS (SELECT greatest(4, max(length(r_name)))::INT AS w FROM region)
  SELECT 0 AS seq, '┌─────┬─' || repeat('─', w) || '─┐' AS line FROM w UNION ALL SELECT 1, '│ k   │ ' || rpad('name', w, ' ') || ' │' FROM w UNION ALL SELECT 2, '├─────┼─' || repeat('─', w) || '─┤' FROM w
  UNION ALL SELECT (2 + row_number() OVER (ORDER BY r_regionkey))::INT, '│ ' || rpad(r_regionkey::VARCHAR, 3, ' ') || ' │ ' || rpad(r_name, w, ' ') || ' │' FROM region, w
  UNION ALL SELECT (3 + (SELECT count(*) FROM region))::INT, '└─────┴─' || repeat('─', w) || '─┘' FROM w"""


#: Code about each customer: language, text, line asked for, and what stands around it; <k> is the key, <n> the nation's.
CODE = (
    ("python", "class A<k>:\n    def f<n>(self):\n        x = 1\n\ndef g<k>():\n    pass", 2, "A<k> > f<n>"),
    ("python", "class A<k>:\n    def f<n>(self):\n        x = 1\n\ndef g<k>():\n    pass", 5, "A<k> > g<k>"),
    ("typescript", "class B<k> {\n  async run<n>(a) {\n    const z<n> = (q) => q;\n  }\n}", 2, "B<k> > z<n>"),
    ("typescript", "class B<k> {\n  async run<n>(a) {\n    return <k>;\n  }\n}", 2, "B<k> > run<n>"),
    ("javascript", "function outer<k>() {\n  let y = <n>;\n}", 1, "outer<k>"),
    ("csharp", "namespace N.M<n>\n{\n  public class C<k>\n  {\n    public void Do<n>(int a)\n    {\n      x();\n", 6, "C<k> > Do<n>"),
    ("csharp", "namespace N.M<n>\n{\n  public class C<k>\n  {\n    int x;\n", 4, "N.M<n> > C<k>"),
    ("powershell", "function Get-It<k> {\n  $x<n>\n}", 1, "Get-It<k>"),
    ("go", "func main<k>() {}", 0, None),
)


def _filled(template: str) -> str:
    """SQL of either engine: a template with the keys of its row."""
    pieces = [f"replace(replace({text(x)}, '<k>', cast(c_custkey as string)), '<n>', cast(c_nationkey as string))" for x in template.split("\n")]
    return f"concat_ws(chr(10), {', '.join(pieces)})" if len(pieces) > 1 else pieces[0]


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = " ".join(f"when {i} then '{k}'" for i, (k, *_) in enumerate(CODE))
    texts = " ".join(f"when {i} then {_filled(t)}" for i, (_, t, _, _) in enumerate(CODE))
    lines = " ".join(f"when {i} then {n}" for i, (_, _, n, _) in enumerate(CODE))
    which = f"c_custkey % {len(CODE)}"
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"case {which} {kinds} end as language", f"case {which} {texts} end as text", f"case {which} {lines} end as line")
    cases = " ".join(f"when language = '{k}' then {location.code_context_sql('text', 'line', k)}" for k in location.LANGUAGES["code"])
    return df.selectExpr("c_custkey", "language", f"case {cases} end as context")


def _code_sql() -> str:
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(CODE))
    around = " ".join(f"WHEN {i} THEN {_filled(x) if x else 'NULL'}" for i, (*_, x) in enumerate(CODE))
    return f"SELECT c_custkey, CASE c_custkey % {len(CODE)} {kinds} END AS language, CASE c_custkey % {len(CODE)} {around} END AS context FROM customer"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(c_name, c_mktsegment, 'x') as f", "cast(c_custkey % 30 as int) as a", "cast(c_custkey % 30 + c_custkey % 11 as int) as b")
    return rows.selectExpr("c_custkey", f"{location.inclusive_column_range_sql('f', 'a', 'b')} as r").select("c_custkey", "r.*")


_RANGES_SQL = """WITH t AS (SELECT c_custkey, length(c_name) AS n1, length(c_name) + 1 + length(c_mktsegment) AS n2, c_custkey % 30 AS a, c_custkey % 30 + c_custkey % 11 AS b FROM customer)
  SELECT c_custkey, CASE WHEN a <= n1 THEN 0 WHEN a <= n2 THEN 1 WHEN a <= n2 + 2 THEN 2 ELSE 0 END AS start_column, CASE WHEN b <= n1 THEN 0 WHEN b <= n2 THEN 1 ELSE 2 END AS end_column FROM t"""


def _business_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.business_dates(detection.texts(spark, sf_dir), "text", keep=["src", "id"])


_BUSINESS_SQL = f"""WITH texts AS ({detection.TEXTS_SQL})
  SELECT src, id, value, pos, regexp_matches(lower(substring(text, greatest(pos - 100, 0) + 1, least(pos, 100))), '{'|'.join(reg.BUSINESS_DATE_WORDS)}') AS business FROM ({detection._spans_duck(reg.REGISTRY.get('dateOfBirth'))})"""


def _selected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('Name,Segment,Key', chr(10), c_name, ',', c_mktsegment, ',', cast(c_custkey as string)) as text", "1 as a", "if(c_custkey % 2 = 0, 0, length(c_name) + 1) as b", "1 as c", "length(c_name) + 1 + length(c_mktsegment) as d")
    return rows.select("c_custkey", location.delimited_context_udf()("text", "a", "b", "c", "d").alias("context"))


_SELECTED_SQL = "SELECT c_custkey, 'CSV (Comma-Separated) > ' || CASE WHEN c_custkey % 2 = 0 THEN 'Name, Segment' ELSE 'Segment' END AS context FROM customer"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(concat('a,', c_name, ',z'), concat('bb,', c_name, ',y')) as full", "array(concat(c_name, ',z'), concat('bb,', c_name, ',y')) as part", "2 as a", "2 as b")
    aligned = rows.select("c_custkey", location.aligned_lines_udf()("full", "part", "a", "b", F.lit(",")).alias("x"))
    return aligned.select("c_custkey", F.array_join("x.lines", "/").alias("lines"), "x.first_column", F.array_join("x.columns", ",").alias("columns"))


_ALIGNED_SQL = "SELECT c_custkey, c_name || ',z/bb,' || c_name || ',y' AS lines, 1 AS first_column, '1,0' AS columns FROM customer"


# ---- whole-text masking ----


def _json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").selectExpr("event_id", "concat('{\"user_id\": ', cast(user_id + 1000000 as string), ', \"kind\": \"', event_type, '\", \"email\": \"u', cast(event_id as string), '@corp.org\"}') as text")
    return mask_text.with_masked_text(events, "text", MaskingConfig(types={"custom": False})).selectExpr("event_id", "masked_text", "size(detections) as n")


_JSON_FIELDS_SQL = f"""SELECT event_id, '{{"user_id": ***' || right(cast(user_id + 1000000 AS string), 3) || ', "kind": "' || event_type || '", "email": "' || {mask_sql('email', "('u' || event_id || '@corp.org')", 'partial', DUCK)} || '"}}' AS masked_text, 2 AS n FROM events"""


_CDATA_CONFIG = MaskingConfig(as_of="2025-06-15", types={"ipAddress": True})
_CDATA_TEXT = "concat('<notes><![CDATA[', text, ']]></notes>')"


def _cdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detection.texts(spark, sf_dir).where("src = 'doc' or src = 'line' and not (text like '%\":%' or text like '%</%')").selectExpr("src", "id", f"{_CDATA_TEXT} as text")
    return mask_text.with_masked_text(rows, "text", _CDATA_CONFIG).selectExpr("src", "id", "sha2(masked_text, 256) as digest", "size(filter(detections, d -> d.confidence = 0.95D and replace(d.masked_value, '*', '') = '')) as n")


def _cdata_sql() -> str:
    """The section's spans, taken in order of priority and place unless they overlap one taken before; a star for every character of theirs."""
    found = " UNION ALL ".join(f"SELECT {i} AS priority, src, id, pos, value FROM ({detection._spans_duck(d, 'inner_texts')})" for i, d in enumerate(reg.REGISTRY.not_disabled(_CDATA_CONFIG.effective_types())))
    clash = "(x[1].s >= k.s AND x[1].s < k.e) OR (x[1].e > k.s AND x[1].e <= k.e) OR (x[1].s <= k.s AND x[1].e >= k.e)"
    inside = "len(list_filter(kept, lambda k: i > k.s AND i <= k.e)) > 0"
    return f"""WITH texts AS ({detection.TEXTS_SQL}), inner_texts AS (SELECT * FROM texts WHERE src = 'doc' OR src = 'line' AND NOT (text LIKE '%":%' OR text LIKE '%</%')), found AS ({found}),
    spans AS (SELECT src, id, list([{{'s': pos, 'e': pos + length(value)::INT}}] ORDER BY priority, pos) AS spans FROM found WHERE pos > 0 AND NOT contains(value, chr(10)) GROUP BY src, id),
    taken AS (SELECT src, id, list_reduce(list_prepend(spans[1][1:0], spans), lambda a, x: CASE WHEN len(list_filter(a, lambda k: {clash})) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM spans),
    masked AS (SELECT t.src, t.id, kept, CASE WHEN kept IS NULL THEN text ELSE list_reduce(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN {inside} THEN '*' ELSE substring(text, i, 1) END), lambda a, b: a || b) END AS body
      FROM inner_texts t LEFT JOIN taken USING (src, id))
    SELECT src, id, sha256('<notes><![CDATA[' || body || ']]></notes>') AS digest, coalesce(len(kept), 0)::INT AS n FROM masked"""


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import CustomPattern

    return mask_text.custom_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), CustomPattern("token", r'token = "[0-9a-f]{40}"', "[TOKEN]"))


_CUSTOM_SQL = r"""SELECT doc_id, m[i] AS value, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS int) AS pos, '[TOKEN]' AS replacement
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'token = "[0-9a-f]{40}"') AS m, string_split_regex(text, 'token = "[0-9a-f]{40}"') AS g FROM documents))"""


# ---- reports ----


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").orderBy("n_nationkey")


def _table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = render.table_report(_small(spark, sf_dir), "nation.csv", RenderConfig(table_max_columns=2))
    return spark.createDataFrame([(i, line) for i, line in enumerate(report.split("\n"))], "seq int, line string")


def _table_report_sql() -> str:
    """The frame drawn by hand: numbers to the right, the last columns told in one, the first twenty rows."""
    line = "'│ ' || lpad(n_nationkey::VARCHAR, 11, ' ') || ' │ ...      │'"
    lines = ["// nation.csv:1-26 | 25 records", "", "┌─────────────┬──────────┐", "│ n_nationkey │ (2 more) │", "├─────────────┼──────────┤"]
    below = ["└─────────────┴──────────┘", "... 5 more rows (increase maxRows to see all)", "", "// Summary: 25 rows × 3 columns"]
    values = ", ".join([f"({i}, {text(x)})" for i, x in enumerate(lines)] + [f"({i + 25}, {text(x)})" for i, x in enumerate(below)])
    return f"SELECT seq::INT AS seq, line FROM (VALUES {values}) AS t(seq, line) UNION ALL SELECT (n + 4)::INT, {line} FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) WHERE n <= 20"


def _detailed_sql() -> str:
    """Head, statistics of the numeric columns, insights, rows, summary: each line from the table by hand."""
    statistics = " UNION ALL ".join(f"SELECT {5 + i}, printf('  {c}: min=%.2f, max=%.2f, avg=%.2f', min({c})::DOUBLE, max({c})::DOUBLE, avg({c})) FROM nation" for i, c in enumerate(("n_nationkey", "n_regionkey")))
    few = "list_filter([CASE WHEN count(DISTINCT n_nationkey) < 0.5 * count(*) THEN 'n_nationkey' END, CASE WHEN count(DISTINCT n_name) < 0.5 * count(*) THEN 'n_name' END, CASE WHEN count(DISTINCT n_regionkey) < 0.5 * count(*) THEN 'n_regionkey' END], lambda x: x IS NOT NULL)"
    fixed = {0: "// nation.csv:2-26", 1: "// Columns: n_nationkey, n_name, n_regionkey", 2: "// Types: Integer, String, Integer", 3: "", 4: "// Statistics:", 7: "", 8: "// Insights:", 9: "//   Identifier columns: n_nationkey, n_regionkey", 11: "", 12: "// Data:"}
    values = ", ".join(f"({i}, {text(x)})" for i, x in fixed.items())
    return f"""SELECT seq::BIGINT AS seq, line FROM (VALUES {values}) AS t(seq, line) UNION ALL {statistics}
      UNION ALL SELECT 10, '//   Category columns: ' || array_to_string({few}, ', ') FROM nation
      UNION ALL SELECT n_nationkey + 1002, (n_nationkey + 2) || ': ' || n_nationkey || ', ' || n_name || ', ' || n_regionkey FROM nation
      UNION ALL SELECT 4611686018427387904, '' UNION ALL SELECT 4611686018427387905, '// Summary: ' || count(*) || ' rows × 3 columns' FROM nation"""


def _report(kind: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "nation").withColumn("number", F.col("n_nationkey").cast("int") + 2)
        return kind(rows, "nation.csv", "number")

    return run, None


def _smart_sql() -> str:
    head = ["// nation.csv:2-26", "// Columns: n_nationkey, n_name, n_regionkey", "// Types: Integer, String, Integer", ""]
    values = ", ".join(f"({i}, {text(x)})" for i, x in enumerate(head))
    return f"SELECT seq::BIGINT AS seq, line FROM (VALUES {values}) AS t(seq, line) UNION ALL SELECT n_nationkey + 1002, (n_nationkey + 2) || ': ' || n_nationkey || ', ' || n_name || ', ' || n_regionkey FROM nation"


_CATALOG = [(d.priority, d.type, d.source, d.gate, d.prior, d.mask) for d in map(reg.REGISTRY.get, reg.REGISTRY.types())]


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_CATALOG, "priority int, type string, source string, gate string, prior double, mask string")


_CATALOG_SQL = f"SELECT priority, type, source, gate, prior::DOUBLE AS prior, mask FROM (VALUES {', '.join(f'({p}, {text(t)}, {text(s)}, {text(g)}, {r!r}, {text(m)})' for p, t, s, g, r, m in _CATALOG)}) AS t(priority, type, source, gate, prior, mask)"
_CATEGORIES = [(c, w) for c, words in reg.COLUMN_CATEGORIES.items() for w in words]


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_CATEGORIES, "category string, word string").groupBy("category").agg(F.count("*").alias("n_words"), F.max(F.length("word")).alias("longest"))


_CATEGORIES_SQL = f"SELECT category, count(*) AS n_words, max(length(word)) AS longest FROM (VALUES {', '.join(f'({text(c)}, {text(w)})' for c, w in _CATEGORIES)}) AS t(category, word) GROUP BY category"


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, copied as plain text, masked, with numbered lines."""
    lines = "split(coalesce(text, ''), '\\n', -1)"
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('doc', cast(doc_id as string), '.txt') as name", "concat('doc', cast(doc_id as string), '.txt') as path", "'plaintext' as language", "text", "0 as start_line", "0 as start_char", f"size({lines}) - 1 as end_line", f"length(element_at({lines}, -1)) as end_char")
    return copying.copy_with_context(docs, _COPY_CONFIG).selectExpr("doc_id", "sha2(output, 256) as digest", "size(detections) as n")


_COPY_CONFIG = MaskingConfig(as_of="2025-06-15")


def _copied_sql() -> str:
    """Masking by its SQL; then each line with its number, without a common indent of more than two."""
    return f"""{detection.scored_duck(_COPY_CONFIG)}{detection.masked_duck(_COPY_CONFIG)},
    lines AS (SELECT id, n, string_split(coalesce(masked_text, ''), chr(10)) AS l FROM masked WHERE src = 'doc'),
    indents AS (SELECT id, n, l, coalesce(list_min(list_transform(list_filter(l, lambda x: trim(x, chr(32) || chr(9)) <> ''), lambda x: length(x) - length(ltrim(x, chr(32) || chr(9))))), 0) AS indent FROM lines)
    SELECT id AS doc_id, n, sha256('// doc' || id || '.txt:1' || CASE WHEN len(l) > 1 THEN '-' || len(l) ELSE '' END || chr(10) ||
      array_to_string(list_transform(range(1, len(l) + 1), lambda i: i || ': ' || CASE WHEN indent > 2 AND length(l[i]) > indent THEN substring(l[i], indent + 1) ELSE l[i] END), chr(10))) AS digest FROM indents"""


def _copied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 0 of every page, with the path at its second list item; and as HTML."""
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "url as name", "url as path", "'html' as language", "html as text", "0 as start_line", "instr(html, '<li>') as start_char", "0 as end_line", "instr(html, '</ul>') as end_char")
    return copying.copy_with_context(pages).selectExpr("page_id", "sha2(output, 256) as digest", "size(detections) as n")


#: From inside the first <li>: html, head, meta (which nothing closes, and so not head either), body, nav, ul and li are open.
_COPIED_PAGES_SQL = r"""SELECT page_id, sha256('// ' || url || ':1 (html > head > meta > body > nav > ul > li[0])' || chr(10) || '1: ' || substring(html, strpos(html, '<li>') + 1, strpos(html, '</ul>') - strpos(html, '<li>'))) AS digest, 0 AS n FROM pages WHERE strpos(html, '<li>') > 0"""


def _copied_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each event's second record, selected within one line of JSON."""
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "'e.json' as name", "'e.json' as path", "'json' as language", f"concat('{{', chr(10), substring({_RECORD}, 2)) as text", "event_type")
    at = "instr(split(text, '\\n', -1)[1], '\"kind\"') + 8"
    rows = rows.selectExpr("*", "1 as start_line", f"{at} as start_char", "1 as end_line", f"{at} + length(event_type) as end_char")
    return copying.copy_with_context(rows).selectExpr("event_id", "output")


_COPIED_JSON_SQL = "SELECT event_id, '// e.json:2 (user.events[1].kind)' || chr(10) || '2: ' || event_type AS output FROM events"


def _copied_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method's line of a class about each customer."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "'a.py' as name", "'a.py' as path", "'python' as language", f"{_filled(CODE[0][1])} as text", "2 as start_line", "0 as start_char", "2 as end_line", "13 as end_char")
    return copying.copy_with_context(rows).selectExpr("c_custkey", "output")


_COPIED_CODE_SQL = "SELECT c_custkey, '// a.py:3 (A' || c_custkey || ' > f' || c_nationkey || ')' || chr(10) || '3: x = 1' AS output FROM customer"

#: A file of a header, two rows and a blank line between them; odd keys select all, even ones from the second field of line 1.
_CSV = "concat_ws(chr(10), 'Name,Segment,Key', concat_ws(',', c_name, c_mktsegment, cast(c_custkey as string)), '  ', concat_ws(',', c_name, 'X', cast(c_custkey + 1 as string)))"


def _copied_csv(mode: str, masked: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "'c.csv' as name", "'c.csv' as path", "'csv' as language", f"{_CSV} as text", "if(c_custkey % 2 = 1, 0, 1) as start_line", "if(c_custkey % 2 = 1, 0, length(c_name) + 1) as start_char", "3 as end_line", f"length(split({_CSV}, '\\n', -1)[3]) as end_char")
        return copying.copy_with_context(rows, _COPY_CONFIG if masked else None, RenderConfig(output_mode=mode)).selectExpr("c_custkey", "output", "size(detections) as n")

    return run


def _copied_csv_sql(mode: str, masked: bool = False) -> str:
    """The three reports of the selections above, line by line; the names are masked by their column."""
    name = f"({mask_sql('generic', 'c_name', 'partial', DUCK)})" if masked else "c_name"
    n = "CASE WHEN c_custkey % 2 = 1 THEN 2 ELSE 1 END" if masked else "0"
    key, more = "c_custkey", "(c_custkey + 1)"
    data = {True: [f"'2: ' || {name} || ', ' || c_mktsegment || ', ' || {key}", f"'3: ' || {name} || ', X, ' || {more}"], False: [f"'2: ' || c_mktsegment || ', ' || {key}", f"'3: ' || {name} || ', X, ' || {more}"]}
    columns = {True: "Name, Segment, Key", False: "Segment, Key"}
    types = {True: "String, String, Integer", False: "String, String"}
    where = {True: "1-4", False: "2-4"}
    statistics = {True: ["'// Statistics:'", f"printf('  Key: min=%.2f, max=%.2f, avg=%.2f', {key}::DOUBLE, {more}::DOUBLE, ({key} + {more}) / 2)", "''"], False: []}
    out = []
    for whole in (True, False):
        head = [f"'// c.csv:{where[whole]}'", f"'// Columns: {columns[whole]}'", f"'// Types: {types[whole]}'", "''"]
        size = 3 if whole else 2
        if mode == "smart":
            lines = [*head, *data[whole]]
        elif mode == "detailed":
            lines = [*head, *statistics[whole], "'// Insights:'", "'//   Identifier columns: Key'", "''", "'// Data:'", *data[whole], "''", f"'// Summary: 2 rows × {size} columns'"]
        else:
            cells = [[name, "c_mktsegment", f"{key}::VARCHAR"], [name, "'X'", f"{more}::VARCHAR"]] if whole else [["c_mktsegment", f"{key}::VARCHAR"], [name, "'X'", f"{more}::VARCHAR"]]
            titles = ["Name", "Segment", "Key"] if whole else ["Segment", "Key"]
            widths = [f"greatest(5, {len(t)}, {', '.join(f'length({r[i]})' for r in cells)})::INT" for i, t in enumerate(titles)]
            padded = [*widths, "5"]  # a cell beyond the titles
            rule = lambda a, b, c: f"'{a}' || {f""" || '{b}' || """.join(f"repeat('─', {w} + 2)" for w in widths)} || '{c}'"
            row = lambda r, right: "'│' || " + " || '│' || ".join(f"' ' || {'lpad' if right and i == 2 else 'rpad'}({x}, {padded[i]}, ' ') || ' '" for i, x in enumerate(r)) + " || '│'"
            lines = [f"'// c.csv:{where[whole]} | 2 records'", "''", rule("┌", "┬", "┐"), row([text(t) for t in titles], False), rule("├", "┼", "┤"), *(row(r, whole) for r in cells), rule("└", "┴", "┘"), "''", f"'// Summary: 2 rows × {size} columns'"]
        out.append(" || chr(10) || ".join(lines))
    return f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN {out[0]} ELSE {out[1]} END AS output, {n} AS n FROM customer"


# ---- sources, sinks, streams ----


def _lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.explode_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")


_LINES_SQL = "SELECT doc_id, cast(i AS int) AS line_no, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "1 as start_line", "3 as start_char", "1 as end_line", "3 as end_char")
    return sources.select_text(docs).select("doc_id", "selected")


_SELECTION_SQL = "SELECT doc_id, coalesce(string_split(text, chr(10))[2], '') AS selected FROM documents"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.counts_of_documents(spark, sf_dir)


#: What is detected in the documents, by the hour their ids stand for, as far as the watermark closes the hours.
_STREAM_SQL = f"""{detection.scored_duck(streaming.STREAM_CONFIG)},
    clock AS (SELECT doc_id, {streaming.EVENT_TIME.format(interval="to_minutes(cast(7 * doc_id as int))")} AS ts FROM documents),
    hours AS (SELECT time_bucket(INTERVAL 1 HOUR, c.ts) AS window_start, r.type, count(*) AS n FROM ranked r JOIN clock c ON c.doc_id = r.id WHERE r.first AND r.src = 'doc' GROUP BY ALL)
    SELECT window_start, type, n FROM hours WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM clock) - INTERVAL 2 HOUR"""


def _all() -> dict[str, Query]:
    out: dict[str, Query] = {
        "delimiter_first_line": _sql_of("customer", _first_line),
        "delimiter_sample": (_delimiter_sample, _delimiter_sample_sql()),
        "parse_quoted": (_parsed, _PARSED_SQL),
        "parse_naive": (_naive, "SELECT c_custkey, c_name || '/' || c_mktsegment || '/' || c_nationkey AS fields FROM customer"),
        "header_by_numbers": (_header_numbers, "SELECT c_custkey, c_custkey % 4 <> 1 AS has_header FROM customer"),
        "document_kinds": (_lookups, _LOOKUPS_SQL),
        "classify_columns": (_classify, _classify_sql()),
        "classify_columns_in_plan": (_classify_in_plan, f"SELECT name, type FROM ({_classify_sql()})"),
        "mask_delimited": (_mask_delimited, _mask_delimited_sql()),
        "mask_delimited_texts": (_mask_delimited_texts, _mask_delimited_texts_sql()),
        "copy_with_context": (_copied, _copied_sql()),
        "copy_pages": (_copied_pages, _COPIED_PAGES_SQL),
        "copy_json": (_copied_json, _COPIED_JSON_SQL),
        "copy_code": (_copied_code, _COPIED_CODE_SQL),
        "pattern_catalog": (_catalog, _CATALOG_SQL),
        "column_categories": (_categories, _CATEGORIES_SQL),
        "line_numbers": _sql_of("customer", _numbered),
        "line_numbers_documents": _sql_of("documents", _documents_numbered),
        "offset_of_position": (_offsets, _OFFSETS_SQL),
        "escape_html": _sql_of("pages", lambda d: ["page_id", f"{d.sha256(render.escape_html('html'))} as digest"]),
        "render_html": (_html, _HTML_SQL),
        "xml_tags": (_tags, _TAGS_SQL),
        "xml_siblings": (_siblings, _siblings_sql()),
        "xml_tag_counts": (_tag_counts, _TAG_COUNTS_SQL),
        "xml_paths": (_xml_paths, _xml_paths_sql()),
        "xml_boxes": (_xml_boxes, _XML_BOXES_SQL),
        "contexts": (_contexts, _CONTEXTS_SQL),
        "large_documents": (_large, _LARGE_SQL),
        "header_lines": (_header_lines, "SELECT doc_id, string_split(text, chr(10))[1] AS header FROM documents"),
        "column_range_union": (_range_union, f"SELECT c_nationkey, min(start_column) AS start_column, max(end_column) AS end_column FROM ({_RANGES_SQL}) JOIN customer USING (c_custkey) GROUP BY c_nationkey"),
        "classify_columns_lists": (_classify_lists, _CLASSIFY_LISTS_SQL),
        "output_modes": (_modes, _MODES_SQL),
        "table_simple": (_simple_table, _SIMPLE_TABLE_SQL),
        "json_paths": (_json_paths, _json_paths_sql()),
        "code_context": (_code, _code_sql()),
        "selected_columns": (_selected_columns, _SELECTED_SQL),
        "aligned_lines": (_aligned, _ALIGNED_SQL),
        "business_dates": (_business_dates, _BUSINESS_SQL),
        "column_ranges": (_ranges, _RANGES_SQL),
        "mask_json_fields": (_json_fields, _JSON_FIELDS_SQL),
        "mask_cdata": (_cdata, _cdata_sql()),
        "custom_pattern": (_custom, _CUSTOM_SQL),
        "report_table": (_table_report, _table_report_sql()),
        "report_smart": (_report(render.smart_report)[0], _smart_sql()),
        "report_detailed": (_report(render.detailed_report)[0], _detailed_sql()),
        "source_lines": (_lines_source, _LINES_SQL),
        "source_selection": (_selection, _SELECTION_SQL),
        "stream_counts": (_stream, _STREAM_SQL),
    }
    out |= {f"copy_delimited_{m}": (_copied_csv(m), _copied_csv_sql(m)) for m in ("table", "smart", "detailed")}
    out["copy_delimited_masked"] = (_copied_csv("smart", True), _copied_csv_sql("smart", True))
    out |= {f"profile_{t}": _profile(t, columns) for t, columns in _PROFILED.items()}
    out |= {f"mask_columns_{t}_{s}": _mask_columns(t, s) for t in _MASKED for s in ("partial", "hash")}
    out |= {f"render_{f}": _rendered(f) for f in ("plain", "markdown", "ansi")}
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s is not None}
