"""Rendering: numbered lines, HTML, Markdown, ANSI, tables, smart and detailed reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RenderConfig
from ..functions.dialect import SPARK, Spark

# Entity for each special character, in order of replacement; colours; frames.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
_BLUE, _ORANGE, _GREEN, _LIGHT = "#569CD6", "#CE9178", "#B5CEA8", "#9CDCFE"
_DIV = "<div style=\"font-family: 'Consolas', 'Monaco', monospace; background: #1e1e1e; color: #d4d4d4; padding: 16px; border-radius: 4px;\">"
_TITLE, _PRE = '<div style="color: #6a9955; margin-bottom: 8px;">', '<pre style="margin: 0; white-space: pre-wrap;">'


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def escape_html(x: str) -> str:
    """SQL of either engine."""
    for raw, entity in ENTITIES:
        x = f"replace({x}, {'chr(39)' if raw == chr(39) else _quoted(raw)}, '{entity}')"
    return x


def _span(colour: str, group: int) -> str:
    return f'<span style="color: {colour}">${group}</span>'


def highlight(code: str, language: str, d: Spark = SPARK) -> str:
    """SQL: escaped code with coloured words, by rules applied one after another.

    The rules see the escaped text and the spans of earlier rules, as the
    original's do: JSON strings stay plain and attributes of spans may be coloured.
    """
    rules = {
        "json": ((r'(".*?")', _span(_ORANGE, 1)), (r"\b(\d+\.?\d*)\b", _span(_GREEN, 1)), (r"\b(true|false|null)\b", _span(_BLUE, 1))),
        "javascript": ((r"\b(const|let|var|function|class|if|else|for|while|return|import|export)\b", _span(_BLUE, 1)), (r"""(".*?"|\x27.*?\x27|`.*?`)""", _span(_ORANGE, 1))),
        "xml": ((r"(&lt;/?)([a-zA-Z][a-zA-Z0-9-_]*)", "$1" + _span(_BLUE, 2)), (r'([a-zA-Z-]+)=(".*?")', _span(_LIGHT, 1) + "=" + _span(_ORANGE, 2))),
    }
    kind = {"jsonc": "json", "typescript": "javascript", "html": "xml"}.get(language, language)
    out = escape_html(code)
    for pattern, by in rules.get(kind, ()):
        out = d.replace(out, pattern, re.sub(r"\$(\d)", r"\\\1", by) if d.name == "duckdb" else by)
    return out


def numbered_lines(x: str, start_line: str, padding: bool = False, show: bool = True, d: Spark = SPARK) -> str:
    """SQL: the lines with their numbers; a common indent of more than two is taken off longer lines."""
    if not show:
        return x
    if d.name == "duckdb":
        lines = f"string_split({x}, chr(10))"
        indent = rf"coalesce(list_min(list_transform(list_filter({lines}, lambda l: regexp_matches(l, '[^\s]')), lambda l: length(l) - length(regexp_replace(l, '^\s+', '')))), 0)"
        width = f"length(cast({start_line} + len({lines}) - 1 as string))"
        number = f"cast({start_line} + i - 1 as string)"
        number = f"lpad({number}, greatest({width}, length({number}))::int, ' ')" if padding else number
        body = f"CASE WHEN {indent} > 2 AND length({lines}[i]) > {indent} THEN substring({lines}[i], {indent} + 1) ELSE {lines}[i] END"
        return f"array_to_string(list_transform(range(1, len({lines}) + 1), lambda i: {number} || ': ' || {body}), chr(10))"
    lines = rf"split({x}, '\\n', -1)"
    indent = r"coalesce(array_min(transform(filter(v.lines, l -> l rlike r'[^\s]'), l -> length(l) - length(regexp_replace(l, r'^\s+', '')))), 0)"
    number = f"cast({start_line} + i as string)"
    if padding:
        number = f"lpad({number}, greatest(length(cast({start_line} + size(w.lines) - 1 as string)), length({number})), ' ')"
    body = f"array_join(transform(w.lines, (l, i) -> concat({number}, ': ', if(w.indent > 2 and length(l) > w.indent, substring(l, w.indent + 1), l))), chr(10))"
    with_indent = f"element_at(transform(array(named_struct('lines', {lines})), v -> named_struct('lines', v.lines, 'indent', {indent})), 1)"
    return f"element_at(transform(array({with_indent}), w -> {body}), 1)"


def header(name: str, start: str, end: str, context: str | None = None) -> str:
    """SQL: ``// name:3-5 (context)``."""
    lines = f"case when {start} = {end} then cast({start} as string) else concat(cast({start} as string), '-', cast({end} as string)) end"
    tail = f", case when coalesce({context}, '') = '' then '' else concat(' (', {context}, ')') end" if context else ""
    return f"concat('// ', {name}, ':', {lines}{tail})"


def plain(head: str, body: str) -> str:
    return f"concat({head}, chr(10), {body})"


def markdown(head: str, body: str, language: str) -> str:
    return f"concat({head}, chr(10), '```', {language}, chr(10), {body}, chr(10), '```')"


def ansi(head: str, body: str) -> str:
    return f"concat(chr(27), '[32m', {head}, chr(27), '[0m', chr(10), {body})"


def html(head: str, body: str, language: str = "", d: Spark = SPARK) -> str:
    return f"concat({_quoted(_DIV)}, chr(10), '{_TITLE}', {escape_html(head)}, '</div>', chr(10), '{_PRE}', {highlight(body, language, d)}, '</pre>', chr(10), '</div>')"


def render(df: DataFrame, fmt: str = "plain", config: RenderConfig | None = None, language: str = "", into: str = "output") -> DataFrame:
    """df(name, start_line, end_line, context, text) with the rendered text; masked text goes in masked.

    fmt: plain, html, markdown or ansi.
    """
    config = config or RenderConfig()
    body = numbered_lines("text", "start_line", config.line_number_padding, config.show_line_numbers)
    head = header("name", "start_line", "end_line", "context" if config.show_context_path else None)
    made = {"plain": lambda: plain(head, body), "html": lambda: html(head, body, language), "markdown": lambda: markdown(head, body, f"'{language}'"), "ansi": lambda: ansi(head, body)}[fmt]()
    return df.withColumn(into, F.expr(made))


# ---- tables: bounded by table_max_rows, so made on the driver ----


def _plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def _is_number(v: str) -> bool:
    return bool(re.fullmatch(r"\s*(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9A-Fa-f]+|0[oO][0-7]+|0[bB][01]+|[+-]?Infinity)\s*", v))


def alignments(rows: list[list[str]], numbers: str = "right") -> list[str]:
    """Per column of the displayed rows: center for booleans, ``numbers`` for numbers, else left."""
    from ..functions.delimited import BOOLEANS_LONG

    out = []
    for i in range(len(rows[0]) if rows else 0):
        values = [r[i] if i < len(r) else "" for r in rows]
        booleans, numeric = sum(v.lower() in BOOLEANS_LONG for v in values), sum(map(_is_number, values))
        out.append("center" if booleans > 0.7 * len(values) else numbers if numeric > 0.7 * len(values) else "left")
    return out


def _frame(widths: list[int], left: str, middle: str, right: str) -> str:
    return left + middle.join("─" * (w + 2) for w in widths) + right


def _pad(v: str, width: int, side: str) -> str:
    if side == "right":
        return v.rjust(width)
    if side == "center":
        left = max(0, width - len(v)) // 2
        return " " * left + v + " " * max(0, width - len(v) - left)
    return v.ljust(width)


def ascii_table(rows: list[list[str]], headers: list[str], config: RenderConfig | None = None, total_rows: int | None = None) -> str:
    """A framed table of the first rows and columns, with a notice of those left out.

    total_rows: the number of rows there are, if ``rows`` are only the first.
    """
    config = config or RenderConfig()
    if not rows or not headers:
        return ""
    if len(headers) > config.table_max_columns:
        keep = config.table_max_columns - 1
        headers, rows = [*headers[:keep], f"({len(headers) - keep} more)"], [[*r[:keep], "..."] for r in rows]
    total = len(rows) if total_rows is None else total_rows
    rows = rows[: config.table_max_rows]
    widths = [max(5, len(h), *(len(r[i]) if i < len(r) else 0 for r in rows)) for i, h in enumerate(headers)]
    sides = alignments(rows, config.align_numbers)
    body = ["│" + "│".join(f" {_pad(v, widths[i] if i < len(widths) else 5, sides[i] if i < len(sides) else 'left')} " for i, v in enumerate(r)) + "│" for r in rows]
    lines = [_frame(widths, "┌", "┬", "┐"), "│" + "│".join(f" {h.ljust(w)} " for h, w in zip(headers, widths, strict=True)) + "│", _frame(widths, "├", "┼", "┤"), *body, _frame(widths, "└", "┴", "┘")]
    if total > len(rows):
        lines.append(f"... {_plural(total - len(rows), 'more row')} (increase maxRows to see all)")
    return "\n".join(lines)


def simple_table(headers: list[str], rows: list[list[str]], widths: list[int] | None = None) -> str:
    """A framed table of all rows, every cell to the left."""
    widths = widths or [max(3, len(h), *(len(r[i]) if i < len(r) else 0 for r in rows)) for i, h in enumerate(headers)]

    def line(cells: list[str]) -> str:
        return "│ " + " │ ".join(c.ljust(widths[i] if i < len(widths) else 0) for i, c in enumerate(cells)) + " │"

    return "\n".join([_frame(widths, "┌", "┬", "┐"), line(headers), _frame(widths, "├", "┼", "┤"), *map(line, rows), _frame(widths, "└", "┴", "┘")])


def _value(v: str) -> float:
    try:
        return float(v)
    except ValueError:
        return float(int(v.strip(), 0))


def _mostly(values: list[str]) -> str | None:
    """What more than 0.7 of a column's cells are: Boolean, Float, Integer; else None."""
    from ..functions.delimited import BOOLEANS

    if sum(v.lower() in BOOLEANS for v in values) > 0.7 * len(values):
        return "Boolean"
    if sum(map(_is_number, values)) > 0.7 * len(values):
        return "Float" if any("." in v for v in values) else "Integer"
    return None


def rows_report(config: RenderConfig, name: str, start: int, end: int, headers: list[str], rows: list[list[str]]) -> str:
    """A selection's rows in the output mode table, smart or detailed; lines count from 1, data below a header line one on."""
    where = str(start) if start == end else f"{start}-{end}"
    summary = f"// Summary: {_plural(len(rows), 'row')} × {_plural(len(headers), 'column')}"
    if config.output_mode == "table":
        return f"// {name}:{where} | {_plural(len(rows), 'record')}\n\n{ascii_table(rows, headers, config)}\n\n{summary}"
    columns = [[r[i] if i < len(r) else "" for r in rows] for i in range(len(headers))]
    first = start + (start == 1)
    data = [f"{first + i}: {', '.join(r)}" for i, r in enumerate(rows)]
    head = [f"// {name}:{where}", f"// Columns: {', '.join(headers)}", f"// Types: {', '.join(_mostly(c) or 'String' for c in columns)}", ""]
    if config.output_mode == "smart":
        return "\n".join([*head, *data])
    statistics = []
    for h, values in zip(headers, columns, strict=True):
        numbers = [_value(v) for v in values if _is_number(v)]
        if len(numbers) > 0.7 * len(values):
            statistics.append(f"  {h}: min={min(numbers):.2f}, max={max(numbers):.2f}, avg={sum(numbers) / len(numbers):.2f}")
    titles = {
        "Identifier columns": [h for h in headers if re.search("id|key|number", h.lower())],
        "Category columns": [h for h, values in zip(headers, columns, strict=True) if 1 < len(set(values)) < 0.5 * len(values)],
        "Date/Time columns": [h for h in headers if re.search("date|time", h.lower())],
    }
    insights = [f"//   {title}: {', '.join(own)}" for title, own in titles.items() if own]
    parts = [*head, *(["// Statistics:", *statistics, ""] if statistics else []), *(["// Insights:", *insights, ""] if insights else [])]
    return "\n".join([*parts, "// Data:", *data, "", summary])


def table_report(df: DataFrame, name: str, config: RenderConfig | None = None, start_line: int = 1) -> str:
    """The first rows of df as a table, with its numbers of rows and columns."""
    config = config or RenderConfig()
    n = df.count()
    shown = [["" if v is None else str(v) for v in r] for r in df.limit(config.table_max_rows).collect()]
    end = start_line + n - (0 if start_line == 1 else 1)
    lines = str(start_line) if end == start_line else f"{start_line}-{end}"
    return f"// {name}:{lines} | {_plural(n, 'record')}\n\n{ascii_table(shown, df.columns, config, n)}\n\n// Summary: {_plural(n, 'row')} × {_plural(len(df.columns), 'column')}"


def _data_lines(df: DataFrame, number: str, columns: list[str]) -> DataFrame:
    cells = F.concat_ws(", ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return df.select((F.col(number) + 1000).cast("long").alias("seq"), F.concat(F.col(number).cast("string"), F.lit(": "), cells).alias("line"))


def smart_report(df: DataFrame, name: str, number: str, columns: list[str] | None = None) -> DataFrame:
    """(seq, line): header, column names, inferred types, then the numbered rows; seq gives the order.

    number: the column with each row's displayed number.
    """
    from .tabular import profile

    columns = columns or [c for c in df.columns if c != number]
    stats = sorted(profile(df, columns).collect(), key=lambda r: r["position"])
    bounds = df.agg(F.min(number), F.max(number)).first()
    lines = _report_head(name, bounds, columns, stats)
    head = df.sparkSession.createDataFrame(list(enumerate([*lines, ""])), "seq long, line string")
    return head.unionAll(_data_lines(df, number, columns))


def _report_head(name: str, bounds, columns: list[str], stats: list) -> list[str]:
    start, end = (bounds[0], bounds[1]) if bounds[0] is not None else (1, 1)
    where = str(start) if start == end else f"{start}-{end}"
    return [f"// {name}:{where}", f"// Columns: {', '.join(columns)}", f"// Types: {', '.join(r['type'] for r in stats)}"]


def detailed_report(df: DataFrame, name: str, number: str, columns: list[str] | None = None) -> DataFrame:
    """(seq, line): the smart report with statistics, insights and a summary."""
    from .tabular import profile

    columns = columns or [c for c in df.columns if c != number]
    stats = sorted(profile(df, columns).collect(), key=lambda r: r["position"])
    bounds = df.agg(F.min(number), F.max(number)).first()
    lines = [*_report_head(name, bounds, columns, stats), ""]
    numeric = [f"  {r['column']}: min={r['min']:.2f}, max={r['max']:.2f}, avg={r['mean']:.2f}" for r in stats if r["mean"] is not None]
    if numeric:
        lines += ["// Statistics:", *numeric, ""]
    insights = [f"//   {title}: {', '.join(own)}" for title, key in (("Identifier columns", "is_identifier"), ("Category columns", "is_category"), ("Date/Time columns", "is_date")) if (own := [r["column"] for r in stats if r[key]])]
    if insights:
        lines += ["// Insights:", *insights, ""]
    n = stats[0]["n"] if stats else 0
    head = df.sparkSession.createDataFrame(list(enumerate([*lines, "// Data:"])), "seq long, line string")
    foot = df.sparkSession.createDataFrame([((1 << 62), ""), ((1 << 62) + 1, f"// Summary: {_plural(n, 'row')} × {_plural(len(columns), 'column')}")], "seq long, line string")
    return head.unionAll(_data_lines(df, number, columns)).unionAll(foot)
