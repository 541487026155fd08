"""The whole way of a selection: text, masking, location, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MaskingConfig, RenderConfig
from ..functions import delimited as dl
from ..sources.lines import select_text
from . import location, render
from .detect import held
from .mask_text import with_masked_text
from .tabular import mask_delimited_texts

_FORMATS = {"plain": render.plain, "markdown": render.markdown, "ansi": render.ansi, "html": render.html}


def report_udf(config: RenderConfig):
    """Arrow UDF (lines, header line, start line from 0, end line, name, delimiter, first column) -> the selection as config.output_mode shows it.

    Blank lines are dropped. From line 0 on the first line left names the
    columns; else the file's first line does, from the selection's first column,
    if it has the delimiter and enough fields, and otherwise they are numbered.
    """

    def one(lines: str, first: str, start: int, end: int, name: str, delimiter: str, offset: int) -> str | None:
        rows = [dl.naive_cells(x, delimiter) for x in lines.split("\n") if x.strip()]
        if not rows:
            return None
        names = dl.naive_cells(first, delimiter)[offset : offset + len(rows[0])] if delimiter in first else []
        numbered = [f"Column_{i + 1}" for i in range(len(rows[0]))]
        headers, data = (rows[0], rows[1:] or rows) if start == 0 else (names if len(names) == len(rows[0]) else numbered, rows)
        return render.rows_report(config, name, start + 1, end + 1, headers, data)

    @F.pandas_udf("string")
    def reports(lines: pd.Series, first: pd.Series, start: pd.Series, end: pd.Series, name: pd.Series, delimiter: pd.Series, offset: pd.Series) -> pd.Series:
        rows = zip(lines, first, start, end, name, delimiter, offset, strict=True)
        return pd.Series([None if r[0] is None else one(r[0], r[1], int(r[2]), int(r[3]), r[4], r[5], int(r[6])) for r in rows], dtype=object)

    return reports


def copy_with_context(df: DataFrame, masking: MaskingConfig | None = None, config: RenderConfig | None = None, fmt: str = "plain") -> DataFrame:
    """df(name, path, language, text, start_line, start_char, end_line, end_char) with output and detections.

    Positions count from 0; an empty selection takes its line. Lines of a
    delimited file are trimmed to the leftmost common column and then masked,
    each from the column it really begins in, so that nothing a trim brings back
    is left unmasked; below line 0 that line gives the names. Other texts are masked by their content.
    The header tells name, lines and the path at the selection's start. In the
    output modes smart, table and detailed a selection of a delimited file is
    shown as that report, without its blank lines.
    """
    config = config or RenderConfig()
    kind = f"{dl.is_delimited('language', 'path')}"
    is_empty = "(start_line = end_line and start_char = end_char)"
    out = select_text(df, "_cp_selected").withColumn("_cp_first", F.expr("split(coalesce(text, ''), '\\n', -1)[0]"))
    full = F.expr("slice(split(coalesce(text, ''), '\\n', -1), start_line + 1, end_line - start_line + 1)")
    parts = F.expr(f"if({kind} and not {is_empty}, split(_cp_selected, '\\n', -1), null)")
    out = out.withColumn("_cp_delimiter", F.expr(dl.first_line_delimiter("coalesce(text, '')")))
    as_report = config.output_mode != "minimal"
    fits = F.expr(f"if(size(split(_cp_selected, '\\n', -1)) = end_line - start_line + 1, {kind} and not {is_empty}, false)")
    # where nothing is aligned, as for an empty selection, which takes its line, it begins in the first column
    begins = F.expr(f"if({is_empty}, 0, size(split(substring(split(coalesce(text, ''), '\\n', -1)[start_line], 1, start_char), concat('\\\\Q', _cp_delimiter, '\\\\E'), -1)) - 1)")
    out = out.withColumn("_cp_begins", begins)
    out = out.withColumn("_cp_full", full).withColumn("_cp_parts", F.when(fits, parts))
    if as_report:
        out = out.withColumn("_cp_full", F.expr("filter(_cp_full, (l, i) -> _cp_parts is null or trim(_cp_parts[i]) <> '')")).withColumn("_cp_parts", F.expr("if(forall(_cp_parts, l -> trim(l) = ''), null, filter(_cp_parts, l -> trim(l) <> ''))"))
    trimmed = location.aligned_lines_udf()("_cp_full", "_cp_parts", F.col("start_line") + 1, F.col("start_char"), "_cp_delimiter")
    out = out.withColumn("_cp_trim", trimmed).withColumn("_cp_selected", F.coalesce(F.array_join("_cp_trim.lines", "\n"), F.col("_cp_selected")))
    out = held(out, "_cp_selected", "_cp_trim")
    if masking is not None and masking.enabled:
        out = out.withColumn("_cp_prose", F.expr(f"if({kind}, null, _cp_selected)")).withColumn("_cp_rows", F.expr(f"if({kind}, _cp_selected, null)"))
        out = with_masked_text(out, "_cp_prose", masking).withColumnRenamed("masked_text", "_cp_masked").withColumnRenamed("detections", "_cp_found").drop("masking_applied", "has_overlap")
        out = out.withColumn("_cp_header", F.expr("if(start_line > 0, _cp_first, null)")).withColumn("_cp_columns", F.expr("if(start_line > 0, coalesce(_cp_trim.columns, array(_cp_begins)), null)"))
        out = mask_delimited_texts(out, "_cp_rows", masking, "_cp_header", "_cp_columns")
        plain = "transform(detections, d -> named_struct('type', d.type, 'original_value', d.original_value, 'masked_value', d.masked_value, 'line', d.line, 'column', d.column, 'confidence', d.confidence))"
        out = out.withColumn("detections", F.expr(f"if({kind}, {plain}, _cp_found)")).withColumn("_cp_body", F.expr(f"if({kind}, masked_text, _cp_masked)"))
    else:
        none = "cast(array() as array<struct<type: string, original_value: string, masked_value: string, line: int, column: int, confidence: double>>)"
        out = out.withColumn("detections", F.expr(none)).withColumn("_cp_body", F.col("_cp_selected"))

    out = held(out, "_cp_body", "detections")
    if config.show_context_path:
        at = out.withColumn("line", F.col("start_line")).withColumn("character", F.col("start_char"))
        out = location.with_context(at, config, "_cp_context").drop("line", "character")
        large = location.is_large_sql("coalesce(text, '')", config)
        columns = location.delimited_context_udf()(F.expr(f"if({kind} and not {is_empty} and not {large}, text, null)"), "start_line", "start_char", "end_line", "end_char")
        out = out.withColumn("_cp_context", F.coalesce("_cp_context", columns))
    out = out.withColumns({"_cp_start": F.col("start_line") + 1, "_cp_end": F.col("end_line") + 1})
    head = render.header("name", "_cp_start", "_cp_end", "_cp_context" if config.show_context_path else None)
    body = render.numbered_lines("_cp_body", "_cp_start", config.line_number_padding, config.show_line_numbers)
    made = _FORMATS[fmt](head, body) if fmt in ("plain", "ansi") else render.markdown(head, body, "language") if fmt == "markdown" else render.html(head, body)
    if as_report:
        masked = masking is not None and masking.enabled  # masked lines are joined with commas
        delimiter = F.lit(",") if masked else F.col("_cp_delimiter")
        header_line = F.expr("split(coalesce(text, ''), '\\n', -1)[0]") if not masked else F.expr(f"array_join({dl.parse('_cp_first', ',', True)}, ',')")
        shown = F.when(F.expr(f"{kind} and not {is_empty}"), F.col("_cp_body"))
        report = report_udf(config)(shown, header_line, "start_line", "end_line", "name", delimiter, F.coalesce("_cp_trim.first_column", F.lit(0)))
        out = out.withColumn("_cp_report", report)
        made = f"coalesce(_cp_report, {made})"
    return out.withColumn("output", F.expr(made)).select(*df.columns, "output", "detections")
