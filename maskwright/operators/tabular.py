"""Tabular operators: delimiter and header detection, profiles, alignment, column masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MaskingConfig
from ..functions import delimited as dl
from ..functions import registry as reg
from ..functions.masks import mask_sql
from .detect import mask_by_type_sql, unused
from .mask_text import column_type_sql

SHARE = 0.7


def detect_delimiters(lines: DataFrame, by: str, line_col: str = "line") -> DataFrame:
    """(by, delimiter) of files given as sample lines: the best of mean * 10 - variance over their lines.

    Lines of fewer than three characters don't count; quotes hide what they
    hold; a delimiter needs a mean of one or more and a positive score; ties go
    to the earlier in the list; without any the comma.
    """
    counts = [F.expr(dl.unquoted_count(f"`{line_col}`", c)).alias(f"_n{i}") for i, c in enumerate(dl.DELIMITERS)]
    used = lines.select(by, *counts, F.expr(f"length({dl.trim(f'`{line_col}`')}) >= 3").alias("_used"))
    each = [F.struct(F.avg(F.when(F.col("_used"), F.col(f"_n{i}"))).alias("mean"), F.var_pop(F.when(F.col("_used"), F.col(f"_n{i}"))).alias("var")).alias(f"_s{i}") for i in range(len(dl.DELIMITERS))]
    scored = used.groupBy(by).agg(*each)
    candidates = F.array(*[F.struct((F.col(f"_s{i}.mean") * 10 - F.col(f"_s{i}.var")).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("delimiter"), F.col(f"_s{i}.mean").alias("mean")) for i, c in enumerate(dl.DELIMITERS)])
    best = F.array_max(F.filter(candidates, lambda x: (x["mean"] >= 1) & (x["score"] > 0)))
    return scored.select(by, F.coalesce(best["delimiter"], F.lit(",")).alias("delimiter"))


def header_by_numbers(first: str, second: str, delimiter: str = ",") -> str:
    """SQL: whether the first line has fewer numbers than the second; blank fields count as numbers."""

    def numbers(line: str) -> str:
        return f"size(filter({dl.parse(line, delimiter, both_quotes=True)}, f -> {dl.is_number_or_blank('f')}))"

    return f"if(coalesce({dl.trim(second)}, '') = '', true, {numbers(first)} < {numbers(second)})"


def _text(column: str) -> str:
    return f"coalesce(cast(`{column}` as string), '')"


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: counts, inferred type, min, max and mean of numeric columns, insights, alignments.

    Values are read as text, nulls as blanks. Equal values of a column are
    counted together (before the shuffle, where they meet), and every test is
    then made once per distinct value.
    """
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.expr(_text(c)).alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.explode(cells).alias("c")).groupBy("c.position", "c.v").agg(F.count("*").alias("k"))
    tested = values.select(
        "position", "k", F.expr(f"{dl.is_number('v')}").alias("numeric"), F.expr(dl.is_one_of("v", dl.BOOLEANS)).alias("boolean"), F.expr(dl.is_one_of("v", dl.BOOLEANS_LONG)).alias("boolean_long"),
        F.expr(f"{dl.trim('v')} <> ''").alias("filled"), F.expr("instr(v, '.') > 0").alias("decimal"), F.expr(dl.number("v")).alias("x"), F.length("v").alias("width"),
    )

    def rows_where(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(condition), F.col("k"))), F.lit(0))

    totals = tested.groupBy("position").agg(
        F.sum("k").alias("n"), F.count("*").alias("n_distinct"), rows_where("numeric").alias("n_numeric"), rows_where("boolean").alias("n_boolean"), rows_where("boolean_long").alias("n_boolean_long"),
        rows_where("filled").alias("n_filled"), F.bool_or("decimal").alias("decimals"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("k")).alias("sum"), F.max("width").alias("width"),
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    whole = names.join(totals, "position", "left").fillna(0, ["n", "n_distinct", "n_numeric", "n_boolean", "n_boolean_long", "n_filled", "width"]).fillna(False, ["decimals"])
    return whole.select("column", "position", "n", "n_distinct", *(F.expr(sql).alias(name) for name, sql in _PROFILE.items()))


_NUMERIC, _BOOLEAN = f"n_numeric > n * {SHARE}D", f"n_boolean > n * {SHARE}D"
_PROFILE = {
    "type": f"case when {_BOOLEAN} then 'Boolean' when {_NUMERIC} then if(decimals, 'Float', 'Integer') else 'String' end",
    "min": f"if({_NUMERIC}, min, null)",
    "max": f"if({_NUMERIC}, max, null)",
    "mean": f"if({_NUMERIC}, sum / n_numeric, null)",
    "is_category": "n_distinct > 1 and n_distinct < n * 0.5D",
    "is_identifier": "lower(column) rlike 'id|key|number'",
    "is_date": "lower(column) rlike 'date|time'",
    "alignment": f"case when n_boolean_long > n * {SHARE}D then 'center' when {_NUMERIC} then 'right' else 'left' end",
    # blanks don't count, and numbers come before booleans
    "alignment_filled": "case when n_filled = 0 then 'left' when n_numeric / n_filled > 0.8D then 'right' when n_boolean / n_filled > 0.8D then 'center' else 'left' end",
    "width": "greatest(length(column), width, 5)",
}


def classify_columns(df: DataFrame, config: MaskingConfig | None = None) -> list[tuple[str, bool, str]]:
    """(name, sensitive or not, type) of each column, from the names alone."""
    config = config or MaskingConfig()
    return [(c, reg.is_sensitive_column(c, config), reg.column_type(c)) for c in df.columns]


def mask_columns(df: DataFrame, config: MaskingConfig | None = None) -> DataFrame:
    """df with the sensitive columns masked by the type their name stands for; blank values stay, columns become text."""
    config = config or MaskingConfig()
    out = []
    for name, sensitive, kind in classify_columns(df, config):
        v = f"cast(`{name}` as string)"
        mask = mask_sql(reg.MASKS.get(kind, "generic"), v, config.strategy, strict_compat=config.strict_compat)
        out.append(F.expr(f"case when {dl.trim(v)} <> '' then {mask} else {v} end").alias(name) if sensitive else F.col(f"`{name}`"))
    return df.select(*out)


def mask_delimited(lines: DataFrame, header: str, config: MaskingConfig | None = None, line_col: str = "line") -> DataFrame:
    """Data lines with the sensitive fields masked: columns masked_line and detections added.

    The header tells the columns. Lines are read and joined with commas; quotes
    are not put back.
    """
    config = config or MaskingConfig()
    columns = parse_header(lines, header)
    fields = dl.parse(f"`{line_col}`", ",", both_quotes=True)
    by_type: dict[str, list[int]] = {}
    for i, name in enumerate(columns):
        if reg.is_sensitive_column(name, config):
            by_type.setdefault(reg.column_type(name), []).append(i)
    if not by_type:
        masked = "f"
    else:
        cases = " ".join(f"when i in ({', '.join(map(str, at))}) then {mask_sql(reg.MASKS.get(kind, 'generic'), 'f', config.strategy, strict_compat=config.strict_compat)}" for kind, at in by_type.items())
        masked = f"case when f = '' then f {cases} else f end"
    name = "_fields"
    while name in lines.columns:
        name += "_"
    sensitive = sorted(i for at in by_type.values() for i in at)
    kinds = {i: kind for kind, at in by_type.items() for i in at}
    titles = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}'" for c in columns) or "''"
    types = ", ".join(f"'{kinds.get(i, 'custom')}'" for i in range(len(columns))) or "''"
    chosen = f"array_contains(array({', '.join(map(str, sensitive))}), i)" if sensitive else "false"
    found = (
        f"filter(transform({name}, (f, i) -> if({chosen} and f <> '', named_struct('type', array({types})[i], 'original_value', f, 'masked_value', {masked}, 'confidence', 0.95D, "
        f"'column_context', named_struct('name', array({titles})[i], 'index', i)), null)), x -> x is not null)"
    )
    return lines.withColumn(name, F.expr(fields)).withColumns({"masked_line": F.expr(f"array_join(transform({name}, (f, i) -> {masked}), ',')"), "detections": F.expr(found)}).drop(name)


def _name_has(name: str, words: tuple[str, ...]) -> str:
    known = rf"regexp_replace(lower({name}), r'[_\s-]', '')"
    return "(" + (" or ".join(f"instr({known}, '{reg.normalized_name(w)}') > 0" for w in words) or "false") + ")"


def is_sensitive_sql(name: str, config: MaskingConfig) -> str:
    """SQL of registry.is_sensitive_column, for names that are data."""
    if config.allow_list:
        built_in = f"not {_name_has(name, config.allow_list)}"
    else:
        types = config.effective_types()
        built_in = _name_has(name, tuple(w for c, words in reg.COLUMN_CATEGORIES.items() if types.get(c) is not False for w in words))
    return f"({_name_has(name, config.deny_list)} or {built_in})"


def mask_delimited_texts(df: DataFrame, text_col: str, config: MaskingConfig | None = None, header_col: str | None = None, columns_col: str | None = None) -> DataFrame:
    """df with masked_text and detections of texts that hold delimited lines.

    The header is the first line, which stays, or header_col where it isn't
    null, and then every line is data. columns_col: an array with the header's
    column that each data line begins in; without it, or where it is null, they
    begin in the first. Lines are read and joined with commas; detections tell
    the line of the text and the header's column. Null stays null.
    """
    config = config or MaskingConfig()
    t, lines, names, cells = unused(df, "_dt_text", "_dt_lines", "_dt_names", "_dt_cells")
    outside = f"`{header_col}`" if header_col else "cast(null as string)"
    known = sorted({*reg.CATEGORY_TYPES.values(), "nmi", "custom"})
    mask = mask_by_type_sql("c.value", "c.type", config.strategy, known, config.strict_compat)
    header = f"transform({dl.parse(f'coalesce({outside}, {lines}[0])', ',', True)}, n -> named_struct('name', n, 'type', {column_type_sql('n')}, 'hide', {is_sensitive_sql('n', config)}))"
    data = f"if({outside} is null, slice({lines}, 2, size({lines})), {lines})"
    shift = f"if({outside} is null, 2, 1)"
    at = f"(i + coalesce(get(`{columns_col}`, k), 0))" if columns_col else "i"
    each = (
        f"transform({data}, (l, k) -> transform({dl.parse('l', ',', True)}, (f, i) -> named_struct('value', f, 'line', k + {shift}, 'index', {at}, 'name', coalesce(get({names}, {at}).name, ''), "
        f"'type', coalesce(get({names}, {at}).type, 'custom'), 'hide', coalesce(get({names}, {at}).hide, false) and f <> '')))"
    )
    shown = f"transform({cells}, cs -> array_join(transform(cs, c -> if(c.hide, {mask}, c.value)), ','))"
    found = (
        f"transform(filter(flatten({cells}), c -> c.hide), c -> named_struct('type', c.type, 'original_value', c.value, 'masked_value', {mask}, 'line', c.line, 'column', c.index, "
        f"'confidence', 0.95D, 'column_context', named_struct('name', c.name, 'index', c.index)))"
    )
    out = df.withColumn(t, F.coalesce(F.col(text_col), F.lit(""))).withColumn(lines, F.expr(f"split({t}, '\\n', -1)")).withColumn(names, F.expr(header)).withColumn(cells, F.expr(each))
    whole = f"if({outside} is null, concat(array({lines}[0]), {shown}), {shown})"
    return out.withColumns({"masked_text": F.when(F.col(text_col).isNotNull(), F.expr(f"array_join({whole}, chr(10))")), "detections": F.expr(found)}).drop(t, lines, names, cells)


def parse_header(df: DataFrame, header: str) -> list[str]:
    """The fields of one header line, read by the same expression as the data."""
    row = df.sparkSession.createDataFrame([(header,)], "h string").selectExpr(f"{dl.parse('h', ',', both_quotes=True)} as f").first()
    return list(row["f"])


def union_ranges(ranges: DataFrame, by: str) -> DataFrame:
    """The column range that covers the ranges of all lines."""
    return ranges.groupBy(by).agg(F.min("start_column").alias("start_column"), F.max("end_column").alias("end_column"))


def with_row_numbers(lines: DataFrame, start_line: int, line_no: str = "line_no") -> DataFrame:
    """Displayed numbers: data below a header line start one lower."""
    return lines.withColumn("number", F.col(line_no) + F.lit(start_line + 1 if start_line == 1 else start_line))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
