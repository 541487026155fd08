"""Masking of whole texts: CDATA sections, named fields, patterns and custom patterns, then one edit script.

Everything is built from column expressions and stays within the row. Edits
that don't overlap are applied in one pass over the text. A value once claimed is masked at its first place only; ``safe=True`` masks all
its occurrences and resolves overlapping edits (earliest, then longest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CustomPattern, MaskingConfig
from ..functions import registry as reg
from ..functions.dialect import text
from ..functions.spans import column_at_sql, firsts_sql, let, line_at_sql, marks_sql, part_sql, parts_sql, spans_sql
from .detect import candidates_sql, mask_by_type_sql, unused, with_candidates

# What texts with fields look like, sections and fields in them.
JSON_SNIFF = r'^\s*[\[{]|"[^"]+"\s*:'
XML_SNIFF = "<[^>]+>"
CDATA = r"<([^>\s/]+)>\s*<!\[CDATA\[([\s\S]*?)\]\]>\s*</\1>"
FIELDS = (r'"([^"]+)"\s*:\s*"([^"]+)"', r'"([^"]+)"\s*:\s*([0-9\s-]+)', r"<([^>\s/]+)>([^<]+)</\1>")

_DETECTION = "struct<type: string, original_value: string, masked_value: string, line: int, column: int, confidence: double>"


def column_type_sql(name: str) -> str:
    """SQL of the type a field name stands for."""
    known = rf"regexp_replace(lower({name}), r'[_\s-]', '')"
    cases = []
    for category, words in reg.COLUMN_CATEGORIES.items():
        stands_for = f"if(instr({known}, 'nmi') > 0, 'nmi', 'accountNumber')" if category == "identifier" else text(reg.CATEGORY_TYPES.get(category, "custom"))
        alternatives = "|".join(dict.fromkeys(reg.normalized_name(w) for w in words))
        cases.append(f"when {known} rlike '{alternatives}' then {stands_for}")
    return f"case {' '.join(cases)} else 'custom' end"


def _overlaps(start: str, end: str, other: str) -> str:
    return f"(({start} >= {other}.start and {start} < {other}.end) or ({end} > {other}.start and {end} <= {other}.end) or ({start} <= {other}.start and {end} >= {other}.end))"


def cdata_spans_sql(inner: str, config: MaskingConfig) -> str:
    """array<struct<type, value, start, end>> that the CDATA pass masks: in claim order, without overlaps.

    Matches at the very beginning and matches over several lines are left alone.
    """
    found = candidates_sql(inner, reg.REGISTRY.not_disabled(config.effective_types()))
    one_line = f"filter({found}, c -> c.pos > 0 and instr(c.value, chr(10)) = 0)"
    spans = f"transform({one_line}, c -> named_struct('type', c.type, 'value', c.value, 'start', c.pos, 'end', c.pos + length(c.value)))"
    none = "cast(array() as array<struct<type: string, value: string, start: int, end: int>>)"
    return f"aggregate({spans}, {none}, (kept, s) -> if(exists(kept, k -> {_overlaps('s.start', 's.end', 'k')}), kept, concat(kept, array(s))))"


def _starred(x: str, spans: str) -> str:
    return f"aggregate({spans}, {x}, (a, s) -> concat(substring(a, 1, s.start), repeat('*', s.end - s.start), substring(a, s.end + 1)))"


def mask_cdata(df: DataFrame, column: str, config: MaskingConfig | None = None, into: str = "masked") -> DataFrame:
    """df with the column's content masked star for character, its length and lines unchanged."""
    config = config or MaskingConfig()
    if not config.enabled:
        return df.withColumn(into, F.col(column))
    (spans,) = unused(df, "_cdata_spans")
    return df.withColumn(spans, F.expr(cdata_spans_sql(f"`{column}`", config))).withColumn(into, F.expr(_starred(f"`{column}`", spans))).drop(spans)


def _edit(value: str, at: str, mask: str, kind: int | str, type_: str, confidence: str) -> str:
    return f"named_struct('value', {value}, 'at', {at}, 'mask', {mask}, 'pass', {kind}, 'type', {type_}, 'confidence', {confidence})"


_EDITS = "array<struct<value: string, at: int, mask: string, pass: int, type: string, confidence: double>>"


def _fields_sql(t: str, config: MaskingConfig) -> str:
    types = config.effective_types()
    off = ", ".join(text(k) for k, v in types.items() if v is False) or "''"
    known = sorted({*reg.CATEGORY_TYPES.values(), "nmi", "custom"})
    hints = (f"instr({t}, chr(34)) > 0", f"instr({t}, chr(34)) > 0", f"instr({t}, '</') > 0")
    passes = [f"transform({spans_sql(t, regex, 2, maybe)}, s -> named_struct('value', s.g2, 'pos', s.pos + instr(s.value, s.g2) - 1, 'name', s.g1, 'pass', {2 + k}))" for k, (regex, maybe) in enumerate(zip(FIELDS, hints, strict=True))]
    filled = rf"filter(flatten(array({', '.join(passes)})), s -> s.value <> '' and not s.value rlike r'^\s*\z')"
    named = f"transform({filled}, s -> named_struct('value', s.value, 'pos', s.pos, 'pass', s.pass, 'type', {column_type_sql('s.name')}))"
    mask = mask_by_type_sql("s.value", "s.type", config.strategy, known, config.strict_compat)
    return f"transform(filter({named}, s -> s.type not in ({off})), s -> {_edit('s.value', 's.pos', mask, 's.pass', 's.type', '0.95D')})"


def custom_spans_sql(t: str, pattern: CustomPattern) -> str:
    return spans_sql(t, reg.java_regex(pattern.pattern))


def custom_matches(df: DataFrame, pattern: CustomPattern, text_col: str = "text") -> DataFrame:
    """A row per match of a user's pattern: the other columns, value, pos, replacement."""
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, F.explode(F.expr(custom_spans_sql(f"`{text_col}`", pattern))).alias("_m"))
    return rows.select(*keep, "_m.value", "_m.pos", F.lit(pattern.replacement).alias("replacement"))


def apply_edits_sql(t: str, edits: str) -> str:
    """Edits that keep the length, then those that change it, each from the last position to the first; for edits that overlap."""

    def script(which: str) -> str:
        own = f"filter({edits}, e -> (length(e.mask) = length(e.value)) = {which})"
        # the position in the script breaks ties as a stable sort does
        ordered = f"array_sort(transform({own}, (e, i) -> named_struct('back', -e.at, 'i', i, 'n', length(e.value), 'mask', e.mask)))"
        return ordered

    def folded(script_: str, start: str) -> str:
        return f"aggregate({script_}, {start}, (a, e) -> concat(substring(a, 1, -e.back), e.mask, substring(a, -e.back + e.n + 1)))"

    return folded(script("false"), folded(script("true"), t))


def apply_apart_sql(parts: str, total: str, ordered: str) -> str:
    """The text with edits (start, end, mask), in order and apart, in one pass."""
    before = f"if(i = 0, 0, {ordered}[greatest(i - 1, 0)].end)"
    pieces = f"transform({ordered}, (e, i) -> concat({part_sql(parts, before, f'(e.start - {before})')}, e.mask))"
    after = f"{ordered}[size({ordered}) - 1].end"
    return f"concat(array_join({pieces}, ''), {part_sql(parts, after, f'({total} - {after})')})"


def with_masked_text(df: DataFrame, text_col: str = "text", config: MaskingConfig | None = None, safe: bool = False) -> DataFrame:
    """df with masked_text, detections, masking_applied and has_overlap.

    Null texts stay null without detections. Every row is by itself.
    """
    config = config or MaskingConfig()
    if not config.enabled:
        return df.withColumns({"masked_text": F.col(text_col), "detections": F.expr(f"cast(array() as array<{_DETECTION}>)"), "masking_applied": F.lit(False), "has_overlap": F.lit(False)})
    t, scored, xml, marked, sections, changed, edits, parts, marks, ordered = unused(df, "_mt_text", "_mt_scored", "_mt_xml", "_mt_marked", "_mt_sections", "_mt_changed", "_mt_edits", "_mt_parts", "_mt_marks", "_mt_ordered")
    types = [d.type for d in reg.REGISTRY.enabled(config.effective_types())]
    out = with_candidates(df, text_col, config, scored).withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(xml, F.expr(f"{t} rlike '{XML_SNIFF}'")).withColumn(marked, F.expr(f"{t} rlike r'{JSON_SNIFF}' or {xml}"))

    inner = f"filter({spans_sql(t, CDATA, 2, f'''instr({t}, '<![CDATA[') > 0''')}, s -> not s.g2 rlike r'^\\s*\\z')"
    placed = f"transform({inner}, s -> named_struct('inner', s.g2, 'at', s.pos + instr(s.value, s.g2) - 1, 'kept', {cdata_spans_sql('s.g2', config)}))"
    out = out.withColumn(sections, F.expr(f"filter({placed}, s -> size(s.kept) > 0)"))
    out = out.withColumn(changed, F.expr(let("f", firsts_sql(f"transform({sections}, x -> x.inner)"), f"filter({sections}, (s, i) -> f[i])")))

    ranges = f"transform({changed}, s -> named_struct('start', s.at, 'end', s.at + length(s.inner)))"
    by_section = f"transform({changed}, s -> {_edit('s.inner', 's.at', _starred('s.inner', 's.kept'), 1, text('custom'), '0.95D')})"
    by_field = f"if({marked}, {_fields_sql(t, config)}, cast(array() as {_EDITS}))"
    free = f"filter({scored}, c -> c.decided and not exists({ranges}, r -> {_overlaps('c.pos', '(c.pos + length(c.value))', 'r')}))"
    masked = f"if({xml}, {mask_by_type_sql('c.value', 'c.type', 'structural', types)}, {mask_by_type_sql('c.value', 'c.type', config.strategy, types, config.strict_compat)})"
    by_pattern = f"transform({free}, c -> {_edit('c.value', 'c.pos', masked, 5, 'c.type', 'c.confidence')})"
    by_custom = [f"transform({custom_spans_sql(t, p)}, s -> {_edit('s.value', 's.pos', text(p.replacement), 6, text('custom'), '1.0D')})" for p in config.custom_patterns if p.enabled]
    out = out.withColumn(edits, F.expr(f"concat({', '.join([by_section, by_field, by_pattern, *by_custom])})"))
    if safe:
        kept = f"aggregate(array_sort(transform({edits}, e -> named_struct('at', e.at, 'back', -length(e.value), 'e', e))), named_struct('end', 0, 'kept', cast(array() as {_EDITS})), (a, x) -> if(x.at >= a.end, named_struct('end', x.at - x.back, 'kept', concat(a.kept, array(x.e))), a), a -> a.kept)"
    else:
        kept = let("f", firsts_sql(f"transform({edits}, e -> e.value)"), f"filter({edits}, (e, i) -> f[i])")
    out = out.withColumn(edits, F.expr(f"if(size({edits}) = 0, {edits}, {kept})"))
    any_edit = f"size({edits}) > 0"
    out = out.withColumns({parts: F.expr(f"if({any_edit}, {parts_sql(t)}, null)"), ordered: F.expr(f"array_sort(transform({edits}, e -> named_struct('start', e.at, 'end', e.at + length(e.value), 'mask', e.mask)))")})
    out = out.withColumns({marks: F.expr(f"if({any_edit}, {marks_sql(parts)}, null)"), "has_overlap": F.expr(f"exists(transform({ordered}, (x, i) -> i > 0 and x.start < {ordered}[greatest(i - 1, 0)].end), o -> o)")})
    line, column = (lambda pos: line_at_sql(parts, marks, pos)), (lambda pos: column_at_sql(parts, marks, pos))
    cdata = f"flatten(transform({changed}, s -> transform(s.kept, k -> named_struct('type', k.type, 'original_value', k.value, 'masked_value', repeat('*', k.end - k.start), 'line', {line('(s.at + k.start)')}, 'column', {column('(s.at + k.start)')}, 'confidence', 0.95D))))"
    others = f"transform(filter({edits}, e -> e.pass > 1), e -> named_struct('type', e.type, 'original_value', e.value, 'masked_value', e.mask, 'line', {line('e.at')}, 'column', {column('e.at')}, 'confidence', e.confidence))"
    masked_text = f"case when `{text_col}` is null or not {any_edit} then `{text_col}` when has_overlap then {apply_edits_sql(t, edits)} else {apply_apart_sql(parts, f'length({t})', ordered)} end"
    out = out.withColumns({"detections": F.expr(f"concat({cdata}, {others})"), "masked_text": F.expr(masked_text)}).withColumn("masking_applied", F.expr("size(detections) > 0"))
    first = [c for c in out.columns if c not in ("masked_text", "detections", "masking_applied", "has_overlap")]
    return out.select(*[f"`{c}`" for c in first], "masked_text", "detections", "masking_applied", "has_overlap").drop(t, scored, xml, marked, sections, changed, edits, parts, marks, ordered)


def mask_text(df: DataFrame, text_col: str = "text", config: MaskingConfig | None = None, safe: bool = False) -> DataFrame:
    """df with the text masked in place."""
    marked = with_masked_text(df, text_col, config, safe)
    return marked.withColumn(text_col, F.col("masked_text")).select(*df.columns)


def stats_line_sql(detections: str = "detections") -> str:
    """``// Data masked: 2 emails, 1 phone`` in order of first sight; empty without detections."""
    counts = counts_list_sql(detections)
    return f"if(size({detections}) = 0, '', concat('// Data masked: ', {counts}))"


def counts_list_sql(detections: str = "detections") -> str:
    seen = f"transform({detections}, d -> d.type)"
    each = f"transform(array_distinct({seen}), k -> concat(cast(size(filter({detections}, d -> d.type = k)) as string), ' ', k, if(size(filter({detections}, d -> d.type = k)) > 1, 's', '')))"
    return f"array_join({each}, ', ')"


def notification_sql(detections: str = "detections") -> str:
    """``Copied with 3 items masked: 2 emails, 1 phone``; null without detections."""
    return f"if(size({detections}) = 0, null, concat('Copied with ', cast(size({detections}) as string), ' item', if(size({detections}) > 1, 's', ''), ' masked: ', {counts_list_sql(detections)}))"


def indicator_sql(detections: str = "detections") -> str:
    return f"if(size({detections}) > 0, concat(cast(size({detections}) as string), ' masked'), 'Masking Active')"


def with_stats(df: DataFrame, output_col: str, config: MaskingConfig, into: str = "output") -> DataFrame:
    """The output with the stats line below it, if the configuration asks for it and anything was masked."""
    if not config.include_stats:
        return df.withColumn(into, F.col(output_col))
    line = stats_line_sql()
    return df.withColumn(into, F.expr(f"if(size(detections) = 0, `{output_col}`, concat(`{output_col}`, chr(10), {line}))"))
