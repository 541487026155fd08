"""Detection of sensitive values in text: candidates, gates, confidence, adaptive threshold, claims.

All of it is one projection per row: the text is scanned in place, never
shuffled, and the claims of a text are settled within its own array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MaskingConfig
from ..functions import registry as reg
from ..functions import validators
from ..functions.dialect import SPARK, Spark, text
from ..functions.masks import mask_sql
from ..functions.spans import column_at_sql, firsts_sql, let, line_at_sql, marks_sql, part_sql, parts_sql, spans_of_all_sql, spans_sql

STRUCTURES = ("xml", "json", "csv", "plain_text")


def threshold_of(base: float, structure: str, type_: str, mode: str) -> float:
    """The confidence a value needs, by structure around it, risk of its type, and mode."""
    moves = ((-0.1, structure in ("xml", "json")), (0.15, structure == "plain_text"), (0.1, type_ in reg.HIGH_RISK), (0.1, mode == "strict"), (0.2, mode == "manual"))
    for move, applies in moves:
        if applies:
            base += move
    return max(0.5, min(0.95, base))


def anomaly_sql(value: str, type_: str) -> str:
    """1 for a plausible value, less for repeated, sequential, placeholder or uniform ones."""
    digits, word = f"regexp_replace({value}, r'\\D', '')", f"regexp_replace({value}, r'\\W', '')"
    sequences = "0123|1234|2345|3456|4567|5678|6789|7890|9876|8765|7654|6543|5432|4321|3210"
    free = ", ".join(text(t) for t in reg.SEQUENCES_ALLOWED)
    return (
        f"case when {value} rlike r'(\\d)\\1{{4,}}' then 0.2D when {type_} not in ({free}) and {digits} rlike '{sequences}' then 0.3D "
        f"when {value} rlike '(?i)^(?:XXXX|0000|N/A|TBD|TODO|test|example|dummy|placeholder|sample)' then 0.1D "
        f"when length({word}) > 2 and replace({word}, left({word}, 1), '') = '' then 0.15D else 1.0D end"
    )


def structure_sql(before: str, after: str, plain: str = "plain_text") -> str:
    """What the value stands in: xml, json, csv or plain_text."""
    return (
        rf"case when {before} rlike r'<[^>]+>\s*\z' and {after} rlike r'^\s*</' then 'xml' "
        rf"""when {before} rlike r'[{{,]\s*"[^"]+"\s*:\s*"?\s*\z' then 'json' """
        rf"when {before} rlike r',\s*\z' or {after} rlike r'^\s*,' then 'csv' else '{plain}' end"
    )


def inside_name_sql(before: str, after: str) -> str:
    """Whether the value is part of a tag or of a JSON key."""
    return rf"""(({before} rlike r'<[^>]*\z' and instr({after}, '>') > 0) or (instr({before}, '"') > 0 and {after} rlike r'^\s*"?\s*:'))"""


def _any_word(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"instr({x}, {text(w)}) > 0" for w in words) + ")"


def confidence_sql(prior: str, anomaly: str, context: str) -> str:
    score = f"{prior} * {anomaly} + if({_any_word(context, reg.POSITIVE_WORDS)}, 0.1D, 0D) - if({_any_word(context, reg.NEGATIVE_WORDS)}, 0.3D, 0D) + if({_any_word(context, reg.FIELD_WORDS)}, 0.2D, 0D)"
    return f"if({anomaly} < 0.5D, {anomaly} * 0.5D, greatest(0D, least(1D, {score})))"


def business_date_sql(before: str) -> str:
    """Whether words before a date say that it isn't one of birth (not part of detection)."""
    return _any_word(f"lower({before})", reg.BUSINESS_DATE_WORDS)


def _before(parts: str, pos: str, n: int) -> str:
    return part_sql(parts, f"greatest({pos} - {n}, 0)", f"least({pos}, {n})")


def _after(parts: str, end: str, n: int, total: str) -> str:
    return part_sql(parts, f"({end})", f"least({n}, {total} - {end})")


def business_dates(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per date in the whole text: the kept columns, value, pos, and whether business words stand in the 100 characters before it."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    d, t = reg.REGISTRY.get("dateOfBirth"), f"`{text_col}`"
    spans = spans_sql(t, d.java, maybe=d.hint(t, f"lower({t})"))
    rows = let("w", f"named_struct('found', {spans}, 'parts', {parts_sql(t)})", f"transform(w.found, s -> named_struct('value', s.value, 'pos', s.pos, 'business', {let('b', _before('w.parts', 's.pos', 100), business_date_sql('b'))}))")
    rows = f"if({d.hint(t, f'lower({t})') or 'true'}, {rows}, null)"
    return df.select(*keep, F.explode(F.expr(rows)).alias("_row")).select(*keep, "_row.*")


def candidates_sql(t: str, detectors: list[reg.Detector], low: str | None = None, digit: str | None = None) -> str:
    """array<struct<type, prior, value, pos>> of all matches, in claim order; low, digit: see Detector.hint."""
    none = "cast(array() as array<struct<type: string, prior: double, value: string, pos: int>>)"
    if not detectors:
        return none
    patterns = [(d.java, d.hint(t, low, digit), f"named_struct('type', '{d.type}', 'prior', {d.prior!r}D)") for d in detectors]
    return f"transform({spans_of_all_sql(t, patterns)}, s -> named_struct('type', s.kind.type, 'prior', s.kind.prior, 'value', s.value, 'pos', s.pos))"


def _scored_sql(parts: str, total: str, candidates: str, config: MaskingConfig) -> str:
    """The candidates with every gate and score; the text comes in parts, with its length."""
    end = "(c.pos + length(c.value))"
    start = "greatest(c.pos - 100, 0)"
    windows = f"""transform({candidates}, c -> named_struct('type', c.type, 'prior', c.prior, 'value', c.value, 'pos', c.pos,
      'inside_name', {let('w', f"named_struct('b', {_before(parts, 'c.pos', 300)}, 'a', {_after(parts, end, 50, total)})", inside_name_sql('w.b', 'w.a'))},
      'birth', c.type <> 'dateOfBirth' or ({let('w', f"lower({_before(parts, 'c.pos', 100)})", _any_word('w', reg.BIRTH_WORDS))} and {validators.plausible_birth_date('c.value', config.today())}),
      'anomaly', {anomaly_sql('c.value', 'c.type')},
      'structure', {let('w', f"named_struct('b', {_before(parts, 'c.pos', 100)}, 'a', {_after(parts, end, 100, total)})", structure_sql('w.b', 'w.a', 'xml' if config.inside_cdata else 'plain_text'))},
      'context', lower({part_sql(parts, start, f'least(least(c.pos, 100) + length(c.value) + 100, {total} - {start})')})))"""
    risky = f"c.type in ({', '.join(text(x) for x in reg.HIGH_RISK)})"
    needs = " ".join(
        f"when c.structure = '{s}' then if({risky}, {threshold_of(config.confidence_threshold, s, reg.HIGH_RISK[0], config.mode)!r}D, {threshold_of(config.confidence_threshold, s, '', config.mode)!r}D)" for s in STRUCTURES
    )
    scores = f"""transform({windows}, c -> named_struct('type', c.type, 'value', c.value, 'pos', c.pos, 'inside_name', c.inside_name, 'birth', c.birth, 'anomaly', c.anomaly, 'structure', c.structure,
      'confidence', {confidence_sql('c.prior', 'c.anomaly', 'c.context')}, 'threshold', case {needs} end))"""
    return f"""transform({scores}, c -> named_struct('type', c.type, 'value', c.value, 'pos', c.pos, 'inside_name', c.inside_name, 'birth', c.birth, 'anomaly', c.anomaly, 'structure', c.structure,
      'confidence', c.confidence, 'threshold', c.threshold, 'decided', not c.inside_name and c.birth and c.confidence >= c.threshold))"""


def mask_by_type_sql(value: str, type_: str, strategy: str, types: list[str], strict_compat: bool = False, dialect: Spark = SPARK) -> str:
    """The mask that the type of each row calls for; types: those that may occur."""
    by_mask: dict[str, list[str]] = {}
    for x in types:
        by_mask.setdefault(reg.MASKS.get(x, "generic"), []).append(x)
    by_mask.pop("generic", None)
    cases = "".join(f" when {type_} in ({', '.join(text(x) for x in xs)}) then {mask_sql(m, value, strategy, dialect, strict_compat)}" for m, xs in by_mask.items())
    generic = mask_sql("generic", value, strategy, dialect)
    return f"case{cases} else {generic} end" if cases else generic


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def held(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns passed through a generator of one row.

    Projections aren't merged across it, so a column that later steps use often
    is computed once, also where Python functions stand above.
    """
    (own,) = unused(df, "_held")
    rest = [f"`{c}`" for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias(own)).select(*rest, *(F.col(f"{own}.{n}").alias(n) for n in names))


def with_candidates(df: DataFrame, text_col: str, config: MaskingConfig, into: str, parts: str | None = None) -> DataFrame:
    """df with an array of the scored candidates; null texts have none.

    parts: a column that gets the text in parts, for offsets; empty where there are no candidates.
    """
    t, low, digit = unused(df, "_detect_text", "_detect_lower", "_detect_digit")
    found = candidates_sql(t, reg.REGISTRY.enabled(config.effective_types()), low, digit)
    c, own, total = unused(df, "_detect_candidates", "_detect_parts", "_detect_total")
    own = parts or own
    out = (
        df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
        .withColumns({low: F.lower(t), digit: F.col(t).rlike("[0-9]")})
        .withColumn(c, F.expr(found))
        .withColumns({own: F.expr(f"if(size({c}) > 0, {parts_sql(t)}, cast(array() as array<string>))"), total: F.length(t)})
        .withColumn(into, F.expr(_scored_sql(own, total, c, config)))
    )
    return out.drop(t, low, digit, c, total, *([] if parts else [own]))


def candidates(df: DataFrame, text_col: str = "text", config: MaskingConfig | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row per candidate: the kept columns, type, value, pos, gates and scores, whether decided, whether first to claim its value."""
    config = config or MaskingConfig()
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    array, firsts = unused(df, "_scored", "_firsts")
    scored = with_candidates(df, text_col, config, array)
    scored = scored.withColumn(firsts, F.expr(firsts_sql(f"transform({array}, c -> if(c.decided, c.value, null))")))
    numbered = F.expr(f"transform({array}, (c, i) -> named_struct('c', c, 'first', {firsts}[i]))")
    rows = scored.select(*keep, F.explode(numbered).alias("_row"))
    return rows.select(*keep, "_row.c.*", F.col("_row.first").alias("first"))


def detect(df: DataFrame, text_col: str = "text", config: MaskingConfig | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row per detected value (its first occurrence in the text): type, value, mask, line, column, confidence."""
    config = config or MaskingConfig()
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    if not config.enabled:
        return df.select(*keep, *(F.lit(None).cast(k).alias(n) for n, k in (("type", "string"), ("original_value", "string"), ("masked_value", "string"), ("pos", "int"), ("line", "int"), ("column", "int"), ("confidence", "double")))).limit(0)
    types = [d.type for d in reg.REGISTRY.enabled(config.effective_types())]
    array, parts, marks, claimed, xml = unused(df, "_scored", "_parts", "_marks", "_claimed", "_is_xml")
    scored = with_candidates(df, text_col, config, array, parts)
    decided = f"filter({array}, c -> c.decided)"
    first = let("d", decided, let("f", firsts_sql("transform(d, c -> c.value)"), "filter(d, (c, i) -> f[i])"))
    scored = scored.withColumn(claimed, F.expr(f"if(exists({array}, c -> c.decided), {first}, slice({array}, 1, 0))"))
    scored = scored.withColumns({xml: F.expr(f"size({claimed}) > 0 and `{text_col}` rlike '<[^>]+>'"), marks: F.expr(f"if(size({claimed}) > 0, {marks_sql(parts)}, null)")})
    masked = f"if({xml}, {mask_by_type_sql('c.value', 'c.type', 'structural', types)}, {mask_by_type_sql('c.value', 'c.type', config.strategy, types, config.strict_compat)})"
    rows = f"""transform({claimed}, c -> named_struct('type', c.type, 'original_value', c.value, 'masked_value', {masked}, 'pos', c.pos,
      'line', {line_at_sql(parts, marks, 'c.pos')}, 'column', {column_at_sql(parts, marks, 'c.pos')}, 'confidence', c.confidence))"""
    return scored.select(*keep, F.explode(F.expr(rows)).alias("_row")).select(*keep, "_row.*")


def counts_by_type(detections: DataFrame, *by: str) -> DataFrame:
    """Detections per type (and per further columns)."""
    return detections.groupBy(*by, "type").agg(F.count("*").alias("n"))
