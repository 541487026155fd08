"""Personal data in whole texts, with DataFrame and SQL functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97
for bank accounts, value and digit counts for the others), and words nearby
adjust the score. The four base kinds are kept once confirmed; the added kinds
need a score of ``THRESHOLD``. Offsets count code points, the end is exclusive.

The expressions never backtrack over a run: runs are possessive and begin only
where no earlier start could have reached the same end, which leaves the
leftmost non-overlapping matches as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import part_sql, parts_sql

WINDOW = 48
THRESHOLD = 0.6
_CHUNK = 256  # matches folded at once, so that a text of very many matches stays near linear


@dataclass(frozen=True)
class Kind:
    """maybe: a cheap test of the text t; check: of the match x; prior: score of a confirmed match."""

    name: str
    pattern: str
    maybe: str
    check: str
    prior: float
    words: str
    base: bool = True


# The length of an IBAN by country code.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """In groups of four: of a listed country exactly its length, so that a word behind isn't taken in; of others the longest run."""
    exact = []
    for n, codes in _IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        exact.append(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    listed = "|".join(_IBAN_LENGTHS.values()).replace(" ", "|")
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}+(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(exact)}|{other})(?![A-Za-z0-9])"


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IBAN = f"""aggregate(split(concat(substring(replace(x, ' ', ''), 5), substring(replace(x, ' ', ''), 1, 4)), ''), 0,
  (a, c) -> if(c = '', a, (a * if(instr('{_LETTERS}', c) > 10, 100, 10) + instr('{_LETTERS}', c) - 1) % 97)) = 1"""

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0", "true", 0.8, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"t rlike r'[0-9]\.[0-9]++\.[0-9]'", rf"x rlike r'^{_BYTE}(?:\.{_BYTE}){{3}}$'", 0.6, "ip|host|server|address|adresse|client"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"t rlike r'[0-9](?:[ -]?[0-9]){15}'", "luhn_check(regexp_replace(x, '[ -]', ''))", 0.8, "card|visa|credit|karte|carte|tarjeta|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"t rlike r'\+[0-9]'", "length(regexp_replace(x, '[^0-9]', '')) between 8 and 15", 0.6, "phone|call|tel|mobile|fax|anruf|appel"),
    Kind("iban", _iban_pattern(), r"t rlike r'[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", _IBAN, 0.7, "iban|bank|account|konto|compte|cuenta", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"t rlike r'[0-9]{3}-[0-9]{2}-[0-9]{4}'", "true", 0.45, "ssn|social|security|tax", base=False),
    Kind("secret", r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])""", r"t rlike r'[A-Za-z0-9+/_-]{24}'", "x rlike '[0-9]' and x rlike '[A-Za-z]'", 0.3, "token|secret|api.?key|password|passwd|bearer|credential", base=False),
)
_DOUBT = "example|sample|dummy|placeholder"
#: A secret's word has to stand close before it, or prose with long words would pass.
_LIFT = {"secret": 0.5}


def _found(kind: Kind, text: str) -> str:
    """SQL: array<struct<kind, start, end, score>> of the confirmed matches in the column ``text``."""
    rx = f"r'{kind.pattern}'"
    lift = _LIFT.get(kind.name, 0.15)
    near = f"lower(substring({text}, greatest(1, y.start + 1 - {WINDOW}), least({WINDOW}, y.start)))"
    after = f"lower(substring({text}, y.start + length(y.x) + 1, {WINDOW}))"
    none = "cast(array() as array<struct<x: string, start: int>>)"
    matches = f"""element_at(transform(array(named_struct(
        'm', regexp_extract_all({text}, {rx}, 0), 'g', transform(split({text}, {rx}, -1), s -> length(s)))), v ->
      if(size(v.m) = 0, {none}, aggregate(sequence(0, cast((size(v.m) - 1) div {_CHUNK} as int)), named_struct('pos', 0, 'out', {none}), (acc, c) ->
        named_struct(
          'pos', acc.pos + aggregate(slice(v.g, c * {_CHUNK} + 1, {_CHUNK}), 0, (a, b) -> a + b) + aggregate(slice(v.m, c * {_CHUNK} + 1, {_CHUNK}), 0, (a, b) -> a + length(b)),
          'out', concat(acc.out, transform(slice(v.m, c * {_CHUNK} + 1, {_CHUNK}), (x, i) -> named_struct('x', x, 'start',
            acc.pos + aggregate(slice(v.g, c * {_CHUNK} + 1, i + 1), 0, (a, b) -> a + b) + aggregate(slice(v.m, c * {_CHUNK} + 1, i), 0, (a, b) -> a + length(b)))))),
        acc -> acc.out))), 1)"""
    confirmed = f"filter({matches}, y -> element_at(transform(array(y.x), x -> {kind.check}), 1))"
    score = f"least(1D, greatest(0D, {kind.prior}D + if({near} rlike '{kind.words}', {lift}D, 0D) + if({after} rlike '{kind.words}', 0.05D, 0D) - if({near} rlike '{_DOUBT}', 0.2D, 0D)))"
    spans = f"transform({confirmed}, y -> named_struct('kind', '{kind.name}', 'start', y.start, 'end', y.start + length(y.x), 'score', {score}))"
    if not kind.base:
        spans = f"filter({spans}, z -> z.score >= {THRESHOLD}D)"
    empty = "cast(array() as array<struct<kind: string, start: int, end: int, score: double>>)"
    return f"if({kind.maybe.replace('(t,', f'({text},').replace('t rlike', f'{text} rlike')}, {spans}, {empty})"


def with_spans(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with a column array<struct<kind, start, end, score>>, by kind as listed, then start.

    Null and empty texts have no spans. Every row is handled by itself, so ids
    may be null or repeat, rows too; the other columns are not touched, whatever
    their names. Spans of one kind never overlap; spans of different kinds may,
    and where they start alike the kind listed first comes first. An empty table
    gives an empty one.
    """
    name = "_pii_text"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, F.coalesce(F.col(text_col), F.lit("")))
    marks = F.expr(f"if({name} rlike '[0-9@]', flatten(array({', '.join(_found(k, name) for k in KINDS)})), cast(array() as array<struct<kind: string, start: int, end: int, score: double>>))")
    return marked.withColumn(into, marks).drop(name)


def listed(spans: Column, base_only: bool = False) -> Column:
    """The spans as kind:start:end, joined by commas."""
    if base_only:
        names = [k.name for k in KINDS if k.base]
        spans = F.filter(spans, lambda s: s["kind"].isin(names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _pieces(spans: str) -> str:
    """SQL: of spans sorted by start, {at, out}: each run of overlapping spans as the stretch before it and its first kind.

    at is the end of the last run. Folded in chunks, so that many spans stay near linear.
    """
    kind = "array<struct<from: int, n: int, kind: string>>"
    one = "if(s.start >= a.at, named_struct('at', s.end, 'out', concat(a.out, array(named_struct('from', a.at, 'n', s.start - a.at, 'kind', s.kind)))), named_struct('at', greatest(a.at, s.end), 'out', a.out))"
    chunk = f"aggregate(slice({spans}, c * {_CHUNK} + 1, {_CHUNK}), named_struct('at', acc.at, 'out', cast(array() as {kind})), (a, s) -> {one})"
    whole = f"aggregate(array({chunk}), acc, (b, x) -> named_struct('at', x.at, 'out', concat(b.out, x.out)))"
    return f"aggregate(sequence(0, cast((size({spans}) - 1) div {_CHUNK} as int)), named_struct('at', 0, 'out', cast(array() as {kind})), (acc, c) -> {whole})"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by [KIND]; null stays null, every other column is left.

    Spans that overlap are covered together, to the end of the last, under the
    kind of the first (the earliest, then longest): no character of any span stays.
    """
    spans, parts, pieces = "_pii_spans", "_pii_parts", "_pii_pieces"
    while {spans, parts, pieces} & set(docs.columns):
        spans, parts, pieces = spans + "_", parts + "_", pieces + "_"
    marked = with_spans(docs, text_col, spans)
    by_start = f"transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'last', -s.end, 'kind', s.kind))), s -> named_struct('start', s.start, 'end', -s.last, 'kind', s.kind))"
    marked = marked.withColumn(spans, F.expr(by_start)).withColumn(parts, F.expr(f"if(size({spans}) > 0, {parts_sql(f'`{text_col}`')}, null)"))
    marked = marked.withColumn(pieces, F.expr(f"if(size({spans}) > 0, {_pieces(spans)}, null)"))
    before = f"array_join(transform({pieces}.out, p -> concat({part_sql(parts, 'p.`from`', 'p.n')}, '[', upper(p.kind), ']')), '')"
    rest = part_sql(parts, f"{pieces}.at", f"(length(`{text_col}`) - {pieces}.at)")
    return marked.withColumn(text_col, F.when(F.size(spans) > 0, F.expr(f"concat({before}, {rest})")).otherwise(F.col(text_col))).select(*[f"`{c}`" for c in docs.columns])
