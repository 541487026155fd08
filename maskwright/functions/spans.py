"""All matches of a regular expression with their offsets, as a SQL expression.

Spark gives matches (regexp_extract_all) and what lies between them (split);
running sums of both lengths give the offsets. The sums are folded in chunks,
so that a text with very many matches stays near linear.
"""

from __future__ import annotations

from .dialect import SPARK

_CHUNK = 256


def _placed_sql(m: str, gaps: str, kind: str, own: str) -> str:
    """The matches m of a text with their offsets, given the lengths of what lies between them; own: their other fields."""
    part, lengths = f"slice({gaps}, c * {_CHUNK} + 1, {{n}})", f"slice({m}, c * {_CHUNK} + 1, {{n}})"

    def total(n: str) -> str:
        return f"aggregate({part.format(n=n[0])}, 0, (a, b) -> a + b) + aggregate({lengths.format(n=n[1])}, 0, (a, b) -> a + length(b))"

    return f"""aggregate(sequence(0, cast((size({m}) - 1) div {_CHUNK} as int)), named_struct('pos', 0, 'out', cast(array() as {kind})), (acc, c) -> named_struct(
        'pos', acc.pos + {total((str(_CHUNK), str(_CHUNK)))},
        'out', concat(acc.out, transform({lengths.format(n=_CHUNK)}, (x, i) -> named_struct('value', x, 'pos', acc.pos + {total(('i + 1', 'i'))}{own})))), acc -> acc.out)"""


def spans_sql(t: str, regex: str, groups: int = 0, maybe: str | None = None) -> str:
    """array<struct<value, pos, g1, ...>> of the matches in the string t; pos counts code points from 0.

    maybe: a cheap condition every text with a match fulfils.
    """
    rx = SPARK.regex(regex)
    kind = f"array<struct<value: string, pos: int{''.join(f', g{i}: string' for i in range(1, groups + 1))}>>"
    none = f"cast(array() as {kind})"
    caught = "".join(f", 'g{i}', regexp_extract_all({t}, {rx}, {i})" for i in range(1, groups + 1))
    own = "".join(f", 'g{i}', v.g{i}[c * {_CHUNK} + i]" for i in range(1, groups + 1))
    measured = f"named_struct('m', m, 'gaps', transform(split({t}, {rx}, -1), s -> length(s)){caught})"
    # the text is scanned a second time only where there are matches
    found = let("m", f"regexp_extract_all({t}, {rx}, 0)", f"if(size(m) = 0, {none}, {let('v', measured, _placed_sql('v.m', 'v.gaps', kind, own))})")
    return found if not maybe else f"if({maybe}, {found}, {none})"


def spans_of_all_sql(t: str, patterns: list[tuple[str, str | None, str]]) -> str:
    """array<struct<value, pos, kind>> of the matches of all patterns (regex, maybe, SQL of kind), pattern after pattern.

    The offsets are worked out by one expression for all, which keeps the plan small.
    """
    each = []
    for regex, maybe, kind in patterns:
        rx = SPARK.regex(regex)
        matches = f"regexp_extract_all({t}, {rx}, 0)"
        found = f"if({maybe}, {matches}, cast(array() as array<string>))" if maybe else matches
        each.append(let("m", found, f"named_struct('kind', {kind}, 'm', m, 'gaps', if(size(m) = 0, cast(array() as array<int>), transform(split({t}, {rx}, -1), s -> length(s))))"))
    hits = f"filter(array({', '.join(each)}), v -> size(v.m) > 0)"
    kinds = f"flatten(transform(h, v -> transform({_placed_sql('v.m', 'v.gaps', 'array<struct<value: string, pos: int>>', '')}, s -> named_struct('value', s.value, 'pos', s.pos, 'kind', v.kind))))"
    return let("h", hits, kinds)


_PART = 1024


def parts_sql(t: str) -> str:
    """The string in parts of _PART code points, so that a piece far into a long text is found at once."""
    return f"regexp_extract_all({t}, r'(?s).{{1,{_PART}}}', 0)"


def part_sql(parts: str, pos: str, n: str) -> str:
    """n code points of a text in parts, from the offset pos on; they have to be there."""
    first, last = f"cast({pos} div {_PART} as int)", f"cast(({pos} + {n} - 1) div {_PART} as int)"
    one = f"substring({parts}[{first}], {pos} % {_PART} + 1, {n})"
    more = f"concat(substring({parts}[{first}], {pos} % {_PART} + 1), array_join(slice({parts}, {first} + 2, {last} - {first} - 1), ''), substring({parts}[{last}], 1, ({pos} + {n} - 1) % {_PART} + 1))"
    return f"(case when {n} <= 0 then '' when {first} = {last} then {one} else {more} end)"


def marks_sql(parts: str) -> str:
    """array<struct<lines, last>>: the line feeds before each part, and the offset of the last of them (-1 without)."""
    kind = "array<struct<lines: int, last: int>>"
    feeds, back = "(length(p) - length(replace(p, chr(10), '')))", "instr(reverse(p), chr(10))"
    step = f"named_struct('i', a.i + 1, 'lines', a.lines + {feeds}, 'last', if({back} = 0, a.last, a.i * {_PART} + length(p) - {back}), 'out', concat(a.out, array(named_struct('lines', a.lines, 'last', a.last))))"
    chunk = f"aggregate(slice({parts}, c * {_CHUNK} + 1, {_CHUNK}), named_struct('i', acc.i, 'lines', acc.lines, 'last', acc.last, 'out', cast(array() as {kind})), (a, p) -> {step})"
    whole = f"aggregate(array({chunk}), acc, (b, x) -> named_struct('i', x.i, 'lines', x.lines, 'last', x.last, 'out', concat(b.out, x.out)))"
    start = f"named_struct('i', 0, 'lines', 0, 'last', -1, 'out', cast(array() as {kind}))"
    return f"aggregate(sequence(0, cast((size({parts}) - 1) div {_CHUNK} as int)), {start}, (acc, c) -> {whole}, acc -> acc.out)"


def line_at_sql(parts: str, marks: str, pos: str) -> str:
    """The 1-based line of an offset into a text in parts."""
    before = f"substring({parts}[cast({pos} div {_PART} as int)], 1, {pos} % {_PART})"
    return f"({marks}[cast({pos} div {_PART} as int)].lines + length({before}) - length(replace({before}, chr(10), '')) + 1)"


def column_at_sql(parts: str, marks: str, pos: str) -> str:
    """The 0-based column of an offset into a text in parts."""
    back = f"instr(reverse(substring({parts}[cast({pos} div {_PART} as int)], 1, {pos} % {_PART})), chr(10))"
    return f"(case when {back} = 0 then {pos} - {marks}[cast({pos} div {_PART} as int)].last - 1 else {back} - 1 end)"


def firsts_sql(values: str) -> str:
    """array<boolean>, along the array of values: whether each is the first of its kind; nulls never are."""
    ordered = f"array_sort(transform({values}, (v, i) -> named_struct('v', v, 'i', i)))"
    flags = "transform(s, (x, k) -> named_struct('i', x.i, 'first', x.v is not null and (k = 0 or not (s[greatest(k - 1, 0)].v <=> x.v))))"
    return let("s", ordered, f"transform(array_sort({flags}), x -> x.first)")


def line_sql(t: str, pos: str) -> str:
    """The 1-based line of an offset."""
    before = f"substring({t}, 1, {pos})"
    return f"(length({before}) - length(replace({before}, chr(10), '')) + 1)"


def column_sql(t: str, pos: str) -> str:
    """The 0-based column of an offset in its line."""
    last = f"instr(reverse(substring({t}, 1, {pos})), chr(10))"
    return f"(case when {last} = 0 then {pos} else {last} - 1 end)"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
