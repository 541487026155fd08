"""Delimited lines as SQL expressions: delimiters, parsing, numbers, column ranges."""

from __future__ import annotations

import re

from .dialect import SPARK, Spark

# The delimiters tried, in order of preference, and their names.
DELIMITERS = (",", "\t", "|", ";", ":")
DELIMITER_NAMES = {
    ",": "CSV (Comma-Separated)", "\t": "TSV (Tab-Separated)", "|": "PSV (Pipe-Separated)", ";": "SSV (Semicolon-Separated)",
    ":": "CSV (Colon-Separated)", " ": "SSV (Space-Separated)",
}
BOOLEANS = ("true", "false", "yes", "no", "1", "0")
BOOLEANS_LONG = ("true", "false", "yes", "no", "y", "n", "1", "0")
EXTENSIONS = ("csv", "tsv", "psv", "ssv", "dsv")


def char(c: str) -> str:
    """A one-character literal for either engine."""
    return "chr(9)" if c == "\t" else f"'{c}'"


def trim(x: str, d: Spark = SPARK) -> str:
    return d.replace(x, r"^\s+|\s+$")


def occurrences(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, {char(c)}, '')))"


def is_delimited(language: str, path: str, d: Spark = SPARK) -> str:
    """By language or file extension."""
    return f"({language} in ('csv', 'tsv', 'psv') or {has_extension(path, EXTENSIONS, d)})"


def has_extension(path: str, extensions: tuple[str, ...], d: Spark = SPARK) -> str:
    return d.has(f"lower({path})", rf"\.(?:{'|'.join(extensions)})\z")


def first_line_delimiter(t: str, d: Spark = SPARK) -> str:
    """The commonest delimiter of the first line, quotes or not; comma if there is none; ties go to the earlier in the list."""
    line = f"coalesce({d.item(d.split(t, chr(10) if d.name == 'duckdb' else '\\n'), 0)}, '')"
    counts = [occurrences(line, c) for c in DELIMITERS]
    cases = []
    for i, c in enumerate(DELIMITERS):
        better = [f"{counts[i]} > {counts[j]}" if j < i else f"{counts[i]} >= {counts[j]}" for j in range(len(DELIMITERS)) if j != i]
        cases.append(f"when {counts[i]} > 0 and {' and '.join(better)} then {char(c)}")
    return f"case {' '.join(cases)} else ',' end"


def delimiter_name(x: str) -> str:
    cases = " ".join(f"when {char(c)} then '{name}'" for c, name in DELIMITER_NAMES.items())
    return f"case {x} {cases} else 'Delimited' end"


def has_header_line(t: str, d: Spark = SPARK) -> str:
    """Whether there are two lines that aren't blank."""
    return f"{d.count(f'concat(chr(10), {t})', r'\n[^\n]*[^\s][^\n]*')} >= 2"


def unquoted_count(x: str, c: str, d: Spark = SPARK) -> str:
    """Occurrences of c outside quotes, where either quote character opens and closes."""
    return occurrences(d.replace(x, """["\\x27][^"\\x27]*(?:["\\x27]|$)"""), c)


_ESCAPED = {"|": r"\|", "\t": r"\t"}


def parse(line: str, delimiter: str = ",", both_quotes: bool = False) -> str:
    """array<string> of the trimmed fields of a line (Spark).

    Double quotes (with both_quotes also single ones) may open anywhere, hold
    delimiters, and stand for themselves when doubled inside; an open one runs to
    the end of the line. Runs are possessive, so long lines don't backtrack.
    """
    c = _ESCAPED.get(delimiter, delimiter)
    double, single = r'"(?:[^"]++|"")*+(?:"|\z)', r"\x27(?:[^\x27]++|\x27\x27)*+(?:\x27|\z)"
    plain = rf'[^"\x27{c}]++' if both_quotes else rf'[^"{c}]++'
    section = "|".join([plain, double, *([single] if both_quotes else [])])
    fields = f"regexp_extract_all(concat({char(delimiter)}, {line}), r'{c}((?:{section})*+)', 1)"
    double_body = r"""replace(regexp_extract(q, r'^"((?:[^"]++|"")*+)', 1), '""', '"')"""
    single_body = r"""replace(regexp_extract(q, r'^\x27((?:[^\x27]++|\x27\x27)*+)', 1), "''", "'")"""
    singles = f" when left(q, 1) = \"'\" then {single_body}" if both_quotes else ""
    body = f"""case when left(q, 1) = '"' then {double_body}{singles} else q end"""
    return f"transform({fields}, f -> {trim(f'array_join(transform(regexp_extract_all(f, r{chr(39)}{section}{chr(39)}, 0), q -> {body}), {chr(39)}{chr(39)})')})"


def naive_fields(line: str, delimiter: str = ",") -> str:
    """Split anywhere, trim, take one quote off either end (Spark)."""
    c = _ESCAPED.get(delimiter, delimiter)
    return f"transform(split({line}, r'{c}', -1), f -> regexp_replace({trim('f')}, r'^[\"\\x27]|[\"\\x27]\\z', ''))"


_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_OTHER = r"^\s*(?:0[xX][0-9A-Fa-f]+|0[oO][0-7]+|0[bB][01]+|[+-]?Infinity)\s*$"


def is_number(x: str, d: Spark = SPARK) -> str:
    """Whether the text is a number as JavaScript reads it, blanks excluded."""
    return f"({d.has(x, _DECIMAL)} or {d.has(x, _OTHER)})"


def is_number_or_blank(x: str, d: Spark = SPARK) -> str:
    return f"({is_number(x, d)} or {d.has(x, r'^\s*$')})"


def number(x: str, d: Spark = SPARK) -> str:
    """The number as a double; null if it isn't one."""
    t = trim(x, d)
    if d.name == "duckdb":
        return f"case when {d.has(x, _DECIMAL)} then try_cast({t} as double) end"
    return (
        f"case when {d.has(x, _DECIMAL)} then try_cast({t} as double) when {d.has(x, r'^\s*0[xX]')} and {d.has(x, _OTHER)} then cast(conv(substring({t}, 3), 16, 10) as double) "
        f"when {d.has(x, r'^\s*0[oO]')} and {d.has(x, _OTHER)} then cast(conv(substring({t}, 3), 8, 10) as double) when {d.has(x, r'^\s*0[bB]')} and {d.has(x, _OTHER)} then cast(conv(substring({t}, 3), 2, 10) as double) "
        f"when {d.has(x, _OTHER)} then if(left({t}, 1) = '-', double('-Infinity'), double('Infinity')) end"
    )


def is_one_of(x: str, words: tuple[str, ...]) -> str:
    return f"lower({x}) in ({', '.join(f"'{w}'" for w in words)})"


def naive_cells(line: str, delimiter: str) -> list[str]:
    """The pieces between delimiters, trimmed, without a quote at either end."""
    return [re.sub(r"^[\"']|[\"']$", "", x.strip()) for x in line.split(delimiter)]
