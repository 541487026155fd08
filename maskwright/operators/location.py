"""Where a position lies: JSON path, XML path, enclosing code symbol, delimited columns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RenderConfig
from ..functions import delimited as dl
from ..functions.dialect import SPARK, Spark
from ..functions.safe import or_else
from ..functions.spans import spans_sql

# Fixed value: what a tag looks like.
TAG = r"</?([a-zA-Z][a-zA-Z0-9-_]*)[^>]*>"

# Languages and file extensions of each kind of document; parents that hold tags of another name.
LANGUAGES = {"json": ("json", "jsonc"), "xml": ("xml", "html", "xhtml", "htm"), "delimited": ("csv", "tsv", "psv"), "code": ("javascript", "typescript", "javascriptreact", "typescriptreact", "csharp", "python", "powershell")}
EXTENSIONS = {"json": ("json", "jsonc"), "xml": ("xml", "html", "htm", "xhtml"), "delimited": ("csv", "tsv", "psv", "ssv", "dsv"), "code": ("js", "ts", "jsx", "tsx", "cs", "py", "ps1", "psm1", "psd1")}
USUAL_PARENTS = {"FormResponse": "FormInstance", "Response": "FormInstance", "Question": "FormInstance", "Item": "Items", "Element": "Elements", "Entry": "Entries"}


def offset_sql(t: str, line: str, character: str) -> str:
    """The offset of a (line, character), both from 0; past the last line: the last line's start plus the character."""
    return f"(aggregate(slice(split({t}, '\\\\n', -1), 1, least({line}, size(split({t}, '\\\\n', -1)) - 1)), 0, (a, l) -> a + length(l) + 1) + {character})"


def document_kind_sql(language: str, path: str, d: Spark = SPARK) -> str:
    """json, xml, delimited, code or null: by language first, then by extension."""
    by_language = " ".join(f"when {language} in ({', '.join(f"'{x}'" for x in xs)}) then '{k}'" for k, xs in LANGUAGES.items())
    by_path = " ".join(f"when {dl.has_extension(path, xs, d)} then '{k}'" for k, xs in EXTENSIONS.items())
    return f"case {by_language} {by_path} end"


def is_large_sql(t: str, config: RenderConfig) -> str:
    return f"(size(split({t}, '\\\\n', -1)) > {config.large_line_threshold} or length({t}) > {config.large_char_threshold})"


def large_label_sql(language: str, path: str, d: Spark = SPARK) -> str:
    labels = (("JSON", LANGUAGES["json"], ("json", "jsonc")), ("XML", LANGUAGES["xml"], ("xml", "html")), ("CSV", ("csv",), ("csv",)), ("TSV", ("tsv",), ("tsv",)))
    first = " ".join(f"when {language} in ({', '.join(f"'{x}'" for x in xs)}) then '{k} (Large File)'" for k, xs, _ in labels)
    then = " ".join(f"when {dl.has_extension(path, xs, d)} then '{k} (Large File)'" for k, _, xs in labels)
    return f"case {first} {then} end"


# ---- JSON ----

_JSON_TOKEN = re.compile(r'\\.|"((?:\\.|[^"\\])*)(?:"|\\?\Z)|[{}\[\]:,]|[^\s]', re.DOTALL)


def json_path(text: str | None, offset: int) -> str | None:
    """The path at an offset, read up to it token by token; text need not be valid JSON."""
    if text is None:
        return None
    # each open frame: [is it an object, key or None, index]
    frames: list[list] = []
    key, key_at, value_due = "", -1, False
    for m in _JSON_TOKEN.finditer(text):
        at, token = m.start(), m.group()
        if at > offset:
            break
        top = frames[-1] if frames else None
        if token[0] == '"':
            key, key_at = re.sub(r"\\(.)", r"\1", m.group(1), flags=re.DOTALL), at
        elif token in "{[":
            frames.append([token == "{", None, 0])
            value_due = False
            if token == "{":
                key = ""
        elif token in "}]":
            if top and top[0] == (token == "}"):
                frames.pop()
            value_due = False
            if token == "}":
                key = ""
        elif token == ":":
            if key and top and top[0]:
                if at < offset:
                    top[1] = key
                value_due = True
        elif token == ",":
            value_due = False
            if top and not top[0]:
                top[2] += 1
            elif top and at < offset:
                top[1] = None
            key = ""
        elif len(token) == 1 and not value_due and key and key_at >= 0 and key_at <= offset <= at and top and top[0]:
            top[1] = key
    parts: list[str] = []
    for is_object, name, index in frames:
        if is_object and name:
            parts.append(name)
        elif not is_object and parts:
            parts[-1] += f"[{index}]"
    return ".".join(parts) or None


# ---- XML ----


class XmlText:
    """The tags of one text, for paths at any number of positions."""

    def __init__(self, text: str):
        self.text = text
        self.tags = [(m.start(), m.group(1), m.group().startswith("</"), m.group().endswith("/>")) for m in re.finditer(TAG, text)]
        self._starts: dict[str, list[int]] = {}

    def starts(self, name: str) -> list[int]:
        """Where opening tags of the name (also as the first word of a longer one) stand."""
        if name not in self._starts:
            self._starts[name] = [m.start() for m in re.finditer(rf"<\b{re.escape(name)}\b[^>]*>", self.text, re.ASCII)]
        return self._starts[name]

    def _named_container(self, name: str, at: int) -> tuple[int, int] | None:
        for start in self.starts(name):
            if start > at:
                break
            end = self.text.find(f"</{name}>", start)
            if end == -1 or end >= at:
                return start, len(self.text) if end == -1 else end
        return None

    def _parent(self, depth: int, at: int) -> tuple[int, int] | None:
        """The first element still open before ``at`` that was opened one level up."""
        level, open_ = 0, []
        for start, name, closing, alone in self.tags:
            if start >= at:
                break
            if closing:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == name:
                        del open_[i]
                        break
                level -= 1
            elif not alone:
                open_.append((name, start, level))
                level += 1
        for name, start, own in open_:
            if own == depth - 1:
                end = self.text.find(f"</{name}>", start)
                return start, len(self.text) if end == -1 else end
        return None

    def global_index(self, name: str, at: int) -> int:
        return bisect_left(self.starts(name), at)

    def local_index(self, name: str, depth: int, at: int) -> int:
        """Same-named tags before this one in its container, found by plural, by usual parent or by depth."""
        box = self._named_container(f"{name}s", at)
        if box is None and name in USUAL_PARENTS:
            box = self._named_container(USUAL_PARENTS[name], at)
        box = box or self._parent(depth, at)
        if box is None:
            return 0
        starts = self.starts(name)
        return bisect_left(starts, min(at, box[1])) - bisect_left(starts, box[0])

    def path(self, offset: int, indexing: str = "local") -> str | None:
        stack: list[tuple[str, int, int]] = []
        depth = 0
        for start, name, closing, alone in self.tags:
            if start > offset:
                break
            if closing:
                if stack and stack[-1][0] == name:
                    stack.pop()
                depth -= 1
            elif not alone:
                stack.append((name, depth, start))
                depth += 1
        # only the tags left open at the offset need their index
        indexed = [(n, self.global_index(n, at) if indexing == "global" else self.local_index(n, level, at)) for n, level, at in stack]
        shown = [f"{n}[{i}]" if len(self.starts(n)) > 1 or i > 0 else n for n, i in indexed]
        return " > ".join(shown) or None


def xml_path(text: str | None, offset: int, indexing: str = "local") -> str | None:
    return None if text is None else XmlText(text).path(offset, indexing)


def _is_json(text: str) -> bool:
    import json

    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def path_udf(kind: str, indexing: str = "local", fallback: bool = False):
    """Arrow UDF (text, offset) -> path; with fallback, a JSON text without a path at the offset gives "JSON"."""

    @F.pandas_udf("string")
    def paths(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, offset in texts:
            if kind == "xml":
                yield pd.Series([or_else(xml_path)(t, int(o), indexing) for t, o in zip(text, offset, strict=True)], dtype=object)
            else:
                found = [or_else(json_path)(t, int(o)) for t, o in zip(text, offset, strict=True)]
                yield pd.Series([p or ("JSON" if fallback and t is not None and _is_json(t) else None) for p, t in zip(found, text, strict=True)], dtype=object)

    return paths


def xml_tags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per tag: id, pos, tag, kind (open, close, single), depth, global_index, tag_count.

    depth: opening minus closing tags before it (single ones don't count);
    global_index: same-named opening tags before it. Windows run per document.
    """
    found = df.select(F.col(id_col).alias("id"), F.explode(F.expr(spans_sql(f"`{text_col}`", TAG, 1, f"instr(`{text_col}`, '<') > 0"))).alias("s"))
    kind = F.when(F.col("s.value").startswith("</"), "close").when(F.col("s.value").endswith("/>"), "single").otherwise("open")
    tags = found.select("id", F.col("s.pos").alias("pos"), F.col("s.g1").alias("tag"), kind.alias("kind"))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    earlier = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("kind") != "close", 1).otherwise(0)
    return tags.select(
        "id", "pos", "tag", "kind",
        F.coalesce(F.sum(step).over(earlier), F.lit(0)).cast("int").alias("depth"),
        F.coalesce(F.sum(opens).over(same), F.lit(0)).cast("int").alias("global_index"),
        F.sum(opens).over(Window.partitionBy("id", "tag")).cast("int").alias("tag_count"),
    )


def sibling_ordinals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The opening tags with their place and number among same-named tags of the same parent.

    The parent is the last tag opened at the depth above, which well-formed text makes exact.
    """
    tags = xml_tags(df, id_col, text_col).where(F.col("kind") != "close")
    # openers filed under their depth and tags under their parent's, so that one ordered pass finds each tag's parent
    none = F.lit(None).cast("int")
    openers = tags.where(F.col("kind") == "open").select("id", "pos", "tag", "depth", F.col("depth").alias("_level"), F.col("pos").alias("_opens"))
    children = tags.select("id", "pos", "tag", "depth", (F.col("depth") - 1).alias("_level"), none.alias("_opens"))
    before = Window.partitionBy("id", "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    joined = openers.unionAll(children).withColumn("_p", F.last("_opens", ignorenulls=True).over(before)).where(F.col("_opens").isNull())
    parent = F.coalesce("_p", F.lit(-1))
    own = Window.partitionBy("id", parent, "tag")
    return joined.select("id", "pos", "tag", "depth", parent.alias("parent_pos"), (F.row_number().over(own.orderBy("pos")) - 1).alias("local_index"), F.count("*").over(own).cast("int").alias("n_siblings"))


def tag_count(column: str, name: str) -> Column:
    """How many tags of the name a text has."""
    return F.expr(rf"regexp_count(`{column}`, r'<{re.escape(name)}(?![0-9A-Za-z_])[^>]*>')")


# ---- code ----

# What a line declares, by language: function (in order of preference), class, namespace.
_SCRIPT = {
    "function": (
        r"(?:function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)|(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:function|async\s+function|\([^)]*\)\s*=>))",
        r"^\s*(?:async\s+)?([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\([^)]*\)\s*[{:]",
    ),
    "class": r"class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
}
_CODE = {
    "javascript": _SCRIPT, "typescript": _SCRIPT, "javascriptreact": _SCRIPT, "typescriptreact": _SCRIPT,
    "csharp": {
        "function": (r"(?:public|private|protected|internal|static|virtual|override|async)?\s*(?:void|int|string|bool|double|float|decimal|object|var|Task(?:<[^>]+>)?|[A-Z][a-zA-Z0-9_]*(?:<[^>]+>)?)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",),
        "class": r"(?:public|private|protected|internal)?\s*(?:static|abstract|sealed)?\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        "namespace": r"namespace\s+([a-zA-Z_][a-zA-Z0-9_.]*)",
    },
    "python": {"function": (r"^\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",), "class": r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)"},
    "powershell": {"function": (r"^\s*function\s+([a-zA-Z][a-zA-Z0-9-_]*)\s*[{(]", r"^\s*function\s+([a-zA-Z][a-zA-Z0-9-_]*)\s*$"), "class": r"^\s*class\s+([a-zA-Z][a-zA-Z0-9_]*)"},
}


def code_context_sql(t: str, line: str, language: str) -> str:
    """SQL: ``namespace > class > function`` around a 0-based line, searched upwards; null if there is none.

    In scripts the nearest class ends the search; elsewhere a class ends it once
    a function is known (farther classes replace nearer ones until then), and a
    namespace always does.
    """
    if language not in _CODE:
        return "cast(null as string)"
    rules, script = _CODE[language], _CODE[language] is _SCRIPT
    names = []
    for k, pattern in enumerate(rules["function"]):
        groups = [f"nullif(regexp_extract(l, r'{pattern}', {g}), '')" for g in range(1, 3 if script and k == 0 else 2)]
        own = f"coalesce({', '.join(groups)})" if len(groups) > 1 else groups[0]
        # a script's class line ends the search before methods are looked for
        names.append(f"if(l rlike r'{rules['class']}', null, {own})" if script and k else own)
    found = f"coalesce({', '.join(names)})" if len(names) > 1 else names[0]
    cls = f"nullif(regexp_extract(l, r'{rules['class']}', 1), '')"
    space = f"nullif(regexp_extract(l, r'{rules['namespace']}', 1), '')" if "namespace" in rules else "cast(null as string)"
    fn = f"coalesce(s.fn, {found})"
    stops = f"{cls} is not null" if script else f"({cls} is not null and {fn} is not null) or {space} is not null"
    # a class that ends the search hides the namespace of its own line
    own_space = f"if({cls} is not null and {fn} is not null, s.ns, coalesce({space}, s.ns))" if "namespace" in rules else "s.ns"
    start = "named_struct('fn', cast(null as string), 'cls', cast(null as string), 'ns', cast(null as string), 'done', false)"
    step = f"if(s.done or l = '', s, named_struct('fn', {fn}, 'cls', coalesce({cls}, s.cls), 'ns', {own_space}, 'done', {stops}))"
    upwards = f"reverse(slice(split({t}, '\\\\n', -1), 1, {line} + 1))"
    return f"nullif(aggregate({upwards}, {start}, (s, l) -> {step}, s -> concat_ws(' > ', s.ns, s.cls, s.fn)), '')"


# ---- delimited ----


def column_range(fields: list[str], start: int, end: int, width: int = 1) -> tuple[int, int] | None:
    """The columns a selection [start, end) of a line covers; a first field it only cuts into doesn't count."""
    ends, at = [], 0
    for f in fields:
        ends.append((at, at + len(f)))
        at += len(f) + width
    first = last = -1
    for i, (a, b) in enumerate(ends):
        if first == -1 and start <= a:
            first = i
        if a < end <= b:
            last = i
        if first == -1 and i < len(ends) - 1 and b <= start < b + width:
            first = i + 1
        if first != -1 and last != -1:
            break
    first = 0 if first == -1 and last != -1 else first
    last = len(fields) - 1 if first != -1 and last == -1 else last
    return None if first == -1 or last == -1 or first > last else (first, last)


def inclusive_column_range(fields: list[str], start: int, end: int) -> tuple[int, int]:
    """The columns a selection touches."""
    first, last, at, found = 0, len(fields) - 1, 0, False
    for i, f in enumerate(fields):
        if not found and at <= start <= at + len(f):
            first, found = i, True
        if at <= end <= at + len(f):
            last = i
            break
        at += len(f) + 1
    return first, last


def inclusive_column_range_sql(fields: str, start: str, end: str) -> str:
    """SQL: struct(start_column, end_column) of the same."""
    ends = f"transform({fields}, (f_, i_) -> named_struct('a', aggregate(slice({fields}, 1, i_), 0, (x_, g_) -> x_ + length(g_) + 1), 'b', aggregate(slice({fields}, 1, i_ + 1), 0, (x_, g_) -> x_ + length(g_) + 1) - 1))"

    def hit(at: str) -> str:
        return f"array_position(transform({ends}, e_ -> {at} between e_.a and e_.b), true)"

    return f"named_struct('start_column', cast(greatest({hit(start)} - 1, 0) as int), 'end_column', cast(if({hit(end)} = 0, size({fields}), {hit(end)}) - 1 as int))"


def parse_line(line: str, delimiter: str) -> list[str]:
    """The trimmed fields of one line; double quotes hide delimiters and stand for themselves when doubled."""
    d = re.escape(delimiter)
    fields = re.findall(rf'{d}((?:[^"{d}]|"(?:[^"]|"")*(?:"|\Z))*)', delimiter + line)
    return [re.sub(r'"((?:[^"]|"")*)(?:"|\Z)', lambda m: m.group(1).replace('""', '"'), f).strip() for f in fields]


def _clean(name: str) -> str:
    return re.sub(r"^[\"']|[\"']$", "", name.strip())


def delimited_context(text: str, start: tuple[int, int], end: tuple[int, int]) -> str | None:
    """``CSV (Comma-Separated) > a, b``: the columns a selection (line, character) to (line, character) covers."""
    lines = text.split("\n")
    counts = [lines[0].count(c) for c in dl.DELIMITERS]
    delimiter = dl.DELIMITERS[counts.index(max(counts))] if max(counts) else ","
    name = dl.DELIMITER_NAMES.get(delimiter, "Delimited")
    if not lines[0]:
        return name
    headers = parse_line(lines[0], delimiter)
    has_headers = sum(bool(x.strip()) for x in lines) >= 2
    selected = [x[(start[1] if i == start[0] else 0) : (end[1] if i == end[0] else len(x))] for i, x in enumerate(lines) if start[0] <= i <= end[0]]
    ranges = []
    for k, part in enumerate(selected):
        line = lines[start[0] + k]
        if line and part:
            at = start[1] if k == 0 else max(0, line.find(part))
            found = column_range(parse_line(line, delimiter), at, at + len(part), len(delimiter))
            ranges += [found] if found else []
    if not ranges:
        return name
    first, last = min(r[0] for r in ranges), max(r[1] for r in ranges)
    names = [_clean(headers[i]) if has_headers and i < len(headers) else f"Column {i + 1}" for i in range(first, last + 1)]
    return f"{name} > {', '.join(names)}"


def aligned_lines(full: list[str], selected: list[str], start_line: int, first_char: int, delimiter: str) -> tuple[list[str], int, list[int]]:
    """(lines trimmed back to the leftmost column any of them starts at, that column, the column that each line returned really begins in).

    full: the whole lines; selected: what is selected of each; start_line counts
    from 1, where nothing is trimmed. A line that starts with a part of a field
    counts as starting at the next column.
    """
    if start_line <= 1 or not selected:
        return selected, 0, [0] * len(selected)
    begins, starts = [], []
    for i, (line, part) in enumerate(zip(full, selected, strict=True)):
        at = first_char if i == 0 else max(0, line.find(part))
        begins.append(line[:at].count(delimiter))
        starts.append(begins[-1] + (part[:1] not in (delimiter, '"', "'")))
    least = min(starts)
    out = []
    for k, (line, part) in enumerate(zip(full, selected, strict=True)):
        pieces = line.split(delimiter)
        if starts[k] > least and len(pieces) > least:
            out.append(delimiter.join(pieces[least:]))
            begins[k] = least
        else:
            out.append(part)
    return out, least, begins


def delimited_context_udf():
    """Arrow UDF (text, start_line, start_char, end_line, end_char) -> context."""

    @F.pandas_udf("string")
    def contexts(text: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else or_else(delimited_context)(t, (int(p), int(q)), (int(r), int(s))) for t, p, q, r, s in zip(text, a, b, c, d, strict=True)], dtype=object)

    return contexts


def aligned_lines_udf():
    """Arrow UDF (full lines, selected lines, start line, first character, delimiter) -> struct(lines, first_column, columns) as aligned_lines gives them."""

    @F.pandas_udf("lines array<string>, first_column int, columns array<int>")
    def aligned(full: pd.Series, selected: pd.Series, start_line: pd.Series, first_char: pd.Series, delimiter: pd.Series) -> pd.DataFrame:
        rows = zip(full, selected, start_line, first_char, delimiter, strict=True)
        found = [(None, 0, None) if s is None else aligned_lines(list(f), list(s), int(a), int(b), d) for f, s, a, b, d in rows]
        return pd.DataFrame({"lines": pd.Series([x[0] for x in found], dtype=object), "first_column": [x[1] for x in found], "columns": pd.Series([x[2] for x in found], dtype=object)})

    return aligned


def with_context(df: DataFrame, config: RenderConfig | None = None, into: str = "context") -> DataFrame:
    """df(language, path, text, line, character) with the context at the position.

    Large documents only get a label. JSON and XML rows go through the Arrow
    scanners; the others stay with column expressions, in one plan without a union of scans.
    """
    config = config or RenderConfig()
    t = "coalesce(text, '')"
    kind, large = document_kind_sql("language", "path"), is_large_sql(t, config)
    code = " ".join(f"when language = '{x}' then {code_context_sql(t, 'line', x)}" for x in LANGUAGES["code"])
    # the scanners see only the texts they are for: an Arrow UDF may be run on rows that the branch around it discards
    at = F.expr(offset_sql(t, "line", "character"))

    def own(name: str) -> Column:
        return F.expr(f"if({kind} = '{name}' and not {large}, text, null)")

    return df.withColumn("_json", path_udf("json", fallback=True)(own("json"), at)).withColumn("_xml", path_udf("xml", config.xml_indexing)(own("xml"), at)).withColumn(
        into, F.expr(f"case when {large} then {large_label_sql('language', 'path')} when {kind} = 'json' then _json when {kind} = 'xml' then _xml when {kind} = 'code' then case {code} end end")
    ).drop("_json", "_xml")
