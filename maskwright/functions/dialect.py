"""Builders of SQL text for Spark and for DuckDB, where their spellings differ."""

from __future__ import annotations


class Spark:
    """Spark SQL; array positions count from 0."""

    name = "spark"

    @staticmethod
    def regex(pattern: str) -> str:
        return f"r'{pattern}'"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.regex(pattern)}, '{by}')"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.regex(pattern)})"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        """The first match or the empty string."""
        return f"regexp_extract({x}, {self.regex(pattern)}, {group})"

    def count(self, x: str, pattern: str) -> str:
        return f"size(regexp_extract_all({x}, {self.regex(pattern)}, 0))"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.regex(pattern)}, -1)"

    @staticmethod
    def item(array: str, i: str | int) -> str:
        return f"try_element_at({array}, cast({i} as int) + 1)"

    @staticmethod
    def size(array: str) -> str:
        return f"size({array})"

    @staticmethod
    def array(*items) -> str:
        return f"array({', '.join(map(str, items))})"

    @staticmethod
    def total(n: str, body: str) -> str:
        """The sum of body for i_ from 1 to n (n at least 1)."""
        return f"aggregate(sequence(1, {n}), 0, (sum_, i_) -> sum_ + ({body}))"

    @staticmethod
    def fold(array: str, body: str) -> str:
        """Of an array of ints from 0: body over a_ (so far) and c_ (item)."""
        return f"aggregate({array}, 0, (a_, c_) -> cast({body} as int))"

    @staticmethod
    def each(array: str, body: str) -> str:
        return f"transform({array}, c_ -> {body})"

    @staticmethod
    def all(array: str, body: str) -> str:
        return f"forall({array}, c_ -> {body})"

    @staticmethod
    def chars(x: str) -> str:
        return f"filter(split({x}, ''), c_ -> c_ <> '')"

    @staticmethod
    def position(part: str, x: str) -> str:
        return f"instr({x}, {part})"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def short_hash(x: str) -> str:
        return f"substring(translate(base64(unhex(sha2({x}, 256))), '+/', '-_'), 1, 8)"

    @staticmethod
    def bind(name: str, value: str, body: str) -> str:
        """body with name bound to value, which is evaluated once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def luhn(self, digits: str) -> str:
        return f"luhn_check({digits})"

    @staticmethod
    def record(**fields: str) -> str:
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"

    @staticmethod
    def day(year: str, month: str, day: str) -> str:
        """A date whose month and day may run over into later ones."""
        return f"date_add(add_months(make_date({year}, 1, 1), {month} - 1), {day} - 1)"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def regex(pattern: str) -> str:
        return f"'{pattern}'"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, '{pattern}'))"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, '{pattern}')"

    @staticmethod
    def item(array: str, i: str | int) -> str:
        return f"({array})[({i}) + 1]"

    @staticmethod
    def size(array: str) -> str:
        return f"len({array})"

    @staticmethod
    def array(*items) -> str:
        return f"[{', '.join(map(str, items))}]"

    @staticmethod
    def total(n: str, body: str) -> str:
        return f"list_sum(list_transform(range(1, ({n}) + 1), lambda i_: {body}))"

    @staticmethod
    def fold(array: str, body: str) -> str:
        return f"list_reduce(list_prepend(0, {array}), lambda a_, c_: {body})"

    @staticmethod
    def each(array: str, body: str) -> str:
        return f"list_transform({array}, lambda c_: {body})"

    @staticmethod
    def all(array: str, body: str) -> str:
        return f"len(list_filter({array}, lambda c_: NOT ({body}))) = 0"

    @staticmethod
    def chars(x: str) -> str:
        return f"string_split({x}, '')"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def short_hash(x: str) -> str:
        return f"substring(translate(to_base64(unhex(sha256({x}))), '+/', '-_'), 1, 8)"

    @staticmethod
    def bind(name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def luhn(self, digits: str) -> str:
        digit = f"cast(substring({digits}, cast(length({digits}) - i_ + 1 as int), 1) as int)"
        return f"{self.total(f'length({digits})', f'case when i_ % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end')} % 10 = 0"

    @staticmethod
    def record(**fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    @staticmethod
    def day(year: str, month: str, day: str) -> str:
        return f"cast(make_date({year}, 1, 1) + to_months(cast({month} - 1 as int)) + to_days(cast({day} - 1 as int)) as date)"


SPARK, DUCK = Spark(), Duck()


def text(value: str) -> str:
    """A string literal for either engine."""
    return "'" + value.replace("'", "''") + "'"
