"""Small column builders shared by the function modules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0b"
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}])")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """A SQL raw literal for a regular expression."""
    return f'r"{pattern}"' if "'" in pattern else f"r'{pattern}'"


def sql_array(words: Iterable[str]) -> str:
    return "array(" + ",".join(quoted(w) for w in words) + ")"


def words_literal(words: Iterable[str]) -> Column:
    words = list(words)
    return F.expr(sql_array(words)) if words else F.expr("cast(array() as array<string>)")


def rx(name: str, pattern: str) -> str:
    """SQL: the column matches the pattern somewhere."""
    return f"({name} rlike {raw(pattern)})"


def literal_pattern(words: Iterable[str]) -> str:
    return "|".join(_SPECIAL.sub(r"\\\1", w) for w in words)


def has(name: str, *words: str) -> str:
    """SQL: the column contains any of the words."""
    if len(words) == 1:
        return f"contains({name}, {quoted(words[0])})"
    return rx(name, literal_pattern(words))


def count_of(name: str, pattern: str) -> str:
    """SQL: number of matches of a pattern."""
    return f"size(regexp_extract_all({name}, {raw(pattern)}, 0))"


def count_text(name: str, text: str) -> str:
    """SQL: number of occurrences of a short text."""
    return f"((length({name}) - length(replace({name}, {quoted(text)}, ''))) div {len(text)})"


def labels(pairs: Iterable[tuple[str, str]]) -> str:
    """SQL: sorted distinct array of the labels whose condition holds; pairs are (label, condition)."""
    items = ",".join(f"if({cond}, {quoted(label)}, null)" for label, cond in pairs)
    return f"array_sort(array_distinct(array_compact(array({items}))))"


def first_match(rules: Iterable[tuple[str, str]], default: str) -> str:
    """SQL: label of the first rule that holds."""
    body = " ".join(f"when {cond} then {quoted(label)}" for label, cond in rules)
    return f"case {body} else {quoted(default)} end"


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Value of a fixed table, null when the key is unknown."""
    flat = ",".join(f"{quoted(k)},{quoted(v)}" for k, v in table.items())
    return F.element_at(F.expr(f"map({flat})"), value)


def alias(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(lookup(value, table), value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE))


def lower_strip(value: Column) -> Column:
    return F.lower(strip(value))


def non_empty(value: Column) -> Column:
    """Empty text becomes null."""
    return F.nullif(value, F.lit(""))


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of the value taken to ten decimals.

    Going through DECIMAL keeps the last bits of a floating sum, which depend
    on the order of the partitions, from flipping a digit.
    """
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def exact_sum(value: Column) -> Column:
    """Order-independent sum of a score: DECIMAL inside, DOUBLE outside."""
    return F.sum(value.cast("decimal(18,10)")).cast("double")


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))
