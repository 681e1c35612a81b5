"""Small helpers shared by the expression builders."""

from __future__ import annotations

# Numbers as Python's float() reads them: underscores between digits, padding,
# inf and nan are fine; a trailing type letter is not.
_FLOAT_TEXT = (
    r"(?iU)^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$"
    r"|^\s*[+-]?(inf|infinity|nan)\s*$"
)


def lit(text: str) -> str:
    """A string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def empty(element: str) -> str:
    return f"CAST(array() AS array<{element}>)"


def struct(**members: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in members.items()) + ")"


def lookup(table: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def reads_as_float(text: str) -> str:
    return f"({text} RLIKE {lit(_FLOAT_TEXT)})"


def float_of_text(text: str) -> str:
    """Python's ``float(text)``, NULL where that raises."""
    noise = lit(r"(?U)^\s+|\s+$|_")
    return (
        f"CASE WHEN {reads_as_float(text)} "
        f"THEN try_cast(regexp_replace({text}, {noise}, '') AS DOUBLE) END"
    )


def fixed_point(value: str, digits: int) -> str:
    """``f"{value:.2f}"``: rounds the exact binary value, ties to even."""
    return f"format_number({value}, '0.{'0' * digits}')"


def float_text(value: str) -> str:
    """Text Python prints for a float (``100.0``, ``12345678.9``, ``1e-05``)."""
    power = "try_cast(substring_index(s, 'E', -1) AS INT)"
    scientific = (
        rf"concat(regexp_replace(substring_index(s, 'E', 1), '\\.0$', ''), "
        f"CASE WHEN {power} < 0 THEN 'e-' ELSE 'e+' END, "
        f"CASE WHEN abs({power}) < 10 THEN '0' ELSE '' END, CAST(abs({power}) AS STRING))"
    )
    digits = "regexp_replace(CAST(try_cast(x AS DECIMAL(38,20)) AS STRING), '0+$', '')"
    plain = rf"regexp_replace({digits}, '\\.$', '.0')"
    body = (
        "CASE WHEN isnan(x) THEN 'nan' "
        "WHEN abs(x) = double('inf') THEN CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END "
        "WHEN x = 0 OR (abs(x) >= 1e-3 AND abs(x) < 1e7) THEN CAST(x AS STRING) "
        f"WHEN abs(x) >= 1e-4 AND abs(x) < 1e16 THEN {plain} "
        f"ELSE {let('s', 'CAST(x AS STRING)', scientific)} END"
    )
    return let("x", value, body)


def merge_maps(base: str, update: str) -> str:
    """``dict.update``: new values win, known keys keep their place."""
    return (
        f"map_concat(transform_values({base}, (mk, mv) -> CASE WHEN "
        f"map_contains_key({update}, mk) THEN try_element_at({update}, mk) ELSE mv END), "
        f"map_filter({update}, (uk, uv) -> NOT map_contains_key({base}, uk)))"
    )


def last_wins_map(keys: str, values: str) -> str:
    """Map from parallel arrays; a repeated key keeps its first place, last value."""
    return (
        f"map_from_arrays(array_distinct({keys}), transform(array_distinct({keys}), "
        f"lk -> element_at(reverse({values}), "
        f"CAST(array_position(reverse({keys}), lk) AS INT))))"
    )
