"""Small builders for Spark SQL expression text.

A source file is one row, so everything that stays inside a file is computed
with array functions on that row: no shuffle, no Python. ``let`` names an intermediate value once;
without it Catalyst may inline the value into a lambda and compute it again for every element.
"""

from __future__ import annotations

from collections.abc import Mapping

# Unicode noncharacters, which no text should hold.
MARK = "\ufdd0"
OTHER_MARK = "\ufdd1"


def text(value: str) -> str:
    """A SQL string literal."""
    body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{body}'"


def let(bindings: Mapping[str, str], body: str) -> str:
    """``body`` with every name bound to its value, evaluated once, earlier names usable later.

    The value is the start of an aggregate over nothing and the body its finish: a transform would copy the whole
    result of the body once for every name.
    """
    for name, value in reversed(bindings.items()):
        body = f"aggregate(array(), {value}, ({name}, _no) -> {name}, {name} -> {body})"
    return body


def struct(**fields: str) -> str:
    inner = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"named_struct({inner})"


def empty(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def null(data_type: str) -> str:
    return f"cast(null as {data_type})"


def strip(value: str) -> str:
    """Remove leading and trailing ASCII white space."""
    return f"btrim({value}, {text(' ' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))})"


def lines_of(content: str) -> str:
    """Lines of a text, a trailing empty one included."""
    return f"split({content}, '\\n', -1)"


def window_text(lines: str, line_no: str, before: int, after: int | None = None) -> str:
    """The lines around ``line_no``, joined, clamped to the file."""
    after = before if after is None else after
    first = f"greatest(1, {line_no} - {before})"
    last = f"least(size({lines}), {line_no} + {after})"
    return f"array_join(slice({lines}, {first}, greatest(0, {last} - {first} + 1)), '\\n')"


def marked_matches(content: str, pattern: str) -> str:
    """The text with a mark in front of every match. Marks already in it are changed first."""
    clean = f"replace({content}, {text(MARK)}, {text(OTHER_MARK)})"
    return f"regexp_replace({clean}, {text(pattern)}, {text(MARK + '$0')})"


def marked_lines(marked: str, element: str) -> str:
    """``element`` once per mark; it may use ``_mi`` (0-based line) and runs in text order."""
    count = f"length(_ml) - length(replace(_ml, {text(MARK)}, ''))"
    return (f"flatten(transform(split({marked}, '\\n', -1), (_ml, _mi) -> "
            f"if(contains(_ml, {text(MARK)}), array_repeat({element}, {count}), array())))")


def find_all(content: str, pattern: str, groups: Mapping[str, int], result: str,
             element_type: str) -> str:
    """One ``result`` per match: it may use ``_ln`` (line number of its start) and the groups.

    The text is searched once, to place a mark before each match. Splitting on newlines counts the
    matches that start on each line; splitting on marks gives texts that begin with a match, from
    which the groups are read. Patterns must not look beyond their match (no ``$``, no lookahead).
    """
    picks = {name: f"regexp_extract(_sg[_li + 1], {text(pattern)}, {number})"
             for name, number in groups.items()}
    body = let({"_sg": f"split(_mk, {text(MARK)}, -1)"},
               f"transform({marked_lines('_mk', '_mi + 1')}, (_ln, _li) -> {let(picks, result)})")
    return let({"_mk": marked_matches(content, pattern)},
               f"if(contains(_mk, {text(MARK)}), {body}, {empty(element_type)})")


def case(value: str, branches: Mapping[tuple[str, ...], str], otherwise: str) -> str:
    whens = " ".join(
        f"when {value} in ({', '.join(text(k) for k in keys)}) then {result}"
        for keys, result in branches.items()
    )
    return f"case {whens} else {otherwise} end"
