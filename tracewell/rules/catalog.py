"""Rule packs: plain text files read once on the driver into ``Rule`` records.

A rule is either a regular expression (quick scan, web scan, suspicious code) or a literal that
must occur in a line (sources, sinks, sanitizers). Matching code turns the records into
expressions; ``rules_frame`` gives them to users as a table.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass
from functools import lru_cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

REGEX_PACKS = ("common", "java", "javascript", "python", "web", "suspicious")
LITERAL_LANGUAGES = ("java", "javascript", "python")
ROLES = ("source", "sink", "sanitizer")
GENERIC = "generic"

# The reduced common pack keeps the first n entries of these types.
FALLBACK_SIZES = {
    "hardcoded_credentials": 5,
    "sensitive_info_exposure": 4,
    "insecure_communication": 2,
}

RULES_SCHEMA = (
    "pack string, language string, role string, rule_type string, rule_ord int, "
    "kind string, pattern string, ignore_case boolean"
)


@dataclass(frozen=True)
class Rule:
    pack: str
    language: str
    role: str
    rule_type: str
    rule_ord: int
    kind: str
    pattern: str
    ignore_case: bool


@lru_cache(maxsize=None)
def _entries(name: str) -> tuple[tuple[str, str], ...]:
    text = files("tracewell.rules.packs").joinpath(f"{name}.txt").read_text(encoding="utf-8")
    out, current = [], None
    for line in text.splitlines():
        if not line or line.startswith("#"):
            continue
        heading = re.fullmatch(r"\[([a-z_]+)\]", line)
        if heading:
            current = heading.group(1)
        else:
            out.append((current, line))
    return tuple(out)


@lru_cache(maxsize=None)
def regex_rules(pack: str) -> tuple[Rule, ...]:
    """All regular expressions of one pack, in order. Only the suspicious pack is case-sensitive."""
    role = "suspicious" if pack == "suspicious" else "issue"
    return tuple(
        Rule(pack, pack if pack in LITERAL_LANGUAGES else "any", role, kind, i, "regex", text,
             pack != "suspicious")
        for i, (kind, text) in enumerate(_entries(f"regex_{pack}"))
    )


def fallback_rules() -> tuple[Rule, ...]:
    """Reduced common pack for installations that ship without the full one."""
    kept: dict[str, int] = {}
    out = []
    for rule in regex_rules("common"):
        kept[rule.rule_type] = kept.get(rule.rule_type, 0) + 1
        if kept[rule.rule_type] <= FALLBACK_SIZES.get(rule.rule_type, 0):
            out.append(rule)
    return tuple(out)


@lru_cache(maxsize=None)
def literal_rules(language: str, role: str) -> tuple[Rule, ...]:
    """Literals of a role. ``generic`` is the union of all languages, grouped by type, each once."""
    if language in LITERAL_LANGUAGES:
        found = list(_entries(f"{language}_{role}s"))
    else:
        language = GENERIC
        by_type: dict[str, dict[str, None]] = {}
        for name in LITERAL_LANGUAGES:
            for kind, text in _entries(f"{name}_{role}s"):
                by_type.setdefault(kind, {})[text] = None
        found = [(kind, text) for kind, texts in by_type.items() for text in texts]
    return tuple(
        Rule("literals", language, role, kind, i, "literal", text, False)
        for i, (kind, text) in enumerate(found)
    )


def rules_frame(spark: SparkSession) -> DataFrame:
    """Every built-in rule as a row."""
    rules = [r for pack in REGEX_PACKS for r in regex_rules(pack)]
    rules += [
        r for lang in (*LITERAL_LANGUAGES, GENERIC) for role in ROLES
        for r in literal_rules(lang, role)
    ]
    return spark.createDataFrame([astuple(r) for r in rules], RULES_SCHEMA)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same expression for java.util.regex.

    ``d`` lets only a newline end a line for ``.``; an opening brace that starts no repetition is
    escaped because Java rejects it.
    """
    flags = "(?di)" if ignore_case else "(?d)"
    return flags + re.sub(r"(?<!\\)\{(?!\d)", r"\\{", pattern)


def word_regex(pattern: str) -> str:
    """``java_regex`` for an expression that opens with a word and continues with a non-word.

    Such a match always starts where a word starts and takes the whole word, so saying that
    (lookbehind, possessive repetition) changes no result and saves trying every part of a word.
    """
    greedy = pattern.replace(r"\w+", r"\w++").replace(r"(?:\.\w++)*", r"(?:\.\w++)*+")
    return "(?d)(?<!\\w)" + java_regex(greedy).removeprefix("(?d)")


def required_literal(pattern: str) -> str:
    """Longest plain text every match of ``pattern`` must contain ("" when none is certain).

    Used as a cheap substring test in front of the regular expression. Groups, classes and
    anything optional are skipped, so the answer is always safe.
    """
    if "|" in pattern:
        return ""
    best, run, i, depth = "", "", 0, 0

    def close(text):
        return text if len(text) > len(best) else best

    while i < len(pattern):
        ch, width, plain = pattern[i], 1, None
        if ch == "\\":
            width = 2
            nxt = pattern[i + 1]
            plain = None if nxt.isalnum() else nxt
        elif ch == "[":
            end = i + 1 + (pattern[i + 1] == "^")
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            width = end - i + 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch not in ".^$*+?{}":
            plain = ch
        elif ch == "{":
            close_at = pattern.find("}", i)
            if pattern[i + 1].isdigit() and close_at > 0:
                width = close_at - i + 1
        i += width
        repeated = i < len(pattern) and (pattern[i] in "*?+" or (
            pattern[i] == "{" and pattern[i + 1].isdigit()))
        if plain is not None and depth == 0 and not repeated:
            run += plain
        else:
            best = close(run)
            run = ""
    return close(run)
