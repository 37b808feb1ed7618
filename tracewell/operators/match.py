"""Rule matching over file rows: quick scan, hits, suspicious code, validations.

Everything here is one projection per file row followed by an explode. Each regular expression is
a literal in the plan, so it is compiled once per task; a file-level test in front of each rule
keeps the per-line work to rules that can match at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expressions import (
    case, empty, let, lines_of, marked_lines, marked_matches, null, strip, struct, text,
    window_text,
)
from tracewell.functions.rows import explode_structs
from tracewell.functions.scalars import describe_expr
from tracewell.operators.facts import JS, KEYS
from tracewell.rules.catalog import (
    GENERIC, LITERAL_LANGUAGES, ROLES, Rule, java_regex, literal_rules, regex_rules,
    required_literal, word_regex,
)

ISSUE = "struct<rule_type:string,line_no:int,pattern:string,code:string>"
RULE = "struct<role:string,rule_type:string,rule_ord:int,pattern:string>"
HIT = ("struct<role:string,rule_type:string,rule_ord:int,line_no:int,code:string,pattern:string,"
       "context:string,assigned:string>")
PLACE = "struct<line_no:int,text:string>"
PLACED = "struct<rule_type:string,pattern:string,at:array<int>>"
WRAPPED = ("struct<sink_type:string,line_no:int,code:string,pattern:string,wrapped_sink:string,"
           "context:string>")
SUSPICIOUS = ("struct<type:string,rule_ord:int,line_no:int,code:string,pattern:string,"
              "description:string,context:string>")
VALIDATION = ("struct<line_no:int,code:string,context:string,bypasses:array<string>,"
              "input_line:int,validated_input:string>")

# Expressions of the line-level checks that are not in a pack.
VALIDATION_PATTERNS = [r"if\s*\(", "validate", "sanitize", "check", "assert", "verify"]
OBFUSCATION_PATTERNS = [
    r"""\[['"][^'"]*['"]\s*\+\s*['"][^'"]*['"]\]""",
    r"String\.fromCharCode\s*\(",
    r"(\\x[0-9a-fA-F]{2}){3,}",
]
PROTOTYPE_PATTERNS = [
    r"Object\.prototype\s*\.", r"Array\.prototype\s*\.", r"String\.prototype\s*\.",
    r"__proto__\s*=",
]
# Bypass checks on the context of a validation, with the message of a match; the
# braces stand for the captured name.
BYPASS_CHECKS = [
    (r"""typeof\s+(\w+)\s*===\s*['"](\w+)['"]""",
     "Type check for '{}' can be bypassed by providing values of the right type but malicious "
     "content"),
    (r"if\s*\(\s*(\w+)\s*(!?=+)\s*(null|undefined)",
     "Null check for '{}' doesn't validate the actual content if provided"),
    (r"(\w+)\.length\s*([<>=]+)\s*\d+", "Length check for '{}' doesn't validate the content"),
    (r"""(\w+)\s*===\s*['"][^'"]*['"]""",
     "Exact string comparison for '{}' could be bypassed with alternative encodings or case "
     "differences"),
    (r"(indexOf|includes)\s*\(",
     "Whitelist check using {} can be bypassed if the list is incomplete"),
    (r"\/[^\^].*[^$]\/[gimuy]*\.test\s*\(",
     "Regex without proper anchors (^ and $) can be bypassed by adding content before or after "
     "the pattern"),
    (r"(?i)\.toLowerCase\(\)\s*===",
     "Case-insensitive comparison can be bypassed if Unicode normalization is not considered"),
]
VECTORS = {
    "sql_injection": ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "UNION"],
    "xss": ["<script", "onerror", "javascript:", r"eval\("],
    "command_injection": [";", "&&", r"\|\|", "`"],
}
MISSING_MESSAGE = "{} validation may be incomplete - missing checks for: "
NO_BYPASS = "No obvious bypasses detected"
ASSIGNMENT = r"(?d)(?<!\w)(\w++)\s*=(.*)"
COMPARED_NAME = r"(\w+)(?:\s*(?:===|!==|==|!=|>=|<=|>|<)|\s+in(?![0-9A-Za-z_]))"


def _found(value: str, pattern: str) -> str:
    """Whether a case-sensitive expression matches; plain text in it is looked for first, or alone if there is no more."""
    whole = f"rlike({value}, {text(java_regex(pattern))})"
    literal = "" if "(?" in pattern else required_literal(pattern)
    if not literal:
        return whole
    held = f"contains({value}, {text(literal)})"
    return held if literal == pattern else f"({held} and {whole})"


def _any(value: str, patterns: Iterable[str]) -> str:
    return "(" + " or ".join(_found(value, p) for p in patterns) + ")"


# --- quick scan -------------------------------------------------------------------------------

def _whole_text(rule: Rule) -> str:
    """Every match of a rule over the whole text, one entry per match."""
    regex = java_regex(rule.pattern, rule.ignore_case)
    issue = struct(rule_type=text(rule.rule_type), line_no="_mi + 1", pattern=text(rule.pattern),
                   code=strip("l[_mi]"))
    found = marked_lines(marked_matches("content", regex), issue)
    gate = f"rlike(content, {text(regex)})"
    literal = required_literal(rule.pattern)
    if literal:
        gate = f"contains(lc, {text(literal.lower())}) and {gate}"
    return f"if({gate}, {found}, {empty(ISSUE)})"


def _scan(rules: Iterable[Rule]) -> str:
    return "flatten(array(" + ", ".join(_whole_text(r) for r in rules) + "))"


def quick_scan(files: DataFrame, packs: dict[tuple[str, ...], str] | None = None,
               common: tuple[Rule, ...] | None = None) -> DataFrame:
    """Issues of the common pack and of the pack of each file's language, over the whole text.

    Matches may span lines; an issue carries the line its match starts on. TypeScript has no pack.
    """
    packs = {(p,): p for p in LITERAL_LANGUAGES} if packs is None else packs
    rules = regex_rules("common") if common is None else common
    parts = [_scan(rules)] if rules else []
    if packs:
        parts.append(case("language", {k: _scan(regex_rules(p)) for k, p in packs.items()},
                          empty(ISSUE)))
    body = let({"lc": "lower(content)", "l": lines_of("content")}, f"concat({', '.join(parts)})")
    return explode_structs(files, [*KEYS, "language"], F.expr(body), "issue_ord")


def web_scan(files: DataFrame) -> DataFrame:
    """Web pack over markup, styles and scripts."""
    return quick_scan(files, {("html", "css", "javascript"): "web"}, common=())


# --- source, sink and sanitizer hits ----------------------------------------------------------

def _pack_literal(language: str, roles: Iterable[str]) -> str:
    """The rules of a language as one JSON literal; the optimizer folds it into an array."""
    rows = [{"role": r.role, "rule_type": r.rule_type, "rule_ord": r.rule_ord,
             "pattern": r.pattern} for role in roles for r in literal_rules(language, role)]
    return f"from_json({text(json.dumps(rows))}, 'array<{RULE}>')"


def _rules_for_language(roles: Iterable[str] = ROLES) -> str:
    return case("language", {
        ("java",): _pack_literal("java", roles), JS: _pack_literal("javascript", roles),
        ("python",): _pack_literal("python", roles)}, _pack_literal(GENERIC, roles))


def _assignment(code: str, group: int) -> str:
    """Name (1) or right side (2) of the first assignment in a line, ``''`` when there is none.

    What the right side of a later assignment holds, that of the first holds too, so one fixed expression finds the
    name for any literal; an expression with the literal in it would be compiled again for every pair.
    """
    return f"regexp_extract({code}, {text(ASSIGNMENT)}, {group})"


def assigned_name(code: str, literal: str) -> str:
    """Name on the left of an assignment whose right side holds ``literal`` (``''`` when none)."""
    return (f"if(instr({code}, '=') > 0, if(contains({_assignment(code, 2)}, {literal}), "
            f"{_assignment(code, 1)}, ''), '')")


def _first_argument(code: str, literal: str) -> str:
    call = (f"concat('(?d)\\\\Q', regexp_replace({literal}, '\\\\($', ''), "
            "'\\\\E\\\\s*\\\\(([^)]+)\\\\)')")
    return strip(f"get(split(regexp_extract({code}, {call}, 1), ',', -1), 0)")


def _around(line_no: str, n: int, padded: bool) -> str:
    """The lines around a line of ``lines``; of a piece those in ``padded``, which begins with ``before``."""
    return window_text("pl", f"{line_no} + sk", n) if padded else window_text("ls", line_no, n)


def _lines(padded: bool) -> dict[str, str]:
    return {"ls": "lines", **({"pl": "padded", "sk": "size(before)"} if padded else {})}


def hits_expr(custom: str = "custom_rules", padded: bool = False, roles: Sequence[str] = ROLES,
              context: bool = True) -> str:
    """Literal hits of a file in line, type, literal order; ``lines`` must be a column.

    Only rules of the given roles are looked for; without ``context`` that field is null.
    """
    code = strip("x")
    assigned = (f"if(r.role = 'sink', {null('string')}, coalesce("
                f"nullif({assigned_name('cd', 'r.pattern')}, ''), "
                f"if(r.role = 'sanitizer', nullif({_first_argument('cd', 'r.pattern')}, ''), "
                f"{null('string')})))")
    hit = let({"cd": code}, struct(
        role="r.role", rule_type="r.rule_type", rule_ord="r.rule_ord", line_no="i + 1", code="cd",
        pattern="r.pattern", context=_around("i + 1", 2, padded) if context else null("string"),
        assigned=assigned))
    asked = ", ".join(text(r) for r in roles)
    rules = (f"concat({_rules_for_language(roles)}, "
             f"coalesce(filter({custom}, r -> r.role in ({asked})), {empty(RULE)}))")
    return let({
        **_lines(padded),
        "rl": f"filter({rules}, r -> contains(content, r.pattern))",
    }, f"flatten(transform(ls, (x, i) -> transform(filter(rl, r -> contains(x, r.pattern)), r -> {hit})))")


SOURCE = ("struct<line_no:int,source_type:string,source_code:string,source_pattern:string,"
          "context:string,derived_variable:string,parent_line:int,parent_pattern:string,"
          "assigned:string>")


def derived_shape(name: str) -> str:
    """The expression of an assignment from a value that holds ``name``."""
    return f"concat('(?d)(?<!\\\\w)(\\\\w++)\\\\s*=\\\\s*.*', {name})"


def sources_expr(hits: str = "hits") -> str:
    """Direct sources, then lines that assign from a variable filled by a direct source."""
    direct = struct(
        line_no="h.line_no", source_type="h.rule_type", source_code="h.code",
        source_pattern="h.pattern", context="h.context", derived_variable=null("string"),
        parent_line=null("int"), parent_pattern=null("string"), assigned="h.assigned")
    indirect = struct(
        line_no="s.line_no", source_type="concat('indirect_', h.rule_type)",
        source_code=strip("s.text"), source_pattern="h.assigned", context=null("string"),
        derived_variable=_assignment("s.text", 1), parent_line="h.line_no",
        parent_pattern="h.pattern", assigned=null("string"))
    again = "filter(nl, s -> s.line_no <> h.line_no and contains(s.value, h.assigned))"
    numbered = struct(line_no="i + 1", text="x",
                      value=f"if(instr(x, '=') > 0, {_assignment('x', 2)}, '')")
    return let({
        "hs": f"filter({hits}, h -> h.role = 'source')",
        "fs": "filter(hs, h -> h.assigned is not null)",
        "nl": f"if(size(fs) = 0, {empty('struct<line_no:int,text:string,value:string>')}, "
              f"filter(transform(lines, (x, i) -> {numbered}), s -> s.value <> ''))",
    }, f"concat(transform(hs, h -> {direct}), "
       f"flatten(transform(fs, h -> transform({again}, s -> {indirect}))))")


SINK = ("struct<line_no:int,sink_type:string,sink_code:string,sink_pattern:string,context:string,"
        "wrapped_sink:string>")


def sinks_expr(hits: str = "hits", wrappers: str | None = "wrappers",
               custom: str = "custom_rules", padded: bool = False) -> str:
    """Direct sinks, then wrapper calls with a sink literal in their surrounding three lines."""
    direct = struct(line_no="h.line_no", sink_type="h.rule_type", sink_code="h.code",
                    sink_pattern="h.pattern", context="h.context", wrapped_sink=null("string"))
    hs = {"hs": f"filter({hits}, h -> h.role = 'sink')"}
    if wrappers is None:
        return let(hs, f"transform(hs, h -> {direct})")
    wrapped = struct(
        line_no="s.line_no", sink_type="concat('wrapper_', r.rule_type)",
        sink_code=strip("s.text"), sink_pattern="w", context="cx", wrapped_sink="r.pattern")
    # the lines that hold a rule are found once, in a whole file by its hits; which are near is a matter of numbers
    middle = "s.line_no + sk" if padded else "s.line_no"
    near = f"a between {middle} - 3 and {middle} + 3"
    if padded:
        held = (f"filter(transform(pl, (x, i) -> if(contains(x, r.pattern), i + 1, {null('int')})), "
                "a -> a is not null)")
    else:
        held = "array_distinct(transform(filter(hs, h -> h.pattern = r.pattern), h -> h.line_no))"
    placed = struct(rule_type="r.rule_type", pattern="r.pattern", at=held)
    per_line = let({
        "nr": f"filter(rl, r -> exists(r.at, a -> {near}))",
        "cx": f"if(size(nr) = 0, '', {_around('s.line_no', 3, padded)})",
    }, f"flatten(transform(nr, r -> transform(filter(r.at, a -> {near}), a -> {wrapped})))")
    rules = f"concat({_rules_for_language(['sink'])}, coalesce({custom}, {empty(RULE)}))"
    by_wrapper = let({
        **_lines(padded),
        "ct": "array_join(pl, '\\n')" if padded else "array_distinct(transform(hs, h -> h.pattern))",
        "nl": "transform(ls, (x, i) -> struct(i + 1 as line_no, x as text))",
        "wl": f"filter(transform({wrappers}, w -> "
              + struct(w="w", at=f"if(contains(content, w), filter(nl, s -> contains(s.text, w)), {empty(PLACE)})")
              + "), q -> size(q.at) > 0)",
        "rl": f"if(size(wl) = 0, {empty(PLACED)}, transform(filter({rules}, "
              f"r -> r.role = 'sink' and {'contains' if padded else 'array_contains'}(ct, r.pattern)), r -> {placed}))",
    }, f"flatten(transform(wl, q -> {let({'w': 'q.w'}, f'flatten(transform(q.at, s -> {per_line}))')}))")
    return let(hs,
               f"concat(transform(hs, h -> {direct}), "
               f"if(coalesce(size({wrappers}), 0) > 0, {by_wrapper}, {empty(SINK)}))")


SANITIZER = ("struct<line_no:int,sanitizer_type:string,sanitizer_code:string,"
             "sanitizer_pattern:string,sanitized_variable:string,context:string>")


def sanitizers_expr(hits: str = "hits") -> str:
    row = struct(line_no="h.line_no", sanitizer_type="h.rule_type", sanitizer_code="h.code",
                 sanitizer_pattern="h.pattern", sanitized_variable="h.assigned",
                 context="h.context")
    return f"transform(filter({hits}, h -> h.role = 'sanitizer'), h -> {row})"


# --- validations ------------------------------------------------------------------------------

def plain(pattern: str) -> str:
    """The text an expression without operators stands for."""
    return pattern.replace("\\", "")


def _bypasses(ctx: str) -> str:
    parts = []
    for pattern, message in BYPASS_CHECKS:
        regex, group, value = java_regex(pattern), 0, text(message)
        if "{}" in message:
            before, after = message.split("{}")
            group, value = 1, f"concat({text(before)}, v, {text(after)})"
        found = f"transform(regexp_extract_all({ctx}, {text(regex)}, {group}), v -> {value})"
        literal = required_literal(pattern)
        parts.append(f"if(contains(lw, {text(literal.lower())}), {found}, {empty('string')})"
                     if literal else found)
    for vector, words in VECTORS.items():
        missing = "array_compact(array(" + ", ".join(
            f"if(contains(lw, {text(plain(w).lower())}), null, {text(w)})"
            for w in sorted(words)) + "))"
        message = f"concat({text(MISSING_MESSAGE.format(vector))}, array_join(ms, ', '))"
        parts.append(let({"ms": missing}, f"if(size(ms) between 1 and {len(words) - 1}, "
                                          f"array({message}), {empty('string')})"))
    return let({"lw": f"lower({ctx})"}, f"concat({', '.join(parts)})")


def _input_line(ctx: str, line_no: str, numbered: str) -> str:
    """Nearest earlier line assigning a compared name, else five lines up."""
    names = f"array_distinct(regexp_extract_all({ctx}, {text(word_regex(COMPARED_NAME))}, 1))"
    shape = "concat('(?d)(?:^|[^0-9A-Za-z_])(?:', array_join(vn, '|'), ')\\\\s*=')"
    earlier = (f"transform(filter({numbered}, s -> s.line_no < {line_no} and instr(s.text, '=') > 0 "
               f"and s.text rlike sh), s -> s.line_no)")
    found = let({"vn": names, "sh": shape},
                f"if(size(vn) = 0, {null('int')}, array_max({earlier}))")
    return f"coalesce({found}, greatest(1, {line_no} - 5))"


def validations_expr(names: str = "validation_names", input_line: bool = True, padded: bool = False) -> str:
    """Validation attempts in line order, one entry per matching check.

    ``input_line`` looks through all earlier lines; without it the field is left out.
    """
    count = " + ".join(f"int({_found('q.text', p)})" for p in VALIDATION_PATTERNS)
    count += f" + size(filter(coalesce({names}, {empty('string')}), f -> contains(q.text, f)))"
    row = struct(
        line_no="p.line_no", code=strip("p.text"), context="cx", bypasses=_bypasses("cx"),
        **({"input_line": _input_line("cx", "p.line_no", "nl")} if input_line else {}),
        validated_input=null("string"))
    one = let({"cx": _around("p.line_no", 4, padded), "rw": row}, "array_repeat(rw, p.n)")
    numbered = "transform(ls, (x, i) -> struct(i + 1 as line_no, x as text))"
    counted = f"transform(nl, q -> struct(q.line_no, q.text, {count} as n))"
    return let({**_lines(padded), "nl": numbered},
               f"flatten(transform(filter({counted}, p -> p.n > 0), p -> {one}))")


# --- suspicious code --------------------------------------------------------------------------

def _per_line_rule(kind: str, order: str, pattern: str, condition: str, gate: str) -> str:
    row = struct(type=text(kind), rule_ord=order, line_no="s.line_no", code=strip("s.text"),
                 pattern=text(pattern), description=describe_expr(text(kind)),
                 context=window_text("ls", "s.line_no", 2))
    return f"if({gate}, transform(filter(nl, s -> {condition}), s -> {row}), {empty(SUSPICIOUS)})"


def suspicious_expr(names: str = "suspicious_names") -> str:
    """Suspicious code in type, expression, line order; then obfuscation, then prototypes."""
    rules = regex_rules("suspicious")
    parts = []
    for rule in rules:
        parts.append(_per_line_rule(rule.rule_type, str(rule.rule_ord), rule.pattern,
                                    _found("s.text", rule.pattern), _found("content", rule.pattern)))
    custom = struct(type="'custom_suspicious'", rule_ord=str(len(rules)), line_no="s.line_no",
                    code=strip("s.text"), pattern="f",
                    description=describe_expr("'custom_suspicious'"),
                    context=window_text("ls", "s.line_no", 2))
    parts.append(f"flatten(transform(coalesce({names}, {empty('string')}), f -> "
                 f"transform(filter(nl, s -> contains(s.text, f)), s -> {custom})))")
    for kind, label, patterns, about in (
        ("obfuscated_code", "obfuscated_strings", OBFUSCATION_PATTERNS,
         "Potentially obfuscated code that might hide malicious functionality"),
        ("prototype_pollution", "prototype_modification", PROTOTYPE_PATTERNS,
         "Modification of object prototypes that could lead to prototype pollution "
         "vulnerabilities"),
    ):
        row = struct(type=text(kind), rule_ord=str(len(rules) + 1), line_no="s.line_no",
                     code=strip("s.text"), pattern=text(label), description=text(about),
                     context=window_text("ls", "s.line_no", 2))
        parts.append(f"if({_any('content', patterns)}, transform(filter(nl, s -> "
                     f"{_any('s.text', patterns)}), s -> {row}), {empty(SUSPICIOUS)})")
    return let({"ls": "lines",
                "nl": "transform(ls, (x, i) -> struct(i + 1 as line_no, x as text))"},
               f"concat({', '.join(parts)})")
