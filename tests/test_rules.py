import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.operators import facts, match
from tracewell.rules import catalog
from tracewell.rules.catalog import (
    GENERIC, REGEX_PACKS, fallback_rules, java_regex, literal_rules, regex_rules, required_literal,
    rules_frame,
)

ALL = [r for pack in REGEX_PACKS for r in regex_rules(pack)]
SAMPLES = [
    'password = "x"', "API key = 'y'", "curl http://h/ ftp://h", "md5(a) Math.random()",
    "cursor.execute(f'q')", "Runtime.getRuntime().exec(c)", "el.innerHTML = a", "new Random()",
    "<script src=\"http://x\">", "Set-Cookie: a=b", "yaml.load(x)", "eval (x) == 'a'",
    "pickle.loads(x); os.system (y)", "setTimeout('x', 1); x.__proto__ = 1", "a\n=\n'b'",
    'getParameter("q")', "Object.assign (a)", "location = a + b", "validateForm ( )",
]


def test_pack_sizes():
    assert {p: len(regex_rules(p)) for p in REGEX_PACKS} == {
        "common": 32, "java": 57, "javascript": 102, "python": 93, "web": 64, "suspicious": 30}
    sizes = {(lang, role): len(literal_rules(lang, role)) for lang in ("java", "javascript", "python")
             for role in catalog.ROLES}
    assert sizes == {
        ("java", "source"): 35, ("java", "sink"): 47, ("java", "sanitizer"): 23,
        ("javascript", "source"): 49, ("javascript", "sink"): 66, ("javascript", "sanitizer"): 31,
        ("python", "source"): 42, ("python", "sink"): 74, ("python", "sanitizer"): 31}
    assert len(fallback_rules()) == 11


def test_generic_pack_is_the_union_without_repeats():
    for role in catalog.ROLES:
        wanted = {(r.rule_type, r.pattern) for lang in ("java", "javascript", "python")
                  for r in literal_rules(lang, role)}
        generic = [(r.rule_type, r.pattern) for r in literal_rules(GENERIC, role)]
        assert len(generic) == len(set(generic)) and set(generic) == wanted


def test_every_rule_compiles_in_java_and_never_matches_nothing(spark):
    shapes = [java_regex(r.pattern, r.ignore_case) for r in ALL]
    shapes += [java_regex(p) for p in (
        *match.VALIDATION_PATTERNS, *match.OBFUSCATION_PATTERNS, *match.PROTOTYPE_PATTERNS,
        *(p for p, _ in match.BYPASS_CHECKS), facts.JS_DECLARATION, facts.JS_FUNCTION,
        facts.ANY_CALL, facts.ANY_ASSIGNMENT, facts.JAVA_CLASS, facts.JAVA_METHOD,
        facts.JAVA_FIELD, facts.TYPED_VARIABLE, facts.GENERIC_FUNCTION, facts.LINE_ASSIGNMENT)]
    hits = spark.range(1).select(*[F.lit("").rlike(s).alias(f"c{i}") for i, s in enumerate(shapes)])
    assert not any(hits.first())


@pytest.mark.parametrize("pack", REGEX_PACKS)
def test_rules_agree_with_python_on_samples(spark, pack):
    rules = regex_rules(pack)
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", *[
        F.col("s").rlike(java_regex(r.pattern, r.ignore_case)).alias(f"c{i}")
        for i, r in enumerate(rules)]).collect()
    for row in rows:
        for i, r in enumerate(rules):
            flags = (re.IGNORECASE if r.ignore_case else 0) | re.ASCII
            assert row[f"c{i}"] == bool(re.search(r.pattern, row.s, flags)), (r.pattern, row.s)


def test_rules_compile_in_duckdb_but_for_lookahead():
    con = duckdb.connect()
    for r in ALL:
        if "(?!" not in r.pattern:
            shape = java_regex(r.pattern).removeprefix("(?d)")
            con.execute("select regexp_matches('x', ?)", [shape])


def test_required_literal_is_part_of_every_match():
    for r in ALL:
        literal = required_literal(r.pattern)
        for sample in SAMPLES:
            found = re.search(r.pattern, sample, re.IGNORECASE)
            if found:
                assert literal.lower() in found.group(0).lower(), r.pattern
    assert required_literal(r"password\s*=\s*['\"]x") == "password"
    assert required_literal(r"ab?c+d{2}ef") == "ef"
    assert required_literal(r"a|b") == ""
    assert required_literal(r"x(yz)*w\.q") == "w.q"


def test_rules_frame(spark):
    frame = rules_frame(spark)
    assert frame.where("kind = 'regex'").count() == len(ALL)
    assert frame.where("pack = 'literals' and language = 'java' and role = 'sink'").count() == 47
