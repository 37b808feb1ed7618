from tracewell.rules.catalog import (  # noqa: F401
    GENERIC,
    LITERAL_LANGUAGES,
    REGEX_PACKS,
    Rule,
    fallback_rules,
    java_regex,
    literal_rules,
    regex_rules,
    rules_frame,
)
