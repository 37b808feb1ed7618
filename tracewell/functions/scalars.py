"""Scalar functions on columns: paths, languages, severity, CWE numbers, text shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.expressions import case, let, strip, text

# File extension to language name.
LANGUAGE_OF = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "java": "java", "c": "c", "cpp": "c++", "cs": "csharp", "go": "golang",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "rs": "rust", "scala": "scala",
    "sh": "bash", "sql": "sql", "html": "html", "css": "css", "xml": "xml", "json": "json",
    "yaml": "yaml", "yml": "yaml",
}

# Weakness number of a finding type; order decides partial matches.
CWE_OF = {
    "sql_injection": "CWE-89",
    "command_injection": "CWE-77",
    "xss": "CWE-79",
    "csrf": "CWE-352",
    "path_traversal": "CWE-22",
    "open_redirect": "CWE-601",
    "insecure_deserialization": "CWE-502",
    "xxe": "CWE-611",
    "broken_authentication": "CWE-287",
    "sensitive_data_exposure": "CWE-200",
    "insecure_direct_object_reference": "CWE-639",
    "security_misconfiguration": "CWE-1021",
    "missing_function_level_access_control": "CWE-285",
    "using_components_with_known_vulnerabilities": "CWE-1035",
    "insecure_communication": "CWE-319",
    "insufficient_logging_and_monitoring": "CWE-778",
    "hard_coded_credentials": "CWE-798",
    "weak_cryptography": "CWE-326",
    "insecure_random": "CWE-330",
    "race_condition": "CWE-362",
    "buffer_overflow": "CWE-120",
    "integer_overflow": "CWE-190",
    "format_string": "CWE-134",
    "prototype_pollution": "CWE-1321",
    "nosql_injection": "CWE-943",
    "os_command_injection": "CWE-78",
    "code_injection": "CWE-94",
    "ssrf": "CWE-918",
    "ldap_injection": "CWE-90",
    "xml_injection": "CWE-91",
    "header_injection": "CWE-113",
    "template_injection": "CWE-1336",
}

# Words in a finding type that decide its severity, most severe first.
SEVERITY_WORDS = {
    "Critical": ["sql_injection", "remote_code_execution", "command_injection", "deserialization",
                 "xxe", "ssrf", "authentication_bypass"],
    "High": ["xss", "csrf", "path_traversal", "open_redirect", "insecure_deserialization",
             "sensitive_data_exposure", "broken_authentication", "hard_coded_credentials",
             "weak_cryptography"],
    "Medium": ["insecure_configuration", "insecure_communication", "missing_security_headers",
               "session_fixation", "clickjacking", "cors_misconfiguration", "xml_injection",
               "improper_input_validation"],
}

# Words in a path that decide the purpose of a file, first hit wins.
PURPOSE_WORDS = {
    "Test": ["test"],
    "Controller": ["controller"],
    "Model": ["model"],
    "Service": ["service"],
    "Data Access": ["repository", "dao"],
    "API Endpoint": ["api", "rest", "endpoint"],
    "Middleware": ["middleware", "filter"],
    "Authentication/Security": ["auth", "security", "login"],
    "Utility": ["util", "helper", "common"],
    "Configuration": ["config", "settings"],
}

# Words in the head of a file that make it security-relevant.
SECURITY_WORDS = [
    "password", "token", "auth", "crypt", "hash", "encrypt", "decrypt", "permission", "role",
    "admin", "login", "logout", "session", "jwt", "oauth", "csrf", "xss", "sql", "injection",
    "sanitize",
]

# Reader hints by lower-case file extension.
CONFIG_HINT = ("This is a configuration file. Focus on security issues like hardcoded credentials, "
               "insecure settings, or vulnerable dependencies.")
MARKUP_HINT = ("This is a web markup/style file. Focus on client-side vulnerabilities like XSS, "
               "CSRF, or insecure resource loading.")
DOCS_HINT = ("This is a documentation file. Focus on potential sensitive information exposure or "
             "hardcoded credentials.")
HINT_OF = {
    ("xml", "pom", "config", "properties", "yaml", "yml"): CONFIG_HINT,
    ("html", "htm", "css"): MARKUP_HINT,
    ("md", "txt", "rst"): DOCS_HINT,
}
TRUNCATED = "\n\n... [Content truncated due to length] ...\n\n"

# Description of each suspicious-code type.
DESCRIPTION_OF = {
    "dynamic_code_execution":
        "Dynamic code execution that could lead to code injection vulnerabilities",
    "direct_object_references":
        "Direct object reference that might be vulnerable to IDOR attacks",
    "hardcoded_credentials":
        "Hardcoded credentials that should be stored securely in environment variables or a "
        "secure vault",
    "insecure_configuration":
        "Insecure configuration that might weaken security protections",
    "weak_crypto":
        "Weak cryptographic implementation that might not provide adequate security",
    "race_conditions":
        "Potential race condition that might lead to timing attacks or inconsistent state",
    "custom_suspicious": "Custom function flagged as potentially security-sensitive",
}
DEFAULT_DESCRIPTION = "Suspicious code pattern"


def stripped(column: Column) -> Column:
    return F.btrim(column, F.lit(" \t\n\x0b\f\r"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text after the last dot; a name whose only dots lead it has no extension."""
    bare = F.ltrim(name, F.lit("."))
    return F.when(F.instr(bare, ".") > 0, F.substring_index(bare, ".", -1)).otherwise("")


def lookup(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def language_of(name: Column) -> Column:
    return lookup(extension(basename(name)), LANGUAGE_OF, "unknown")


def normalize_path(path: Column) -> Column:
    """Absolute path without ``.``, ``..`` or repeated separators."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def type_key(finding_type: Column) -> Column:
    return F.replace(F.lower(finding_type), F.lit(" "), F.lit("_"))


def cwe_of(finding_type: Column) -> Column:
    """Exact table hit, else the first entry where either text contains the other, else null."""
    key = type_key(finding_type)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
                        for k, v in CWE_OF.items()])
    partial = F.filter(entries, lambda e: F.contains(key, e.k) | F.contains(e.k, key))
    return F.coalesce(lookup(key, CWE_OF), F.get(partial, F.lit(0)).v)


def severity_of(finding_type: Column) -> Column:
    key = type_key(finding_type)
    chain = F
    for level, words in SEVERITY_WORDS.items():
        any_word = F.lit(False)
        for word in words:
            any_word = any_word | F.contains(key, F.lit(word))
        chain = chain.when(any_word, level)
    return chain.otherwise("Low")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def severity_class(severity: Column) -> Column:
    known = F.lower(F.coalesce(severity, F.lit("Medium")))
    exact = F.coalesce(severity, F.lit("Medium")).isin("Critical", "High", "Medium")
    return F.when(exact, known).otherwise("low")


def security_words_in(head: Column) -> Column:
    low = F.lower(head)
    words = F.array(*[F.lit(w) for w in SECURITY_WORDS])
    return F.filter(words, lambda w: F.contains(low, w))


def purpose_of(path: Column, security_hits: Column | None = None) -> Column:
    low = F.lower(path)
    chain = F
    for purpose, words in PURPOSE_WORDS.items():
        any_word = F.lit(False)
        for word in words:
            any_word = any_word | F.contains(low, F.lit(word))
        chain = chain.when(any_word, purpose)
    if security_hits is not None:
        chain = chain.when(F.size(security_hits) > 0, "Security-Related")
    return chain.otherwise("Unknown")


def kind_hint(name: Column) -> Column:
    ext = F.lower(extension(name))
    chain = F
    for exts, hint in HINT_OF.items():
        chain = chain.when(ext.isin(*exts), hint)
    return chain.otherwise("")


def shorten_middle(column: Column, limit: int = 12_000) -> Column:
    half = limit // 2
    return F.when(
        F.length(column) > limit,
        F.concat(F.left(column, F.lit(half)), F.lit(TRUNCATED), F.right(column, F.lit(half)))
    ).otherwise(column)


def fingerprint(path: Column, content: Column) -> Column:
    return F.md5(F.concat(path, F.md5(content)))


def describe(pattern_type: Column) -> Column:
    return lookup(pattern_type, DESCRIPTION_OF, DEFAULT_DESCRIPTION)


def describe_expr(value: str) -> str:
    return case(value, {(k,): text(v) for k, v in DESCRIPTION_OF.items()},
                text(DEFAULT_DESCRIPTION))


def captured(content: Column, pattern: str) -> Column:
    """First capture group of every match, stripped, blanks dropped."""
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    return F.filter(F.transform(found, stripped), lambda v: v != "")


def line_at(content: Column, position: Column) -> Column:
    """Line number of a 0-based character position."""
    head = F.left(content, position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
