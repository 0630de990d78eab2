"""Declaration rules by language: the first rule that matches a trimmed line gives its one symbol.

The patterns are anchored at the start only, case-sensitive but for PowerShell's, and free of look-around, so other
engines can run them as they stand.  Each has the name as its first group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID, _IDS, _ARGS = r"[A-Za-z_]\w*", r"[A-Za-z_$][\w$]*", r"\s*\([^;]*\)\s*"


def _words(*names: str) -> str:
    """Any run of these words, each with white space after it."""
    return rf"(?:(?:{'|'.join(names)})\s+)*"


def _maybe(name: str) -> str:
    return rf"(?:{name}\s+)?"


_JVM_TYPE = r"[\w<>\[\], ?]+\s+"
_EXPORT, _DEFAULT, _ASYNC = _maybe("export"), _maybe("default"), _maybe("async")

# Kinds and patterns, in order.
DEFAULT = [
    ("class", rf"^{_EXPORT}{_DEFAULT}{_maybe('abstract')}class\s+({_IDS})"),
    ("interface", rf"^{_EXPORT}{_DEFAULT}interface\s+({_IDS})"),
    ("type", rf"^{_EXPORT}type\s+({_IDS})"),
    ("function", rf"^{_EXPORT}{_DEFAULT}{_ASYNC}function\s+({_IDS})"),
    ("function", rf"^{_EXPORT}(?:const|let|var)\s+({_IDS})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_IDS})\s*=>"),
]
ANNOTATIONS = [
    ("class", r"^---+\s*@class\s+([A-Za-z_][\w.]*)"),
    ("type", r"^---+\s*@alias\s+([A-Za-z_][\w.]*)"),
    ("type", r"^---+\s*@enum\s+([A-Za-z_][\w.]*)"),
]
RULES: dict[str, list[tuple[str, str]]] = {
    "lua": [
        ("function", rf"^{_maybe('local')}function\s+([A-Za-z_][\w.:-]*)\s*\("),
        ("function", r"^([A-Za-z_][\w.:-]*)\s*=\s*function\s*\("),
        ("function", r"^[A-Za-z_][\w.]*\[['\"]([^'\"]+)['\"]\]\s*=\s*function\s*\("),
        ("class", rf"^{_maybe('local')}({_ID})\s*=\s*\{{\s*\}}"),
        ("class", rf"^local\s+({_ID})\s*=\s*setmetatable\s*\("),
    ],
    "java": [
        ("class", rf"^{_words('public', 'private', 'protected', 'abstract', 'final', 'static')}class\s+({_IDS})"),
        ("interface", rf"^{_words('public', 'private', 'protected', 'abstract', 'static')}interface\s+({_IDS})"),
        ("type", rf"^{_words('public', 'private', 'protected', 'static')}enum\s+({_IDS})"),
        ("function", rf"^{_words('public', 'private', 'protected', 'static', 'final', 'synchronized', 'abstract', 'native')}{_JVM_TYPE}({_IDS}){_ARGS}(?:\{{|throws\s+)"),
    ],
    "kotlin": [
        ("class", rf"^{_words('data', 'sealed', 'open', 'abstract', 'private', 'public', 'internal')}class\s+({_ID})"),
        ("interface", rf"^{_words('private', 'public', 'internal')}interface\s+({_ID})"),
        ("type", rf"^(?:enum\s+class|object)\s+({_ID})"),
        ("function", rf"^{_words('private', 'public', 'internal', 'suspend', 'inline', 'override', 'open')}fun\s+(?:{_ID}\.)?({_ID})\s*\("),
    ],
    "go": [
        ("class", rf"^type\s+({_ID})\s+struct\b"),
        ("interface", rf"^type\s+({_ID})\s+interface\b"),
        ("type", rf"^type\s+({_ID})\s+"),
        ("function", rf"^func\s+(?:\([^)]*\)\s*)?({_ID})\s*\("),
    ],
    "rust": [
        ("class", rf"^{_maybe('pub')}struct\s+({_ID})"),
        ("interface", rf"^{_maybe('pub')}trait\s+({_ID})"),
        ("type", rf"^{_maybe('pub')}(?:enum|type)\s+({_ID})"),
        ("function", rf"^{_maybe('pub')}{_ASYNC}fn\s+({_ID})\s*(?:<[^>]+>)?\s*\("),
    ],
    "csharp": [
        ("class", rf"^{_words('public', 'private', 'protected', 'internal', 'abstract', 'sealed', 'static', 'partial')}class\s+({_ID})"),
        ("interface", rf"^{_words('public', 'private', 'protected', 'internal', 'partial')}interface\s+({_ID})"),
        ("type", rf"^{_words('public', 'private', 'protected', 'internal', 'readonly', 'partial')}(?:struct|enum|record)\s+({_ID})"),
        ("function", rf"^{_words('public', 'private', 'protected', 'internal', 'static', 'virtual', 'override', 'async', 'sealed', 'partial')}{_JVM_TYPE}({_ID}){_ARGS}(?:\{{|=>)"),
    ],
    "cpp": [
        ("class", rf"^(?:template\s*<[^>]+>\s*)?(?:class|struct)\s+({_ID})"),
        ("type", rf"^(?:typedef\s+.*\s+|using\s+)({_ID})\s*[=;]"),
        ("function", r"^(?:template\s*<[^>]+>\s*)?(?:[\w:*&<>\[\],~]+\s+)+([A-Za-z_~][\w:~]*)\s*\([^;]*\)\s*(?:const\s*)?(?:\{|$)"),
    ],
    "php": [
        ("class", rf"^(?:(?:abstract|final)\s+)?class\s+({_ID})"),
        ("interface", rf"^interface\s+({_ID})"),
        ("type", rf"^trait\s+({_ID})"),
        ("function", rf"^{_words('public', 'private', 'protected', 'static', 'abstract', 'final')}function\s+({_ID})\s*\("),
    ],
    "ruby": [
        ("class", r"^class\s+([A-Za-z_][\w:]*)"),
        ("type", r"^module\s+([A-Za-z_][\w:]*)"),
        ("function", r"^def\s+(?:self\.)?([A-Za-z_][\w!?=]*)"),
    ],
    "swift": [
        ("class", rf"^{_words('public', 'private', 'internal', 'open', 'final')}class\s+({_ID})"),
        ("interface", rf"^{_words('public', 'private', 'internal', 'open')}protocol\s+({_ID})"),
        ("type", rf"^{_words('public', 'private', 'internal')}(?:struct|enum|typealias)\s+({_ID})"),
        ("function", rf"^{_words('public', 'private', 'internal', 'open', 'static', 'class', 'override')}func\s+({_ID})\s*\("),
    ],
    "dart": [
        ("class", rf"^(?:(?:abstract|base|final|sealed)\s+)?class\s+({_ID})"),
        ("type", rf"^(?:enum|mixin|typedef)\s+({_ID})"),
        ("function", rf"^{_maybe('static')}(?:Future<[^>]+>|[\w<>?]+)?\s*({_ID}){_ARGS}(?:async\s*)?\{{?"),
    ],
    "shell": [
        ("function", rf"^{_maybe('function')}([A-Za-z_][\w-]*)\s*\(\)\s*\{{?"),
        ("function", r"^function\s+([A-Za-z_][\w-]*)\b"),
    ],
    "powershell": [
        ("function", r"(?i)^function\s+([A-Za-z_][\w-]*)\b"),
        ("class", rf"(?i)^class\s+({_ID})\b"),
    ],
}
#: Lines that start like this hold no declaration.
COMMENT = r"^(//|#|\*|/\*|--|<!--)"
PYTHON_CLASS, PYTHON_DEF = rf"^class\s+({_ID})\s*[(:]", rf"^(?:async\s+)?def\s+({_ID})\s*\("
#: Rule sets of the lite profile; all other languages have the default one there.
LITE = ("lua", "go")


def rules_of(language: str, profile: str = "full") -> list[tuple[str, str]]:
    own = RULES.get(language) if profile == "full" or language in LITE else None
    return DEFAULT if own is None else own


def _first(line: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The kind and name that the first matching rule gives, or null."""
    found = [F.when(line.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for k, p in rules]
    return F.coalesce(*found, *([otherwise] if otherwise is not None else []))


def declaration(line: Column, language: Column, profile: str = "full") -> Column:
    """kind and name of the declaration on a trimmed line of a language (Python has its own operator), or null.

    The rules of all languages are more code than a generated method may hold; inside a lambda they are evaluated as they
    are, regular expressions compiled once, and the rest of the plan keeps its generated code.
    """
    one = F.array(F.struct(line.alias("line"), language.alias("language")))
    return F.get(F.transform(one, lambda x: _declared(x["line"], x["language"], profile)), 0)


def _declared(line: Column, language: Column, profile: str) -> Column:
    plain = _first(line, DEFAULT)
    for name in RULES if profile == "full" else LITE:
        plain = F.when(language == name, _first(line, RULES[name])).otherwise(plain)
    code = F.when(~line.rlike(COMMENT), plain)
    return F.when((language == "lua") & line.startswith("---"), F.coalesce(_first(line, ANNOTATIONS), code)).otherwise(code)
