"""Languages by file extension, result kinds and their weights. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension

INCLUDED = (
    "ts tsx js jsx mjs cjs py lua java kt kts go rs cs cpp cxx cc c h hpp php rb swift dart vue svelte sh bash zsh ps1"
).split()

FULL = {
    "typescript": "ts",
    "typescriptreact": "tsx",
    "javascript": "js mjs cjs",
    "javascriptreact": "jsx",
    "python": "py",
    "lua": "lua",
    "java": "java",
    "kotlin": "kt kts",
    "go": "go",
    "rust": "rs",
    "csharp": "cs",
    "cpp": "cpp cxx cc c hpp h",
    "php": "php",
    "ruby": "rb",
    "swift": "swift",
    "dart": "dart",
    "vue": "vue",
    "svelte": "svelte",
    "shell": "sh bash zsh",
    "powershell": "ps1",
}
LITE = {"typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py", "lua": "lua", "go": "go", "rust": "rs", "cpp": "cpp cxx cc c hpp h"}

WEIGHTS = {"class": 600, "interface": 560, "type": 540, "function": 500, "file": 420, "text": 120}
KIND_ORDER = list(WEIGHTS)
SCOPES = {
    "all": KIND_ORDER,
    "symbols": ["class", "interface", "type", "function"],
    "classes": ["class", "interface", "type"],
    "functions": ["function"],
    "files": ["file"],
    "text": ["text"],
}
ALIASES = {"class": "classes", "symbol": "symbols", "function": "functions", "file": "files", "texts": "text"}


def scope(name: str) -> list[str]:
    """Kinds of a scope or its singular; anything unknown is all."""
    name = name.strip().lower()
    return SCOPES.get(ALIASES.get(name, name), SCOPES["all"])


def language(path: Column, profile: str = "full") -> Column:
    """The language of a path: the full map, or the lite one, where other extensions stand for themselves."""
    ext = F.substr(extension(path), F.lit(2))
    out = F.when(ext == "", "plaintext")
    for name, exts in (FULL if profile == "full" else LITE).items():
        out = out.when(ext.isin(exts.split()), name)
    return out.otherwise("plaintext" if profile == "full" else ext)


def included(path: Column) -> Column:
    return F.substr(extension(path), F.lit(2)).isin(INCLUDED)


def weight(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out
