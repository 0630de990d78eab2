"""Which paths are indexed: excluded directories and suffixes, ignore rules of both profiles, globs. Rules become columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename

#: The index's own folder.
OWN = ".seekframe"

# Directories that the lite profile and the watcher leave out, at any depth.
LITE_DIRECTORIES = (
    f".git {OWN} node_modules dist build coverage .next .turbo .cache .venv venv __pycache__ "
    ".pytest_cache .mypy_cache .ruff_cache assets resources static images textures audio video logs tmp "
    "temp vendor generated site-packages _vendor .tox openpyxl lxml numpy pandas matplotlib scipy "
    "requests pkg_resources setuptools pytest dateutil luac unpack"
).split()
# The full profile's directories and name endings.
FULL_DIRECTORIES = (
    f"node_modules .git {OWN} dist build coverage .next .turbo .cache .venv venv __pycache__ .pytest_cache .mypy_cache "
    ".ruff_cache site-packages _vendor .tox luac unpack vendor generated"
).split()
FULL_SUFFIXES = (
    "pyc pyo luac bin dat fbx obj png jpg jpeg gif bmp tga dds hdr tiff ico svg wav mp3 ogg flac mp4 avi mov webm "
    "zip gz tar 7z rar min.js min.css"
).split()
WATCH_DIRECTORIES = LITE_DIRECTORIES


def segments(path: Column) -> Column:
    return F.split(path, "/")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def rules(lines: list[str]) -> list[str]:
    """Ignore-file lines without comments, blanks and negations."""
    out = [re.sub(r"#.*$", "", x).strip().replace("\\", "/") for x in lines]
    return [x for x in out if x and not x.startswith("!")]


def lite_excluded(path: Column) -> Column:
    """In an excluded directory (the file's own name doesn't count)."""
    return F.arrays_overlap(F.slice(segments(path), 1, F.greatest(F.size(segments(path)) - 1, F.lit(0))), F.array(*map(F.lit, LITE_DIRECTORIES)))


def lite_ignored(path: Column, lines: list[str]) -> Column:
    """Literal rules from the root: ``p/`` and what is below, or an equal path, its children, or an equal base name."""
    out = []
    for rule in rules(lines):
        rule = rule.removeprefix("/")
        if rule.endswith("/"):
            out += [path == rule[:-1], path.startswith(rule)]
        elif rule:
            out += [path == rule, path.startswith(rule + "/"), basename(path) == rule]
    return any_of(out)


def to_globs(lines: list[str]) -> list[str]:
    """The full profile's reading of ignore rules as globs."""
    out = []
    for rule in rules(lines):
        rule = rule.removeprefix("/")
        wild = "*" in rule or "?" in rule
        if rule.endswith("/"):
            out.append(f"**/{rule[:-1]}/**")
        elif "/" not in rule:
            out.append(f"**/{rule}" if wild else f"**/{rule}/**")
        else:
            out.append(rule)
    return out


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ``**/``, ``**``, ``*`` and ``?`` are wild, all else is literal."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether one of the globs matches; whole-directory and suffix globs are plain tests of segments and of the name's end."""
    names, suffixes, other = [], [], []
    for g in globs:
        if m := re.fullmatch(r"\*\*/([^/*?]+)(/\*\*)?", g):
            names.append(m[1])
        elif m := re.fullmatch(r"\*\*/\*(\.[^/*?]+)", g):
            suffixes.append(m[1].lower())
        else:
            other.append(path.rlike(glob_pattern(g)))
    if names:
        other.append(F.arrays_overlap(segments(path), F.array(*map(F.lit, names))))
    other += [F.lower(path).endswith(s) for s in suffixes]
    return any_of(other)


def full_globs(lines: list[str] = ()) -> list[str]:
    """The full profile's default globs and those of an ignore file."""
    return [f"**/{d}/**" for d in FULL_DIRECTORIES] + [f"**/*.{s}" for s in FULL_SUFFIXES] + to_globs(list(lines))


def watch_excluded(path: Column) -> Column:
    """The watcher's test: an excluded directory as any segment, in either case."""
    return path.rlike("(?i)(^|/)(" + "|".join(map(re.escape, WATCH_DIRECTORIES)) + ")(/|$)")


def indexed(path: Column, profile: str = "full", lines: list[str] = ()) -> Column:
    """Whether a path is indexed at all."""
    from ..functions.languages import included

    out = matches_globs(path, full_globs(lines)) if profile == "full" else lite_excluded(path) | lite_ignored(path, list(lines))
    return included(path) & ~out & (path != "") & ~path.startswith("..")
