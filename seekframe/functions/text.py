"""String columns of the index: white space, path parts, search forms, previews, shards.

Deviation: lengths and positions count code points, not UTF-16 units (they differ for characters above U+FFFF only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond ASCII's, as the engine's patterns spell it.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
SEP = f"(?:{WS}|[._/-])+"
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PREVIEW, PREVIEW_HEAD, SIGNATURE, SHARDS = 96, 93, 240, 64


def trim(c: Column) -> Column:
    """White space off both ends, Unicode's too."""
    return F.btrim(c, F.lit(BLANKS))


def basename(c: Column) -> Column:
    """The last path component; slashes at the end don't count."""
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), "[^/]*$", 0)


def stem(base: Column) -> Column:
    """A base name without its last extension; a dot at the start is none."""
    return F.when(base == "..", base).otherwise(F.regexp_replace(base, "^(.+)\\.[^.]*$", "$1"))


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty if there is none."""
    base = basename(path)
    return F.when(base == "..", "").otherwise(F.lower(F.regexp_extract(base, "^.+(\\.[^.]*)$", 1)))


def separated(c: Column) -> Column:
    """Lower case, each run of separators a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), SEP, "-"), "^-+|-+$", "")


def compact(c: Column) -> Column:
    """Lower case without separators."""
    return F.regexp_replace(F.lower(c), SEP, "")


def prepared(c: Column) -> dict[str, Column]:
    """The six search forms of a text."""
    lower = F.lower(c)
    base = basename(lower)
    return {"normalized": lower, "separated": separated(c), "compact": compact(c), "base": base, "stem": stem(base), "sep_base": separated(base)}


def preview(c: Column) -> Column:
    """Trimmed; over 96 characters the first 93 and three dots."""
    t = trim(c)
    return F.when(F.length(t) > PREVIEW, F.concat(F.substring(t, 1, PREVIEW_HEAD), F.lit("..."))).otherwise(t)


def indent(c: Column) -> Column:
    """Characters before the first that isn't white space; all of a blank line."""
    return F.length(c) - F.length(F.ltrim(c, F.lit(BLANKS)))


def string_hash(c: Column) -> Column:
    """The 32-bit hash h = 31 h + unit of a string, as a long."""
    return F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), c).cast("long")


def shard(path: Column) -> Column:
    """One of 64 shards of a path."""
    return (F.abs(string_hash(path)) % SHARDS).cast("int")


def slashes(path: Column, root: str = "") -> Column:
    """Forward slashes, without the file scheme and the root."""
    p = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "\\\\", "/")
    if not root:
        return p
    lead = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(lead), F.substr(p, F.lit(len(lead) + 1))).otherwise(p)
