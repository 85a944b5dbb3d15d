"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def format_expression(s: Column, limit: int) -> Column:
    """Collapse white space; cut beyond ``limit``, at a token boundary if one lies in the last 40 %."""
    flat = collapse(s)
    cut = F.substring(flat, 1, limit - 1)
    bound = F.regexp_extract(cut, r"^(.*)[^\p{L}\p{N}_$]", 1)
    short = F.when(F.char_length(bound) >= 0.6 * (limit - 1), bound).otherwise(cut)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(short, F.lit("…")))


def words(s: Column) -> Column:
    """camelCase and snake_case to lower-case words."""
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "[_.#-]+", " ")))


def pascal(s: Column) -> Column:
    return F.array_join(F.transform(F.split(words(s), " "), lambda w: F.initcap(w)), "")


def camel(s: Column) -> Column:
    p = pascal(s)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))


def article(s: Column) -> Column:
    return F.when(s.rlike("(?i)^[aeiou]"), "an").otherwise("a")


def plural(s: Column) -> Column:
    return (
        F.when(s.rlike("[^aeiou]y$"), F.regexp_replace(s, "y$", "ies")).when(s.rlike("(s|x|z|ch|sh)$"), F.concat(s, F.lit("es"))).otherwise(F.concat(s, F.lit("s")))
    )


def singular(s: Column) -> Column:
    return (
        F.when(s.rlike("ies$"), F.regexp_replace(s, "ies$", "y"))
        .when(s.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(s, "es$", ""))
        .when(s.rlike("[^s]s$"), F.regexp_replace(s, "s$", ""))
        .otherwise(s)
    )


def feature_of(file: Column) -> Column:
    """Up to three directories after ``src``, else the folder."""
    parts = F.split(file, "/")
    at = F.array_position(parts, "src").cast("int")
    inner = F.slice(parts, at + 1, F.greatest(F.size(parts) - 1 - at, F.lit(1)))
    joined = F.array_join(F.slice(inner, 1, 3), "/")
    return F.when(joined == "", F.regexp_extract(file, "^(.*)/[^/]*$", 1)).otherwise(joined)


def source_family(root: Column) -> Column:
    return F.substring_index(root, ".", 2)


def fnv1a36(s: Column) -> Column:
    """FNV-1a over code points in 32 bits, in base 36.  Equal to the usual hash of UTF-16 units inside the basic plane."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    codes = F.filter(codes, lambda c: c > 0)
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def is_index(s: Column) -> Column:
    return s.rlike(r"^(0|[1-9]\d*)$")


def field_path(segments: Column) -> Column:
    """a.b["k"][0][*] from an array of (kind, value)."""
    def part(x: Column) -> Column:
        return (
            F.when(x["kind"] == "property", F.concat(F.lit("."), x["value"]))
            .when(x["kind"] == "index", F.concat(F.lit("["), x["value"], F.lit("]")))
            .when(x["kind"] == "any", F.lit("[*]"))
            .otherwise(F.concat(F.lit('["'), x["value"], F.lit('"]')))
        )

    return F.regexp_replace(F.array_join(F.transform(segments, part), ""), r"^\.", "")


def route_pattern(path: Column) -> Column:
    """File path to URL pattern: [id] is a parameter, [...rest] a tail, (group) and index vanish."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*routes/", "/"), r"\.(tsx|ts|jsx|js)$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"/\([^/]*\)", ""), r"/index$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"\[\.\.\.([^\]]+)\]", "*$1"), r"\[([^\]]+)\]", ":$1")
    return F.when(stem == "", "/").otherwise(stem)


def glob_regex(glob: str) -> str:
    """``**`` any folders, ``*`` within a folder, ``?`` one character; a plain folder stands for all below it; a suffix at a slash counts."""
    import re

    if not any(c in glob for c in "*?") and "." not in glob.rsplit("/", 1)[-1]:
        glob = glob.rstrip("/") + "/**"
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"^(?:.*/)?{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def delta_label(before: Column, after: Column) -> Column:
    return F.when(F.abs(after - before) < 0.001, "same").when(after < before, "improved").otherwise("regressed")


def shell_quote(s: Column) -> Column:
    return F.when(s.rlike(r"^[A-Za-z0-9_./:=@-]+$"), s).otherwise(F.concat(F.lit("'"), F.regexp_replace(s, "'", r"'\\''"), F.lit("'")))


def positive_limit(value: Column, fallback: int | float) -> Column:
    """FN-30: a limit of at least 1, rounded down; the fallback for null, non-finite and smaller values."""
    usable = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf")) & (value >= 1)
    return F.when(usable, F.floor(value)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(fallback)))).cast("long")
