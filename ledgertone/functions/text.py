"""Folding, identifiers, paths and labels: pure column expressions."""

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() removes, and the same set as a regex class body.
WIDE_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + WIDE_SPACE
SPACE_CLASS = r"\s\x1c-\x1f" + WIDE_SPACE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    return F.btrim(text(c), F.lit(SPACE))


@lru_cache(maxsize=1)
def _compat_tables() -> tuple[str, str, dict[str, str]]:
    """ASCII parts of compatibility decompositions: accented Latin letters, and all others."""
    one, many = {}, {}
    for lo, hi in ((0x80, 0x3400), (0xA640, 0xAC00), (0xF900, 0x20000)):
        for ch in map(chr, range(lo, hi)):
            ascii_part = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
            latin = ord(ch) < 0x250 or unicodedata.name(ch, "").startswith("LATIN")
            if len(ascii_part) == 1 and latin:
                one[ch] = ascii_part
            elif ascii_part:
                many[ch] = ascii_part
    return "".join(one), "".join(one.values()), many


@lru_cache(maxsize=1)
def _rare_class() -> str:
    """A character class around the letters of the long table, as a few wide ranges."""
    codes = sorted(map(ord, _compat_tables()[2]))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= 256 and code > 0x2100 or code - ranges[-1][1] <= 32:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def ascii_fold(c) -> Column:
    """Compatibility decomposition with everything outside ASCII dropped.

    Dropping the combining marks makes the decomposition letter-wise, so a translate table is
    exact for accented Latin; rarer letters and longer expansions take a per-letter lookup.
    Plain ASCII text, the common case, passes through untouched.
    """
    c = text(c)
    src, dst, many = _compat_tables()
    non_ascii = r"[^\x00-\x7F]+"
    simple = F.regexp_replace(F.translate(c, src, dst), non_ascii, "")
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(table[ch], ch)), "")
    spelled = F.regexp_replace(F.translate(spelled, src, dst), non_ascii, "")
    return (
        F.when(~c.rlike(non_ascii), c)
        .when(c.rlike(_rare_class()), spelled)
        .otherwise(simple)
        .alias("ascii_fold")
    )


def normalize_component(c) -> Column:
    spelled = F.replace(F.lower(ascii_fold(c)), F.lit("+"), F.lit("_plus_"))
    return F.btrim(F.regexp_replace(spelled, "[^a-z0-9]+", "_"), F.lit("_")).alias("normalize_component")


def nonlatin_digest(c) -> Column:
    return F.concat(F.lit("x"), F.substring(F.sha1(F.encode(text(c), "UTF-8")), 1, 6))


def build_id(brand, model, variant) -> Column:
    def part(c):
        norm = normalize_component(c)
        return F.when(norm != "", norm).when(strip(c) != "", nonlatin_digest(c))

    return F.concat_ws("_", part(brand), part(model), part(variant)).alias("build_id")


def brand_fold(c) -> Column:
    return F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "").alias("brand_fold")


def fold_ascii(c) -> Column:
    return F.lower(ascii_fold(c)).alias("fold_ascii")


def alpha_core(c) -> Column:
    return F.regexp_replace(fold_ascii(c), "[^a-z]+", "").alias("alpha_core")


def normalize_path(c) -> Column:
    c = F.replace(text(c), F.lit("\\"), F.lit("/"))
    c = F.regexp_replace(strip(c), "/+", "/")
    return F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"/\./", "/")


def safe_path(c) -> Column:
    """Relative, non-blank and free of parent segments."""
    c = strip(F.replace(text(c), F.lit("\\"), F.lit("/")))
    return (
        (c != "") & ~c.startswith("/") & ~c.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(c, "/"), "..")
    )


def tidy_path(c) -> Column:
    """The segments of a safe path without blanks and dots."""
    parts = F.split(F.replace(text(c), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")


def guard_paths(df, path: str):
    """(valid, rejected) rows by ``safe_path``."""
    ok = safe_path(path)
    return df.where(ok).withColumn(path, tidy_path(strip(path))), df.where(~ok)


def sanitize_filename(c) -> Column:
    c = strip(F.regexp_replace(text(c), r'[<>:"/\\|?*\x00-\x1f]', ""))
    c = F.regexp_replace(c, f"[{SPACE_CLASS}]+", " ")
    return F.when(c.isin("", ".", ".."), F.lit("curve.txt")).otherwise(c)


def target_path(sub, name) -> Column:
    """``data/SUB/NAME.txt`` with every segment sanitized and upper-cased."""
    segments = F.transform(
        F.filter(F.split(strip(sub), "/"), lambda s: strip(s) != ""),
        lambda s: F.upper(strip(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', ""))),
    )
    stem = F.upper(F.regexp_replace(sanitize_filename(strip(name)), r"(?<=[^.])\.[^.]*$", ""))
    return F.concat_ws(
        "/", F.lit("data"), F.filter(segments, lambda s: s != ""), F.concat(stem, F.lit(".txt"))
    )


def entry_label(brand, model, variant, fallback=None) -> Column:
    """``Brand Model  [Variant]``, or the fallback (an id) when all are blank."""
    base = strip(F.concat_ws(" ", F.nullif(text(brand), F.lit("")), F.nullif(text(model), F.lit(""))))
    v = strip(variant)
    label = (
        F.when((v != "") & (base != ""), F.concat(base, F.lit("  ["), v, F.lit("]")))
        .when(v != "", v)
        .otherwise(base)
    )
    if fallback is not None:
        rest = F.when(text(fallback) != "", text(fallback)).otherwise(F.lit("(unnamed entry)"))
        label = F.when(label == "", rest).otherwise(label)
    return label


def is_curve_file(c) -> Column:
    return F.lower(text(c)).rlike(r"\.(txt|csv)$")
