"""Scalar text functions. Each takes a column and returns a column, so all of
them stay inside the JVM and inside whole-stage code generation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Unicode White_Space, spelled out: Java's \s is ASCII only, and this spelling
# is understood by Java and RE2 alike.
WHITESPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# the same characters themselves, for Spark's trim
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROL_CHARS = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
SANITIZE_KEEP = r"가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9.,!?;:()\"'\-\[\]<>+_"
CLEAN_KEEP = r"가-힣\x{3131}-\x{318E}\x20-\x7E\t\n\r"
# what `sanitize` drops, in the parts that Java's classes test fast: single ASCII characters,
# and one range that all other ASCII characters fail before the long list is looked at
SANITIZE_SYMBOLS = r"#$%&*/=@\\\^`{|}~"
# ASCII without digits and letters, one by one
COMPACT_DROP = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum())
BEYOND_ASCII = r"\x{80}-\x{10FFFF}"
SCRUB_KEEP = r"가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9"

CATEGORY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("PLAN", ("계획", "기획")),
    ("REPORT", ("보고", "결과")),
    ("RULE", ("규정", "지침", "가이드", "법규")),
)
CATEGORY_DEFAULT = "OTHERS"
CATEGORY_ALIASES = {
    "사업계획서": "PLAN",
    "결과보고서": "REPORT",
    "사내규정": "RULE",
    "기타": "OTHERS",
    "OTHER": "OTHERS",
}
FORBIDDEN_SQL = (
    ";", "insert ", "update ", "delete ", "drop ", "alter ", "truncate ",
    "create ", "grant ", "revoke ", "execute ", "call ",
)
# ------------------------------------------------------------------------------


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lit_of(value) -> Column:
    """A parameter that may be a plain value or already a column."""
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column | str) -> Column:
    """Trim every Unicode white-space character (Spark's trim knows U+0020 only)."""
    return F.regexp_replace(col_of(col), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def blank(col: Column | str) -> Column:
    return strip(F.coalesce(col_of(col), F.lit(""))) == ""


def sanitize(col: Column | str) -> Column:
    """Control characters become spaces, characters off the allow-list go, runs
    of spaces collapse, ends are stripped. Null gives the empty string."""
    text = F.regexp_replace(F.coalesce(col_of(col), F.lit("")), f"[{CONTROL_CHARS}]", " ")
    text = F.regexp_replace(text, f"[{SANITIZE_SYMBOLS}]", "")
    text = F.regexp_replace(text, f"[{BEYOND_ASCII}&&[^{SANITIZE_KEEP}{WHITESPACE}]]", "")
    return F.trim(F.regexp_replace(text, "  +", " "), F.lit(SPACES))


def clean_text(col: Column | str) -> Column:
    """Keep Hangul syllables and jamo, printable ASCII, tab, LF and CR."""
    return F.regexp_replace(col_of(col), f"[^{CLEAN_KEEP}]", "")


def scrub_query(col: Column | str) -> Column:
    """Letters, digits and white space only."""
    return F.regexp_replace(col_of(col), f"[^{SCRUB_KEEP}{WHITESPACE}]", "")


def valid_utf8(col: Column | str) -> Column:
    """Text of a string or binary column without its malformed byte sequences."""
    raw = col_of(col).cast("string")
    fixed = F.regexp_replace(F.make_valid_utf8(raw), "�", "")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.coalesce(fixed, F.lit("")))


def sanitize_typed(col: Column, dtype: T.DataType) -> Column:
    """`sanitize` pushed down through arrays, maps and structs."""
    if isinstance(dtype, T.StringType):
        return F.when(col.isNotNull(), sanitize(col))
    if isinstance(dtype, T.BinaryType):
        return F.when(col.isNotNull(), sanitize(valid_utf8(col)))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
        return F.when(bad, F.lit(0.0).cast(dtype)).otherwise(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: sanitize_typed(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: sanitize_typed(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [sanitize_typed(col[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        return col
    return sanitize(col.cast("string"))


def sanitize_record(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sanitise every (or every named) column of a frame, following its schema."""
    wanted = set(columns or df.columns)
    return df.select(*[
        sanitize_typed(F.col(f.name), f.dataType).alias(f.name) if f.name in wanted
        else F.col(f.name)
        for f in df.schema
    ])


def content_digest(text: Column | str, filename: Column | str) -> Column:
    """SHA-256 over the letters and digits of the first 500 characters; the file
    name stands in where those hold none."""
    def core(c: Column) -> Column:
        return F.regexp_replace(c, "[^가-힣a-zA-Z0-9]", "")
    head = core(F.substring(F.coalesce(col_of(text), F.lit("")), 1, 500))
    name = core(F.coalesce(col_of(filename), F.lit("")))
    return F.sha2(let(head, lambda h: F.when(h != "", h).otherwise(name)), 256)


def byte_digest(content: Column | str) -> Column:
    return F.sha2(col_of(content), 256)


def map_category(name: Column | str, rules=CATEGORY_RULES, default: str = CATEGORY_DEFAULT) -> Column:
    """Category of a file name: the first rule with a keyword in the name wins."""
    name = col_of(name)
    out = F.lit(default)
    for category, words in reversed(rules):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        out = F.when(hit, F.lit(category)).otherwise(out)
    return out


def normalize_category(col: Column | str) -> Column:
    value = F.upper(strip(F.coalesce(col_of(col), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    return let(value, lambda v: F.coalesce(F.element_at(known, v), v))


def normalize_ext(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(col_of(col), F.lit("")))), r"^\.+", "")


def ext_for_stats(col: Column | str) -> Column:
    ext = normalize_ext(col)
    return F.when(ext == "", F.lit("unknown")).otherwise(ext)


def ext_of(filename: Column | str) -> Column:
    name = col_of(filename)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def compact(col: Column | str) -> Column:
    """Lower case, Hangul syllables and ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col_of(col), F.lit(""))), f"[{COMPACT_DROP}]+|[{BEYOND_ASCII}&&[^가-힣]]+", "")


def token_set(col: Column | str) -> Column:
    """Distinct lower-case white-space tokens of two or more characters."""
    parts = F.split(F.lower(F.coalesce(col_of(col), F.lit(""))), f"[{WHITESPACE}]+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def windows_of(col: Column, n: int) -> Column:
    """All n-character windows of a string in order, in one linear pass."""
    # the dot behind the look-ahead moves on by one character, also beyond the BMP
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def char_ngrams(col: Column | str, n: int = 2) -> Column:
    """Distinct n-grams of the compact form; a shorter form is its own gram."""
    body = compact(col)
    return (
        F.when(F.length(body) >= n, F.array_distinct(windows_of(body, n)))
        .when(F.length(body) > 0, F.array(body))
        .otherwise(F.array().cast("array<string>"))
    )


def preview(col: Column | str, n: int = 120, ellipsis: str = "") -> Column:
    text = F.coalesce(col_of(col), F.lit(""))
    return F.concat(F.substring(text, 1, n), F.lit(ellipsis))


def audit_sql(col: Column | str) -> Column:
    """Struct(ok, reason) for a source query: one comment-free SELECT without any
    of the forbidden fragments."""
    bad = "|".join(re.escape(token) for token in FORBIDDEN_SQL)

    def verdict(bare: Column) -> Column:
        reason = (
            F.when(bare == "", "empty")
            .when(~bare.startswith("select"), "not_select")
            .when(bare.rlike(bad), "forbidden")
            .otherwise("ok")
        )
        return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))

    bare = F.regexp_replace(strip(F.coalesce(col_of(col), F.lit(""))), r"(?md)--.*?$", "")
    return let(F.lower(strip(bare)), verdict)
