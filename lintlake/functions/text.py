"""Text columns with the semantics of a Unicode-aware regex dialect.

Patterns in this package are written once, without inline flags.  ``rx`` and friends
add Java's flags so that case folding, ``\\s`` and ``\\w`` are Unicode and ``.`` stops
only at a newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?Ud)"
NOCASE = "(?iUd)"
NOCASE_DOTALL = "(?iUds)"


def quote(text: str) -> str:
    """A string as a SQL literal, for expressions that are built as one SQL text.

    Long conditions are written as SQL text: one parse instead of hundreds of column
    objects, each of which costs milliseconds on the driver.
    """
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def rx(col: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return col.rlike(NOCASE + pattern)


def rx_case(col: Column, pattern: str) -> Column:
    """Case-sensitive search."""
    return col.rlike(UNICODE + pattern)


def rx_dotall(col: Column, pattern: str) -> Column:
    """Case-insensitive search in which ``.`` crosses lines."""
    return col.rlike(NOCASE_DOTALL + pattern)


#: The characters of Unicode's White_Space property.
BLANKS = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends; linear, whatever stands between them."""
    return F.trim(col, F.lit(BLANKS))


def strip_sql(expr: str) -> str:
    return f"trim(BOTH {quote(BLANKS)} FROM {expr})"


def fold_sql(expr: str) -> str:
    return f"lower(translate({expr}, 'İıſK', 'iisk'))"


def is_blank(col: Column) -> Column:
    return F.length(strip(col)) == 0


def fold(col: Column) -> Column:
    """Lower case in which long s, the Kelvin sign and the dotted and dotless I are plain letters,
    as a case-insensitive regex takes them."""
    return F.lower(F.translate(col, "İıſK", "iisk"))


def normalise_newlines(col: Column) -> Column:
    return F.regexp_replace(col, "\r\n|\r", "\n")


def split_lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def replace_all(col: Column, search: str, replacement: str | Column) -> Column:
    """Literal replacement of every occurrence."""
    rep = replacement if isinstance(replacement, Column) else F.lit(replacement)
    return F.replace(col, F.lit(search), rep)


def code_hash(col: Column) -> Column:
    """SHA-256 of the UTF-8 text, as hex."""
    return F.sha2(col, 256)


def violation_id(file_path: Column, line_number: Column, violation_type: Column) -> Column:
    """Stable id; two types on one line stay apart."""
    return F.sha2(F.concat_ws("#", file_path, line_number.cast("string"), violation_type), 256)


def decode_source(data: Column, size: Column | None = None, max_kb: int | None = None,
                  marker: str | None = None) -> Column:
    """Bytes to text: UTF-8 when valid, else Latin-1; newlines normalised; missing data is ''.

    With ``max_kb`` a file of more bytes is cut to that many characters and marked.
    """
    from ..fixed import TRUNCATION_MARKER

    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(
        F.decode(data, "ISO-8859-1")
    )
    text = normalise_newlines(text)
    if max_kb is not None:
        limit = max_kb * 1024
        text = F.when(
            size > limit,
            F.concat(F.substring(text, 1, limit), F.lit(marker or TRUNCATION_MARKER)),
        ).otherwise(text)
    return F.coalesce(text, F.lit(""))


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo, folder) of a repository address; nulls when there is no owner/repo."""
    text = F.regexp_replace(strip(url), "/+$", "")
    text = F.regexp_replace(text, r"\.git$", "")
    text = replace_all(replace_all(text, "https://github.com/", ""), "http://github.com/", "")
    parts = F.split(text, "/", -1)
    n = F.size(parts)
    folder = F.when(
        (n > 4) & (F.get(parts, F.lit(2)) == "tree"),
        F.array_join(F.slice(parts, 5, F.greatest(n - 4, F.lit(0))), "/"),
    )
    return F.struct(
        F.when(n >= 2, F.get(parts, F.lit(0))).alias("owner"),
        F.when(n >= 2, F.get(parts, F.lit(1))).alias("repo"),
        F.when(n >= 2, folder).alias("folder"),
    )


def relative_path(path: Column, root: Column) -> Column:
    """Path with the root folder removed wherever it occurs."""
    return F.replace(F.replace(path, F.concat(root, F.lit("/")), F.lit("")), root, F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def whole_percent(fraction: Column) -> Column:
    """0.85 -> '85%', rounding half to even."""
    return F.concat(F.bround(fraction * 100, 0).cast("int").cast("string"), F.lit("%"))
