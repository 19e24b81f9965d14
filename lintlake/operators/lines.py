"""Files to lines, contexts and sliding windows.

Arrays are built per file row: they are as large as one file, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import CONTEXT_LINES
from ..functions.text import split_lines

UNBATCHED_WINDOW = (0, 15)
LONG_TXN_WINDOW = (-2, 5)
SQL_PACK_WINDOW = (-4, 10)


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1; a trailing empty line counts."""
    return files.select(
        "file_path", *keep, F.posexplode(split_lines(F.col("content"))).alias("pos", "line")
    ).select("file_path", *keep, (F.col("pos") + 1).alias("line_number"), "line")


def context_before(n: str = "n", k: int = CONTEXT_LINES) -> str:
    """SQL: the k elements of ``lines`` before number n."""
    return f"slice(lines, greatest({n} - {k}, 1), {n} - greatest({n} - {k}, 1))"


def context_after(n: str = "n", k: int = CONTEXT_LINES) -> str:
    return f"slice(lines, {n} + 1, {k})"


def window_text(span: tuple[int, int], n: str = "n") -> str:
    """SQL: lines n+lo .. n+hi, clipped at the file, joined by newlines."""
    lo, hi = span
    start = f"greatest({n} + {lo}, 1)" if lo < 0 else f"({n} + {lo})"
    return f"array_join(slice(lines, {start}, {n} + {hi + 1} - {start}), '\\n')"


def _per_line(files: DataFrame, **fields: str) -> DataFrame:
    pairs = ", ".join(f"'{name}', {expr}" for name, expr in fields.items())
    return (
        files.select("file_path", split_lines(F.col("content")).alias("lines"))
        .select("file_path", F.expr(
            f"explode(transform(sequence(1, size(lines)), n -> named_struct({pairs})))").alias("x"))
        .select("file_path", "x.*")
    )


def line_context(files: DataFrame, k: int = CONTEXT_LINES) -> DataFrame:
    """Every line with the k lines before and after it."""
    return _per_line(files, line_number="n", line="element_at(lines, n)",
                     context_before=context_before("n", k), context_after=context_after("n", k))


def line_windows(files: DataFrame) -> DataFrame:
    """Every line with the three windows the rules look at."""
    return _per_line(files, line_number="n",
                     unbatched_window=window_text(UNBATCHED_WINDOW),
                     long_txn_window=window_text(LONG_TXN_WINDOW),
                     sql_pack_window=window_text(SQL_PACK_WINDOW))
