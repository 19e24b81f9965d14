"""Language, platform and severity of files and findings, as SQL expressions.

All functions take SQL expressions (usually column names) and return a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (
    CSHARP, EDB_YUGABYTE, EXTENSION_LANGUAGE, HIGH, JAVA, MONGODB, MSSQL, ORACLE, PYTHON,
    SEVERITY_OF_TYPE, SQL,
)

# lower-cased suffix of the last path part; a leading or trailing dot makes none
_SUFFIX = r"lower(regexp_extract(element_at(split({path}, '/'), -1), '.(\\.[^.]+)$', 1))"


def route_language(path: str = "file_path") -> Column:
    """Language that decides which detectors see a file; null when not scanned."""
    whens = " ".join(f"WHEN '{ext}' THEN '{lang}'" for ext, lang in EXTENSION_LANGUAGE.items())
    return F.expr(f"CASE {_SUFFIX.format(path=path)} {whens} END")


def _by_exact_suffix(path: str, xml: str) -> Column:
    return F.expr(
        f"CASE WHEN endswith({path}, '.cs') THEN '{CSHARP}' WHEN endswith({path}, '.java') THEN '{JAVA}' "
        f"WHEN endswith({path}, '.py') THEN '{PYTHON}' WHEN endswith({path}, '.xml') THEN '{xml}' "
        f"ELSE '{SQL}' END"
    )


def rule_language(path: str = "file_path") -> Column:
    """Language used inside rules: the suffix is matched case-sensitively, the rest is SQL."""
    return _by_exact_suffix(path, SQL)


def concat_language(path: str = "file_path") -> Column:
    """As ``rule_language``, but mapper XML counts as Java."""
    return _by_exact_suffix(path, JAVA)


def _holds(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def platform(text: str = "lower(content)", path: str = "file_path", variant: str = "base") -> Column:
    """Database platform from hints in the lower-cased file text.

    ``select`` also accepts the word oracle in the path, ``longtxn`` ignores pymongo.
    """
    mongo = _holds(text, "mongoclient") if variant == "longtxn" else _holds(text, "mongoclient", "pymongo")
    oracle = _holds(text, "oracleconnection", "cx_oracle")
    if variant == "select":
        oracle += f" OR contains(lower({path}), 'oracle')"
    return F.expr(
        f"CASE WHEN {mongo} THEN '{MONGODB}' WHEN {oracle} THEN '{ORACLE}' "
        f"WHEN {_holds(text, 'yugabyte', 'npgsql')} THEN '{EDB_YUGABYTE}' ELSE '{MSSQL}' END"
    )


def is_mongo_file(text: str = "lower(content)", path: str = "file_path") -> Column:
    return F.expr(f"{_holds(text, 'mongoclient', 'pymongo')} OR contains(lower({path}), 'mongo')")


def severity(violation_type: str = "violation_type") -> Column:
    whens = " ".join(f"WHEN '{name}' THEN '{level}'" for name, level in SEVERITY_OF_TYPE.items())
    return F.expr(f"CASE {violation_type} {whens} ELSE '{HIGH}' END")
