"""Text expressions: segments, categories, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category patterns for the test corpus, first match wins; real deployments pass their own lists.
CORPUS_CATEGORIES = [("FILTER", r"(%%%|\$\$\$|!!)"), ("ACTIVITY", r"(\+[0-9]|@)"), ("EUPHORIA", r"(^| )(the|les|der) ")]


def segments(c: Column, separator: str = "\n\n+", shortest: int = 20, most: int = 20) -> Column:
    """Trimmed pieces between separators that are long enough, the first ``most``."""
    return F.slice(F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: F.length(x) >= shortest), 1, most)


def category(c: Column, patterns: list[tuple[str, str]], default: str = "STANDARD") -> Column:
    """The first category whose pattern occurs."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def category_sql(column: str, patterns: list[tuple[str, str]], default: str = "STANDARD") -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in patterns)
    return f"CASE {cases} ELSE '{default}' END"


def squeeze(c: Column) -> Column:
    """White-space runs as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))
