"""Hashes, identifiers and seeded ranks; parts are joined by NUL before they are hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha(x: str | Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(_col(x), 256)


def joined_sha(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by NUL; null if any part is, never silently skipped."""
    out = []
    for i, p in enumerate(parts):
        out += [F.lit(NUL)] * (i > 0) + [_col(p).cast("string")]
    return sha(F.concat(*out))


def json_or_null(x: str | Column) -> Column:
    """A nullable text as JSON: null, or quoted."""
    c = _col(x)
    plain = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def seeded_rank(seed: int | str, *parts: str | Column) -> Column:
    """The text by which rows are ranked in seeded, repeatable choices."""
    return joined_sha(F.lit(str(seed)), *parts)


def family_id(ast: str | Column) -> Column:
    return F.concat(F.lit("family-"), sha(ast))


def style_id(style: str | Column) -> Column:
    return F.concat(F.lit("style-"), sha(style))


def code_id(spec: str | Column, style: str | Column, rewrite: str | Column, code: str | Column) -> Column:
    return F.concat(F.lit("code-"), joined_sha(spec, style, json_or_null(rewrite), code))


def record_id(code: str | Column, instruction: str | Column, suite: str | Column, tests: str | Column) -> Column:
    """``tests`` is the JSON text of the tests."""
    return F.concat(F.lit("record-"), joined_sha(code, instruction, json_or_null(suite), tests))


def short_id(x: str | Column, n: int = 16) -> Column:
    return F.substring(sha(x), 1, n)


def unit_interval(x: str | Column) -> Column:
    """A text's hash as a number in [0, 1)."""
    return F.conv(F.substring(sha(x), 1, 8), 16, 10).cast("double") / 2**32
