"""Checks of an output that block its delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.operators.identifiers import identifiers

ISSUE = "struct<code:string,severity:string,message:string>"
ISSUES = f"array<{ISSUE}>"
RATIO = (0.5, 1.1)


def _issue(code: str, message: Column, severity: str = "blocker") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def no_issues() -> Column:
    return F.expr(f"cast(array() as {ISSUES})")


def identifier_leaks(output: Column, private: bool = True) -> Column:
    """An issue for each identifier left in the output; ``private`` leaves its text out of the message."""
    what = (lambda s: F.lit("")) if private else (lambda s: F.concat(F.lit(" "), s["text"]))
    return F.transform(identifiers(output), lambda s: _issue("REGEX_LEAK", F.concat(F.lit("identifier left: "), s["type"], what(s), F.lit(" at "), s["start"].cast("string"))))


def length_ratio(source: Column, output: Column, low: float = RATIO[0], high: float = RATIO[1]) -> Column:
    r = F.try_divide(F.length(output), F.length(source))
    bad = (F.length(source) > 0) & ((r < low) | (r > high))
    return F.when(bad, F.array(_issue("LENGTH_RATIO", F.format_string(f"length ratio %.3f outside {low}..{high}", r)))).otherwise(no_issues())


def missing_placeholders(output: Column, expected: Column) -> Column:
    gone = F.filter(F.coalesce(expected, F.expr("cast(array() as array<string>)")), lambda p: (p != "") & ~F.contains(output, p))
    return F.transform(gone, lambda p: _issue("MISSING_PLACEHOLDER", F.concat(F.lit("placeholder missing: "), p)))


def part_changes(source_parts: Column, output_parts: Column) -> Column:
    """Parts of a package that are gone block; parts that are new warn. Null parts mean a package that cannot be read."""
    gone, new = F.sort_array(F.array_except(source_parts, output_parts)), F.sort_array(F.array_except(output_parts, source_parts))
    issues = F.concat(
        F.when(F.size(gone) > 0, F.array(_issue("DOCX_MISSING_PARTS", F.concat(F.lit("parts missing: "), F.array_join(gone, ", "))))).otherwise(no_issues()),
        F.when(F.size(new) > 0, F.array(_issue("DOCX_EXTRA_PARTS", F.concat(F.lit("parts added: "), F.array_join(new, ", ")), "warning"))).otherwise(no_issues()),
    )
    broken = F.array(_issue("DOCX_CORRUPT", F.lit("not a readable package")))
    return F.when(source_parts.isNull() | output_parts.isNull(), broken).otherwise(issues)


def passed(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == "blocker")


def text_issues(source: Column, output: Column, expected: Column) -> Column:
    found = F.concat(identifier_leaks(output), length_ratio(source, output), missing_placeholders(output, expected))
    return F.when(source.isNotNull() & output.isNotNull(), found).otherwise(no_issues())


def package_issues(source_parts: Column, output_parts: Column, source: Column, output: Column, expected: Column) -> Column:
    """Structure first; a broken structure ends the check."""
    structure = part_changes(source_parts, output_parts)
    return F.when(passed(structure), F.concat(structure, text_issues(source, output, expected))).otherwise(structure)


def report(docs: DataFrame, issues: str = "issues") -> DataFrame:
    """doc_id, code, severity, message of every issue."""
    # explode_outer: the optimiser would otherwise derive a filter from explode and work the issues out a second time for it
    return docs.select("doc_id", F.explode_outer(issues).alias("i")).where("i is not null").select("doc_id", "i.*")
