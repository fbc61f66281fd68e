"""Protecting spans, replacing by rules, counting and locating occurrences; rules are plan-time literals applied in order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    src: str
    dst: str = ""
    regex: bool = False
    case_sensitive: bool = True
    enabled: bool = True

    @property
    def pattern(self) -> str:
        body = self.src if self.regex else r"\Q" + self.src.replace(r"\E", r"\E\\E\Q") + r"\E"
        return body if self.case_sensitive else f"(?i){body}"

    @property
    def replacement(self) -> str:
        """Groups are $1 or ${1}; a literal rule's target is taken as it is."""
        if self.regex:
            return re.sub(r"\$\{(\d+)\}", r"$\1", self.dst).replace("$$", r"\$")
        return self.dst.replace("\\", "\\\\").replace("$", r"\$")


def issues(rules: list[Rule]) -> list[tuple[int, str]]:
    """(rule's place, code) for empty sources and targets, repeated sources, and patterns that don't compile."""
    out, seen = [], set()
    for i, r in enumerate(rules):
        if not r.src:
            out.append((i, "empty_src"))
        if not r.dst:
            out.append((i, "empty_dst"))
        if r.src in seen:
            out.append((i, "duplicate_src"))
        seen.add(r.src)
        if r.regex:
            try:
                re.compile(r.src)
            except re.error:
                out.append((i, "regex_error"))
    return out


def usable(rules: list[Rule]) -> list[Rule]:
    bad = {i for i, code in issues(rules) if code in ("empty_src", "regex_error")}
    return [r for i, r in enumerate(rules) if i not in bad and r.enabled]


def replaced(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """Apply the rules one after another: the new column <column>_new and replacements, how often each rule matched."""
    df = df.withColumn(f"{column}_new", F.col(column))
    counts = []
    for i, r in enumerate(usable(rules)):
        df = df.withColumns({f"_c{i}": F.regexp_count(f"{column}_new", F.lit(r.pattern)).cast("long"), f"{column}_new": F.regexp_replace(f"{column}_new", r.pattern, r.replacement)})
        counts.append(F.coalesce(F.col(f"_c{i}"), F.lit(0)))
    total = F.array(*counts) if counts else F.array().cast("array<bigint>")
    return df.withColumn("replacements", total).drop(*[f"_c{i}" for i in range(len(counts))])


def occurrences(df: DataFrame, column: str, rule: Rule, before: int = 45, after: int = 65, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an occurrence: kept columns, n, at (0-based), match, before and after context. Found by splitting at the pattern, in the JVM."""
    hits = F.regexp_extract_all(column, F.lit(f"({rule.pattern})"), 1)
    parts = F.split(F.col(column), rule.pattern)
    rows = df.select(*keep, F.col(column).alias("_t"), parts.alias("_p"), hits.alias("_h")).where(F.size("_h") > 0)
    lengths = F.transform(F.sequence(F.lit(1), F.size("_h")), lambda i: F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0), lambda s, x: s + F.char_length(x)) + F.aggregate(F.slice("_h", F.lit(1), i - 1), F.lit(0), lambda s, x: s + F.char_length(x)))
    rows = rows.select(*keep, "_t", F.posexplode(F.arrays_zip(F.col("_h").alias("m"), lengths.alias("at"))).alias("n", "x"))
    end = F.col("x.at") + F.char_length("x.m")
    return rows.select(
        *keep, F.col("n").cast("long"), F.col("x.at").cast("long").alias("at"), F.col("x.m").alias("match"),
        F.substr("_t", F.greatest(F.col("x.at") - before, F.lit(0)) + 1, F.least(F.col("x.at"), F.lit(before))).alias("before"), F.substr("_t", end + 1, F.lit(after)).alias("after"),
    )


SENTINEL = "⟦[0-9]+⟧"


def masked(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Protected spans replaced by numbered sentinels: <column>_masked and spans. Patterns match in turn, at each place the earlier first.

    What looks like a sentinel in the text itself is protected as well, so every sentinel of the masked text is one of ours.
    """
    union = "|".join(f"(?:{p})" for p in [SENTINEL, *patterns])
    spans = F.regexp_extract_all(column, F.lit(f"({union})"), 1)
    parts = F.split(F.col(column), union)
    rest = F.transform(F.sequence(F.lit(1), F.size(spans)), lambda i: F.concat(F.lit("⟦"), (i - 1).cast("string"), F.lit("⟧"), F.element_at(parts, i + 1)))
    text = F.when(F.size(spans) == 0, F.col(column)).otherwise(F.concat(F.element_at(parts, 1), F.array_join(rest, "")))
    return df.withColumns({f"{column}_masked": text, "spans": spans})


def restored(text: Column, spans: Column) -> Column:
    """Sentinels back to their spans, all in one pass: what a span holds isn't looked at again, and unknown numbers stay."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)({SENTINEL}|(?:(?!{SENTINEL}).)+)"), F.lit(1))
    number = lambda p: F.regexp_extract(p, "^⟦([0-9]{1,9})⟧$", 1)
    back = F.transform(parts, lambda p: F.when(number(p) == "", p).otherwise(F.coalesce(F.get(spans, F.nullif(number(p), F.lit("")).cast("int")), p)))
    return F.when(text.isNotNull(), F.array_join(back, ""))
