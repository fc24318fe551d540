"""Row-wise rules for names, clinical columns and validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and what they are written as.
ACCENTS, PLAIN = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def name_match(c: Column, names: Sequence[str], how: str) -> Column:
    """Whether a name is one of `names`: tight (the name, perhaps a space and a number of up to three digits without leading zero), loose (contains it) or start."""
    tests = {
        "tight": lambda n: c.rlike(rf"^\Q{n}\E( ?(0|[1-9][0-9]{{0,2}}))?$"),
        "loose": lambda n: c.contains(n),
        "start": lambda n: c.startswith(n),
    }
    return reduce(lambda a, b: a | b, [tests[how](n) for n in names], F.lit(False))


def last_rule(c: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The result of the last rule (part of a name, result) that fits."""
    out = otherwise
    for part, result in rules:
        out = F.when(c.contains(part), result).otherwise(out)
    return out


def subject_pid(last: Column, first: Column, birth: Column, prefix: str = "subj-") -> Column:
    """A pseudonym: names without accents, trimmed, in upper case, joined with the birth date by ^; first 8 digits of its SHA-256."""
    plain = lambda c: F.upper(F.trim(F.translate(F.lower(c), ACCENTS, PLAIN)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("^", plain(last), plain(first), F.date_format(birth, "yyyyMMdd")), 256), 1, 8))


def clean_text(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def flag(c: Column, positive: str = "yes") -> Column:
    """1 if the value equals the positive token, otherwise 0, also for null."""
    return F.when(c.eqNullSafe(F.lit(positive)), 1).otherwise(0)


def one_hot(df: DataFrame, c: str, levels: dict[str, str], reference: str | None = None) -> DataFrame:
    """A 0/1 column per level, named by `levels`; the reference level gets none."""
    return df.withColumns({name: flag(F.col(c), level) for level, name in levels.items() if level != reference})


def before_event(start: Column, event: Column, status: Column, earlier_status: str) -> Column:
    """1 if start is strictly before the event or the status says so; a missing time says nothing."""
    return F.when(F.coalesce(start < event, F.lit(False)) | status.eqNullSafe(F.lit(earlier_status)), 1).otherwise(0)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def nan_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    """Null and NaN become the sentinel; a column with a negative value keeps its nulls, since the sentinel would be ambiguous there."""
    signs = df.agg(*[F.coalesce(F.min(c) < 0, F.lit(False)).alias(c) for c in columns]).select(*[F.col(c).alias(f"__neg_{c}") for c in columns])
    filled = df.join(F.broadcast(signs)).withColumns({c: F.when((F.col(c).isNull() | F.isnan(c)) & ~F.col(f"__neg_{c}"), sentinel).otherwise(F.col(c)) for c in columns})
    return filled.drop(*[f"__neg_{c}" for c in columns])


def select_parameters(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


class Rule(NamedTuple):
    column: str
    name: str
    violated: Column


def in_range(c: str, low: float, high: float) -> Rule:
    return Rule(c, f"{low:g}..{high:g}", ~F.col(c).between(low, high))


def one_of(c: str, values: Sequence[str]) -> Rule:
    return Rule(c, "|".join(values), ~F.col(c).isin(*values))


def timestamp_text(c: str, form: str = "yyyy-MM-dd HH:mm:ss") -> Rule:
    return Rule(c, form, F.try_to_timestamp(F.col(c), F.lit(form)).isNull())


def validate_rules(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """key, column, rule, value: one row per violation; nulls are skipped."""
    found = [F.when(F.col(r.column).isNotNull() & r.violated, F.struct(F.lit(r.column).alias("column"), F.lit(r.name).alias("rule"), F.col(r.column).cast("string").alias("value"))) for r in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.column", "v.rule", "v.value")
