"""Loading tab-separated lines, with the reason for each line that cannot be loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import let, strip

# The reasons, in the order in which they apply.
REASONS = ["quoting", "column_count", "invalid_value"]
_GAP = r"[\s\p{Z}\x{0085}\x{001c}-\x{001f}&&[^\t]]*+"
#: Stands for a tab inside quotes while a line is split; ESCAPE itself is doubled with "a", so no text can be mistaken for it.
_ESC, _ESC_SELF, _ESC_TAB = "\u0001", "\u0001a", "\u0001b"


def _quoting_ok(parts: Column) -> Column:
    """parts: the line split at double quotes. Parts 0, 2, 4... are outside quotes or, when empty between two, a doubled quote."""
    n = F.size(parts)
    inner = F.filter(parts, lambda p, i: (i % 2 == 0) & (i > 0) & (i < n - 1))
    return (n == 1) | (
        (n % 2 == 1)
        & F.element_at(parts, 1).rlike(rf"\A(?s:.*\t)?{_GAP}\z")
        & F.element_at(parts, -1).rlike(rf"\A{_GAP}(?:\t(?s:.*))?\z")
        & F.forall(inner, lambda p: (p == "") | p.rlike(rf"\A{_GAP}\t(?:(?s:.*)\t)?{_GAP}\z"))
    )


def _fields(line: Column) -> Column:
    """The fields of a line whose quoting is right, without quotes and outer white space."""
    parts = F.transform(
        F.split(F.replace(line, F.lit(_ESC), F.lit(_ESC_SELF)), '"', -1),
        lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\t"), F.lit(_ESC_TAB))).otherwise(p),
    )

    def value(bare: Column) -> Column:
        bare = F.when(bare.startswith('"'), strip(F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')))).otherwise(bare)
        return F.replace(F.replace(bare, F.lit(_ESC_TAB), F.lit("\t")), F.lit(_ESC_SELF), F.lit(_ESC))

    return F.transform(F.transform(F.split(F.array_join(parts, '"'), "\t", -1), strip), value)


def classify_lines(df: DataFrame, line: str, kinds: DataFrame, columns: tuple[str, str, str] = ("e1", "r", "e2"), kind: str = "r") -> DataFrame:
    """df with the struct columns' values and reason: null for a valid row, else quoting, column_count or invalid_value.

    The lines are first read permissively under the explicit schema (three strings) with the raw text of corrupt rows kept.
    What that reader accepts is taken if the line has neither a double quote nor a control character; all else, and every corrupt
    row, is classified again: by the quote rule (a field has no double quote or is wholly enclosed in them), by the number of
    fields, and by casting the values. A value e1 or e2 is invalid if it has no letter, is a path starting with / or m/, or
    holds a control character other than tab or a replacement character; r if it is not in kinds.kind.
    Null and blank lines and lines starting with # are left out. Values of rejected lines are null. Columns added:
    e1, r, e2, raw (the text of rejected lines) and reason; columns of df with these names are replaced.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt", T.StringType())])
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1"}
    text = F.col("__line")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (*columns, "raw", "reason") or c == line], F.col(line).alias("__line"))
    rows = rows.where(text.isNotNull() & text.rlike(rf"[^\s\p{{Z}}\x{{0085}}\x{{001c}}-\x{{001f}}]") & ~text.startswith("#"))
    rows = rows.withColumn("__read", F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), options))
    plain = F.col("__read._corrupt").isNull() & ~text.rlike(r'["\p{Cntrl}&&[^\t]]')
    rows = rows.withColumn("__ok", plain | let(F.split(text, '"', -1), _quoting_ok))
    read = F.array(*[strip(F.coalesce(F.col(f"__read.{c}"), F.lit(""))) for c in columns])
    rows = rows.withColumn("__f", F.when(plain, read).when(F.col("__ok"), _fields(text)))
    names = [c for c in columns if c != kind]
    at = {c: F.element_at("__f", i + 1) for i, c in enumerate(columns)}

    def bad(v: Column) -> Column:
        return ~v.rlike(r"\p{L}") | v.startswith("/") | v.startswith("m/") | v.rlike(r"[\p{Cc}\x{FFFD}&&[^\t]]")

    known = kinds.select(F.col(kind).alias("__kind")).where(F.col("__kind").isNotNull()).distinct().withColumn("__known", F.lit(True))
    rows = rows.withColumn("__kind", F.when(F.size("__f") == 3, at[kind]))
    rows = rows.join(known, "__kind", "left")
    reason = (
        F.when(~F.col("__ok"), REASONS[0])
        .when(F.size("__f") != 3, REASONS[1])
        .when(F.col("__known").isNull() | bad(at[names[0]]) | bad(at[names[1]]), REASONS[2])
    )
    rows = rows.withColumn("__reason", reason)
    keep = [c for c in df.columns if c not in (*columns, "raw", "reason") or c == line]
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        *[F.when(F.col("__reason").isNull(), at[c]).alias(c) for c in columns],
        F.when(F.col("__reason").isNotNull(), text).alias("raw"),
        F.col("__reason").alias("reason"),
    )


def load_triples(df: DataFrame, line: str, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows with e1, r, e2 and rejected rows with raw and reason. See classify_lines."""
    rows = classify_lines(df, line, kinds)
    return rows.where("reason is null").drop("raw", "reason"), rows.where("reason is not null").drop("e1", "r", "e2")
