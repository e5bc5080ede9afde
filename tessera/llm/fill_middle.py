"""Fill-in-middle by escaped marker injection.

A text is cut into units (lines with their ends, by default).  A delimiter character is escaped
in the text, ``regexp_replace`` appends it after each unit, its count is the number of units,
and ``substring_index`` takes the ranked parts out: the first units are the prefix, then comes
the middle, the rest is the suffix.  The parts are unescaped and put together around three
markers, as psm (prefix, suffix, middle) or spm (suffix, prefix, middle).

Where a text is cut and which form it takes follows from a digest of its doc_id alone, so any
number of runs and partitions gives the same output.

Defined results: a null text is an empty one; an empty text, and one that holds a marker, stays
as it is (form plain, no parts); a null doc_id is digested as no digits; repeated rows stay rows;
an empty table gives no rows; other columns are carried only by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units by name; no match ends inside an escape, which is the escape character and a letter.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\S*\s+|\S+"}
MARKERS = ("<P>", "<S>", "<M>")
DELIMITER, ESCAPE = "\u0001", "\u0002"
OUT = ("n", "form", "output", "prefix_chars", "middle_chars")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def _part(marked: Column) -> Column:
    """A run of marked units as plain text."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def _between(marked: Column, first: Column, last: Column) -> Column:
    """The marked units after the first ``first`` up to number ``last``."""
    upto = F.call_function("substring_index", marked, F.lit(DELIMITER), last)
    return F.call_function("substring_index", upto, F.lit(DELIMITER), first - last)


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must be found again: none may share an end with the start of one, or hold another."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"markers {a!r} and {b!r} cannot be told apart")
    if len(set(markers)) < 3:
        raise ValueError("markers must differ")


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, unit: str = "line", markers: tuple[str, str, str] = MARKERS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, *keep, n, form, output, prefix_chars, middle_chars).

    ``rate`` percent of the texts are transformed, ``spm_share`` percent of these as spm.
    """
    _check(markers)
    if clash := {c.lower() for c in keep} & {"doc_id", "fim_text", "fim_escaped", "fim_marked", "fim_h", "fim_lo", "fim_hi", "fim_parts", *OUT}:
        raise ValueError(f"rename the columns {sorted(clash)}")
    kept = ["doc_id", *[f"`{c}`" for c in keep]]
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(told.substr(i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    df = docs.select(*kept, F.coalesce("text", F.lit("")).alias("fim_text"), numbers.alias("fim_h"))
    df = df.withColumn("fim_escaped", _escaped(F.col("fim_text")))
    df = df.withColumn("fim_marked", F.regexp_replace("fim_escaped", UNITS[unit], f"$0{DELIMITER}"))
    df = df.withColumn("n", (F.length("fim_marked") - F.length("fim_escaped")).cast("long"))
    h = [F.col("fim_h")[i] for i in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    held = F.lit(False)
    for m in markers:
        held = held | F.contains("fim_text", F.lit(m))
    form = F.when((F.col("fim_text") == "") | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm")
    df = df.withColumns({"fim_lo": F.least(one, two).cast("int"), "fim_hi": F.greatest(one, two).cast("int"), "form": form})
    lo, hi, n = F.col("fim_lo"), F.col("fim_hi"), F.col("n").cast("int")
    marked = F.col("fim_marked")
    # each unit is followed by a delimiter, so an empty part stands after the last one
    suffix = F.call_function("substring_index", marked, F.lit(DELIMITER), hi - n - 1)
    parts = F.struct(
        _part(F.call_function("substring_index", marked, F.lit(DELIMITER), lo)).alias("prefix"), _part(_between(marked, lo, hi)).alias("middle"), _part(suffix).alias("suffix"))
    df = df.withColumn("fim_parts", F.when(F.col("form") != "plain", parts))
    p, m, s = (F.col(f"fim_parts.{x}") for x in ("prefix", "middle", "suffix"))
    mark_p, mark_s, mark_m = map(F.lit, markers)
    psm, spm = F.concat(mark_p, p, mark_s, s, mark_m, m), F.concat(mark_s, s, mark_p, p, mark_m, m)
    output = F.when(F.col("form") == "plain", F.col("fim_text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return df.select(*kept, "n", "form", output.alias("output"), F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text that an output was made of."""

    def before(text: Column, mark: str) -> Column:
        return F.call_function("substring_index", text, F.lit(mark), F.lit(1))

    def after(text: Column, mark: str) -> Column:
        return F.call_function("substring_index", text, F.lit(mark), F.lit(-1))

    mark_p, mark_s, mark_m = markers
    middle, head = after(output, mark_m), before(output, mark_m)
    psm = F.concat(before(after(head, mark_p), mark_s), middle, after(head, mark_s))
    spm = F.concat(after(head, mark_p), middle, before(after(head, mark_s), mark_p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
