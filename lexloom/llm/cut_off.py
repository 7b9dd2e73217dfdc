"""Problem 8: texts cut off by a field limit or in transfer.

Per source and column, histograms of the length in characters and in bytes are tested for spikes at the maximum: a length
that many more values have than lengths nearby, most of them open, and beyond which the column has fewer values than at and
below it (a limit that was raised later leaves some beyond). Values at a spike length that do not close a sentence
are cut. Marks put in at a cut (an ellipsis, a bracketed ellipsis, half a character, half a tag or entity) are set aside
before measuring.

Spikes cannot tell of texts that broke off in transfer at no fixed length. For these, and only where ``beyond_spikes`` is set, a
value away from every spike is cut that ends with such a mark (``mark``) or without closing a sentence (``fragment``),
unless its last line has the form of a complete line: forms (digits, names and table cells masked) are counted over all
values, and a fragment's form is rare while signatures, references, list rows and titles recur. ``reason`` tells which.

Defined cases: null and blank texts are never cut; a null source is a source of its own; an empty table gives empty
results; repeated rows count as often as they occur; very long texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A spike holds at least this many open values, this share of its column's values, and this many times the density of the
#: lengths no further than ``NEAR`` from it; of its values at least this share is open.
SPIKE_ROWS, SPIKE_SHARE, SPIKE_TIMES, NEAR, OPEN_SHARE = 5, 0.01, 6.0, 60, 0.6
#: How far a limit in bytes may fall short where a character would have been split.
BYTE_SLACK = 3
#: A last line is complete if its form ends at least this share of all values (and three of them).
FORM_SHARE, FORM_ROWS = 0.0004, 3

# What transfer leaves at a cut, at most ``TAIL`` characters but for runs of half characters; what may close a
# sentence, and what may stand behind it; abbreviations that end in a stop.
CUT_MARK = r"(?:\s?\[(?:\.{3}|…)\]|\s?\((?:\.{3}|…)\)|…|\.{3}|</?[a-zA-Z]{0,10}|&#?[a-zA-Z0-9]{0,8})$"
HALF_CHARACTER, TAIL = "\ufffd", 16
STOPS, CLOSERS = ".!?…", "\"'”’»“)]"
ABBREVIATED = r"(?:^|[\s(])(?:č|čís|inv|obr|tab|fig|no|nr|srov|por|vgl|cf|přír|prír|str|p|s|м|р|св)\.$"
TABLE_ROW = r"^[^|\n]+(?:\|[^|\n]+)+$"


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\f\r"))


def cut_mark(t: Column) -> Column:
    """What a cut has left at the very end of a text: only its tail is searched."""
    halves = F.length(t) - F.length(F.rtrim(t, F.lit(HALF_CHARACTER)))
    return F.when(halves > 0, F.right(t, halves)).otherwise(F.regexp_extract(F.right(t, F.lit(TAIL)), CUT_MARK, 0))


def ends_sentence(t: Column) -> Column:
    """Whether a text ends with a stop, closing marks aside, that is not that of an abbreviation."""
    body = F.rtrim(t, F.lit(CLOSERS))
    stop = F.right(body, F.lit(1)).isin(*STOPS)
    return stop & ~F.right(t, F.lit(TAIL)).rlike(ABBREVIATED)


def line_form(line: Column) -> Column:
    """The form of a line: digits as 0, names as X, the words of table cells as w."""
    numbers = F.regexp_replace(line, r"\p{N}+", "0")
    cells = F.regexp_replace(numbers, r"(?<=\|) *[^|0]+? *(?=\|)", " w ")
    names = F.regexp_replace(cells, r"\p{Lu}[\p{L}\p{M}]*", "X")
    return F.regexp_replace(names, r"X(?: X)+", "X")


def measured(df: DataFrame, key: str, texts: list[str], source: str) -> DataFrame:
    """One light row a value: its column, its lengths without the mark of a cut, how it ends and the form of its last line."""
    t = _stripped(F.col("raw"))
    mark = cut_mark(F.col("t"))
    stop = F.right(F.rtrim("t", F.lit(CLOSERS)), F.lit(1)).isin(*STOPS)
    last = F.substring_index(F.col("core"), "\n", -1)
    row = [F.col(key).alias("k"), F.col(source).alias("source")]
    if len(texts) == 1:
        values = df.select(*row, F.lit(texts[0]).alias("field"), F.col(texts[0]).alias("raw"))
    else:
        each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in texts])
        values = df.select(*row, F.inline(each))
    return (
        values.withColumn("t", t)
        .where("t is not null and t <> ''")
        .withColumn("mark", mark)
        .withColumn("core", F.expr("if(mark = '', raw, substring(t, 1, length(t) - length(mark)))"))
        .select(
            "k",
            "source",
            "field",
            "mark",
            F.length("core").alias("chars"),
            F.octet_length("core").alias("bytes"),
            (ends_sentence(F.col("t")) & (F.col("mark") == "")).alias("closed"),
            F.when(~stop | (F.col("mark") != ""), line_form(last)).alias("form"),
        )
    )


def spikes(rows: DataFrame) -> DataFrame:
    """(``source``, ``field``, ``unit``, ``length``): the spike lengths of each source and column.

    Lengths are counted before anything is compared, so a hot source costs one row a length. Byte limits fall up to
    ``BYTE_SLACK`` bytes short where a character would have been split, so neighbouring lengths just below a byte spike
    join it.
    """
    lengths = (
        rows.select("source", "field", F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (unit, length)"), "closed")
        .groupBy("source", "field", "unit", "length")
        .agg(F.count("*").alias("n"), F.sum(F.expr("if(closed, 0, 1)")).alias("n_open"))
    )
    # the windows are over distinct lengths, not over values
    by = W.partitionBy("source", "field", "unit").orderBy("length")
    at_bytes = F.col("unit") == "bytes"
    return (
        lengths.withColumn("around", F.sum("n").over(by.rangeBetween(-NEAR, NEAR)) - F.col("n"))
        .withColumn("total", F.sum("n").over(W.partitionBy("source", "field", "unit")))
        .withColumn("up_to", F.sum("n").over(by.rangeBetween(W.unboundedPreceding, 0)))
        .withColumn("group_open", F.sum("n_open").over(by.rangeBetween(-BYTE_SLACK, 0)))
        .where(
            (F.col("group_open") >= SPIKE_ROWS)
            & (F.col("n_open") >= F.when(at_bytes, 2).otherwise(SPIKE_ROWS))
            & (F.col("group_open") >= SPIKE_SHARE * F.col("total"))
            & (F.col("n_open") >= OPEN_SHARE * F.col("n"))
            & (F.col("n_open") >= SPIKE_TIMES * F.col("around") / (2.0 * NEAR))
            & (F.col("total") - F.col("up_to") < F.col("up_to"))
        )
        .select("source", "field", "unit", "length")
    )


def find_cut(
    df: DataFrame, key: str = "doc_id", text: str | list[str] = "text", source: str = "source", materialize=None, beyond_spikes: bool = True
) -> DataFrame:
    """(``k``, ``source``, ``field``, ``is_cut``, ``reason``) for every value with text of the column or columns ``text``; ``reason``
    is ``chars`` or ``bytes`` at a spike, ``mark`` or ``fragment`` away from spikes, if these are asked for."""
    rows = measured(df, key, [text] if isinstance(text, str) else text, source)
    if materialize is not None:
        rows = materialize(rows, "measured")
    peaks = spikes(rows).select(F.col("source").alias("s"), F.col("field").alias("f"), "unit", "length")
    per_chars = peaks.where("unit = 'chars'").select("s", "f", F.col("length").alias("v"), F.lit(True).alias("at_chars"))
    near = F.explode(F.sequence(F.col("length") - BYTE_SLACK, F.col("length")))
    per_bytes = peaks.where("unit = 'bytes'").select(F.col("s").alias("s2"), F.col("f").alias("f2"), near.alias("v2"), F.lit(True).alias("at_bytes")).distinct()
    totals = rows.groupBy(F.col("field").alias("f4")).agg(F.count("*").alias("total"))  # one row a column
    forms = (
        rows.where("form is not null and mark = ''")
        .groupBy(F.col("field").alias("f3"), F.col("form").alias("form3"))
        .agg(F.count("*").alias("n_form"))
        .join(F.broadcast(totals), F.col("f3") == F.col("f4"))
        .where(F.col("n_form") >= F.greatest(F.lit(float(FORM_ROWS)), FORM_SHARE * F.col("total")))
        .select("f3", "form3", F.lit(True).alias("known"))
    )
    open_rows = (
        rows.where("not closed")
        .join(per_chars, F.expr("source <=> s and field = f and chars = v"), "left")
        .join(per_bytes, F.expr("source <=> s2 and field = f2 and bytes = v2"), "left")
        .join(forms, F.expr("field = f3 and form = form3"), "left")
    )
    reason = F.when(F.col("known").isNull() & F.col("at_chars"), "chars").when(F.col("known").isNull() & F.col("at_bytes"), "bytes")
    if beyond_spikes:
        reason = reason.when(F.col("mark") != "", "mark").when(F.col("known").isNull(), "fragment")
    cut = open_rows.select("k", "source", "field", reason.alias("reason"))
    whole = rows.where("closed").select("k", "source", "field", F.lit(None).cast("string").alias("reason"))
    return cut.unionByName(whole).select("k", "source", "field", F.col("reason").isNotNull().alias("is_cut"), "reason")


def cut_share(found: DataFrame) -> DataFrame:
    """Per source and column the number of values with text, of cut ones, and the share cut."""
    return found.groupBy("source", "field").agg(
        F.count("*").alias("n_values"),
        F.sum(F.expr("if(is_cut, 1, 0)")).alias("n_cut"),
        F.round(F.avg(F.expr("if(is_cut, 1.0D, 0.0D)")), 6).alias("cut_share"),
    )
