"""Lines of documents with offsets, and predicates on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import patterns as P

#: Lines whose lengths are summed at a time.
BLOCK = 64


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once: an optimiser that merges projections, or moves filters below them, would
    compute them again for each use, but not through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def split_lines(docs: DataFrame, text: str = "raw_text", keep: tuple[str, ...] = (), of_characters: tuple[str, ...] = (), once: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., line_no, start, line, of_characters..., once...): lines end at \\n only, a trailing empty line counts; start is a
    code-point offset; of arrays with an entry for each character, a line gets its part; columns of `once` go with a document's
    first line and are null on others. A null text has no lines. Nothing is shuffled: lengths are summed by blocks of lines
    within the row."""
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", *keep, *of_characters, *once, F.split(text, "\n").alias("_ls"))
    rows = staged(rows, _n=F.transform("_ls", lambda x: F.length(x) + 1))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / BLOCK).cast("int"))
    rows = staged(rows, _b=F.transform(blocks, lambda b: add(F.slice("_n", b * BLOCK + 1, BLOCK))))
    rows = staged(rows, _s=F.transform(blocks, lambda b: add(F.slice("_b", F.lit(1), b))))
    start = lambda i: F.get("_s", F.floor(i / BLOCK).cast("int")) + add(F.slice("_n", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    each = F.transform("_ls", lambda x, i: F.struct(i.alias("line_no"), start(i).alias("start"), x.alias("line"), *(F.slice(c, start(i) + 1, F.length(x)).alias(c) for c in of_characters), *(F.when(i == 0, F.col(c)).alias(c) for c in once)))
    return rows.select("doc_id", *keep, F.inline(each))


def any_in(text: Column, *cues: str) -> Column:
    """Does a text hold one of these? Looked for before a pattern that needs one of them is tried: a search for plain text costs a
    small part of what an alternation does."""
    return reduce(Column.__or__, [text.contains(c) for c in cues])


#: What a laboratory row may end in: a digit, a unit's last letter, a bracket or a tab; or a line break within the line, which a
#: pattern's end takes for one.
ROW_ENDS = (*"0123456789lrgmLRGM%)]\t\n\r\x85\u2028\u2029",)


def may_end_row(line: Column) -> Column:
    """Can a line be a laboratory row, by its last character that isn't a space?"""
    return F.substring(F.rtrim(line), -1, 1).isin(*ROW_ENDS)


def legible(text: Column) -> Column:
    """Letters and digits of a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


#: What \\s stands for in a pattern, and what ends a text that tidy leaves alone.
WHITE, PLAIN = " \t\n\x0b\f\r", (*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",)


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends, lower case."""
    return F.lower(F.trim(F.when(any_in(text, "  ", *WHITE[1:]), F.regexp_replace(text, r"\s+", " ")).otherwise(text)))


def name_key(text: Column) -> Column:
    """Names compare without case, extra white space and punctuation at the ends."""
    plain = squeezed(text)
    return F.trim(F.when(any_in(text, *".,;:"), F.regexp_replace(plain, "^[.,;:]+|[.,;:]+$", "")).otherwise(plain))


def value_key(text: Column) -> Column:
    """Values compare without case and white space."""
    return F.lower(F.when(any_in(text, *WHITE), F.translate(text, WHITE, "")).otherwise(text))


def tidy(text: Column) -> Column:
    """A span without what isn't a letter or digit at its ends; % and ) may end it."""
    plain = F.substring(text, 1, 1).isin(*PLAIN) & F.substring(text, -1, 1).isin(*PLAIN)
    return F.when(plain, text).otherwise(F.regexp_replace(F.regexp_replace(text, P.TIDY_LEFT, ""), P.TIDY_RIGHT, ""))


def lead(text: Column) -> Column:
    """Characters that tidy takes off a text's head."""
    return F.when(F.substring(text, 1, 1).isin(*PLAIN), 0).otherwise(F.length(text) - F.length(F.regexp_replace(text, P.TIDY_LEFT, "")))


def block_of(lines: Column, i: Column, radius: int = 2) -> Column:
    """The line with number i (from 0) of an array and those up to `radius` above and below, joined."""
    first = F.greatest(i - radius + 1, F.lit(1))
    return F.array_join(F.slice(lines, first, i + radius + 2 - first), "\n")


def withhold(lines: DataFrame, withheld: str = "withheld", counted: bool = False) -> DataFrame:
    """(doc_id, trusted): the text with withheld lines blanked, so that all offsets hold; `counted`: with n_withheld too."""
    kept = lines.withColumn("kept", F.when(F.col(withheld), F.repeat(F.lit(" "), F.length("line"))).otherwise(F.col("line")))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "kept")))
    n = [F.count(F.when(F.col(withheld), 1)).alias("n_withheld")] if counted else []
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["kept"]), "\n").alias("trusted"), *n)


#: A code fence around a reader's whole answer, and an answer that there is nothing to read.
_FENCE_HEAD, _FENCE_TAIL = r"^\s*```[A-Za-z]*[ \t]*\n", r"\n?[ \t]*```\s*$"
_NOTHING = r"(?i)^\W*no (?:readable|visible) text\W*$"


def strip_wrapping(answers: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """answers with a reader's text without a code fence and white space around it, and the probabilities of its characters
    cut alike. An answer that says there is no text is empty and has none."""
    whole = F.col(text)
    fenced = whole.rlike(_FENCE_HEAD) & whole.rlike(_FENCE_TAIL)
    head = F.when(fenced, F.length(F.regexp_extract(whole, f"({_FENCE_HEAD})", 1))).otherwise(0)
    inner = F.when(fenced, F.regexp_replace(F.regexp_replace(whole, _FENCE_HEAD, ""), _FENCE_TAIL, "")).otherwise(whole)
    rows = staged(answers, _inner=inner, _head=head)
    rows = staged(rows, _bare=F.regexp_replace("_inner", r"^\s+|\s+$", ""), _at=F.col("_head") + F.length("_inner") - F.length(F.regexp_replace("_inner", r"^\s+", "")))
    none = F.col("_bare").rlike(_NOTHING)
    cut = F.slice(confidence, F.col("_at") + 1, F.length("_bare"))
    out = rows.withColumns({text: F.when(none, "").otherwise(F.col("_bare")), confidence: F.when(none, F.slice(confidence, 1, 0)).otherwise(cut)})
    return out.drop("_inner", "_head", "_bare", "_at")


def chunks(docs: DataFrame, most: int = 900) -> DataFrame:
    """(doc_id, chunk, start, line_no, text): pieces of at most `most` characters, cut after the last line break that fits (else
    at the limit), for recognisers with a bounded window; line_no is that of a piece's first line. A break that begins a window
    is no place to cut. Lines are packed in order. Null and empty texts have no pieces."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(rf"(?s)(.{{1,{most}}})"), F.lit(1))

    def pack(acc: Column, line: Column) -> Column:
        last, before = F.element_at(acc, -1), F.slice(acc, 1, F.size(acc) - 1)
        fits = F.length(last) + F.length(line) <= most
        return F.when(fits, F.concat(before, F.array(F.concat(last, line)))).when(last == "\n", F.concat(before, cut(F.concat(last, line)))).otherwise(F.concat(acc, cut(line)))

    with_breaks = F.regexp_extract_all("raw_text", F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))
    packed = F.filter(F.aggregate(with_breaks, F.array(F.lit("")), pack), lambda x: x != "")
    parts = docs.select("doc_id", F.posexplode(packed).alias("chunk", "text"))
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    return parts.select("doc_id", "chunk", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int").alias("start"), F.coalesce(F.sum(breaks).over(before), F.lit(0)).cast("int").alias("line_no"), "text")
