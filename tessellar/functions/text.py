"""Text functions as column expressions: they stay in the JVM and inside generated code where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content of their own, left out of lexical matching.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "what", "which", "who", "will", "with")
WH = ("how", "what", "when", "where", "which", "who", "why")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTINELS = ("", "nan", "null", "none", "unknown", "no heading")
#: bands of a similarity in percent, from the top
BANDS = ((85, "Excellent"), (70, "Very Good"), (50, "Good"), (30, "Fair"))


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Words longer than one character that carry content."""
    return F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def squash(c: Column) -> Column:
    """Blanks collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def bare(c: Column) -> Column:
    """Lower-cased, without ASCII punctuation, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"\s+", " "))


def lenient(c: Column) -> Column:
    """Lower-cased, blanks collapsed, all but letters, digits, blanks and ``.,!?-`` deleted."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[^\p{L}\p{N}_ .,!?-]", "")


def sentences(c: Column) -> Column:
    """Sentences by their closing marks, trimmed, blank ones dropped."""
    s = F.regexp_extract_all(F.regexp_replace(c, r"\s+", " "), F.lit("[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(F.coalesce(s, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def fragments(c: Column) -> Column:
    """Clauses: parts between commas, semicolons and coordinating words, as ``bare`` text."""
    parts = F.split(F.lower(c), r"[,;]|\s(?:and|but|or|although|though)\s")
    return F.filter(F.transform(parts, bare), lambda x: x != "")


def smart_cut(c: Column, limit: int) -> Column:
    """At most ``limit`` characters: cut behind the last sentence mark if that keeps 70 %, else at the last blank if that
    keeps half, else hard."""
    head = F.substring(c, 1, limit)
    mark = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?…])", 1))
    blank = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return F.when(F.length(c) <= limit, c).when(mark >= 0.7 * limit, F.substring(head, F.lit(1), mark)).when(blank >= 0.5 * limit, F.substring(head, F.lit(1), blank)).otherwise(head)


def base_name(c: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(c, "[/\\\\]"), -1)))


def unsentinel(c: Column) -> Column:
    """Null for the strings that stand for nothing."""
    return F.when(~F.lower(F.trim(c)).isin(*SENTINELS), F.trim(c))


def page_number(c: Column) -> Column:
    """The number in a page's spelling (8, 008, 8.0, p. 8, S. 8, Page 8); null if there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({_sql(c)}, '(?i)^\\\\s*(?:(?:page|pp?|s)\\\\.?)?\\\\s*([0-9]{{1,9}})(?:\\\\.0*)?\\\\s*$', 1), '') as int)")


def _sql(c: Column) -> str:
    name = c._jc.toString() if hasattr(c, "_jc") else str(c)
    return f"`{name}`" if name.isidentifier() else name


def distinct_in_order(c: Column) -> Column:
    """Trimmed, blank ones dropped, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def has_keyword(text: Column, keyword: Column) -> Column:
    """A phrase as a substring of the squashed text, a single word between word borders."""
    t, k = squash(text), squash(keyword)
    padded = F.concat(F.lit(" "), F.regexp_replace(t, r"[^a-z0-9_]+", " "), F.lit(" "))
    return F.when(F.instr(k, " ") > 0, F.contains(t, k)).otherwise(F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))


def no_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def first_number(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The first number of an answer within the bounds; 0 if there is none."""
    n = F.expr(f"try_cast(nullif(regexp_extract({_sql(c)}, '([0-9]+(?:[.][0-9]+)?)', 1), '') as double)")
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), n)), F.lit(0.0))


def band(c: Column) -> Column:
    out = F.when(c >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(c >= least, name)
    return out.otherwise("Poor")


def capital_share(c: Column) -> Column:
    """Share of capitals among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)
