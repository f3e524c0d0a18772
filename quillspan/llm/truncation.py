"""Problem 10: texts cut off by field limits or in transfer.

Lengths of every text are recomputed under alternative encodings, entity escaping, JSON escaping and newline conversion
and counted by source and length. A limit shows as a length that far more texts of a source share than the lengths
around it. Endings are then inspected: a text at a limit is cut when it ends inside a word, sentence or character; texts
elsewhere when the ending itself proves it (prose that stops in a sentence, an unclosed tag, entity, escape or formula).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.plans.spool import counted, spool
from quillspan.sources.tables import table

#: A length is a limit of a source when at least MIN_AT different texts have it, at least TIMES as often as the mean of the
#: NEAR lengths on either side, and no more than half of those at it end with a closed sentence or block.
MIN_AT = 4
#: Rows of a side table that is sent to all executors at most.
SENT = 1_000_000
TIMES = 6.0
NEAR = 25


def source_key(name: str = "source") -> Column:
    """Sources without case and outer blanks; blank and null ones are one source, the empty string."""
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text in each form that a store may limit."""
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    chars, octets = F.length(text), F.octet_length(text)
    lines = count("\n")
    amp, angle, quote, apostrophe = count("&"), count("[<>]"), count('"'), count("'")
    entities = 4 * amp + 3 * angle
    # Characters beyond the basic plane take two UTF-16 units.
    units = chars + count("[\\x{10000}-\\x{10FFFF}]")
    slashes = count(r"\\")
    json_escapes = quote + slashes + lines + count("[\t\r]")
    latin = count("[\\x{80}-\\x{FFFF}]")
    return {
        "chars": chars,
        "utf8": octets,
        "utf16": units,
        "entities": chars + entities,
        "entities_quoted": chars + entities + 5 * quote + 5 * apostrophe,
        "entities_utf8": octets + entities,
        "json": chars + json_escapes,
        "json_ascii": units + json_escapes + 5 * latin,
        "json_utf8": octets + json_escapes,
        "crlf": chars + lines,
        "crlf_utf8": octets + lines,
    }


#: Endings that close a text: sentence ends with closing marks, and ends of blocks.
_CLOSED = re.compile(r"""(?:[.!?…。]["'’”»)\]*_`~]*|>|\}|`|\||\$\$|--|;)\s*$""")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\(?\d+[.)]|\*\s?\S|\\item\b|\|[-}|]?|#{1,6}\s|={2,}|<)")
_LABEL = re.compile(r"^(?:See also|Next:|Siehe auch|Voir aussi|Véase|Seite|Page)\b|^kb/|^\S+:\s*\S+$|^\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^--|[;|].*[;|]")
_TORN = re.compile(
    r"(?:\ufffd|&(?:#\d*|#x[0-9a-fA-F]*|[a-zA-Z]{1,7})?|<(?:/?[a-zA-Z][^<>]*|/|!-{0,2})?|\\u?[0-9a-fA-F]{0,3}|\\[a-zA-Z]+\{[^{}]*|%[0-9a-fA-F]?|\[\[[^\]]*|\{\{[^}]*|!?\[[^\]]*\]\([^)]*|[,(])$"
)
#: Marks that a store leaves where it cut: an ellipsis in brackets, or one after a word that has no stop of its own.
_MARKED = re.compile(r"\s(?:\[(?:\.{3}|…)\]|\((?:\.{3}|…)\))\s*$")
_PROSE_WORDS = 4
# Articles, prepositions and conjunctions that no text ends with.
_OPEN = frozenset("the a an and or of to in with for from by at on as that which because der die das den dem des ein eine und oder von zu mit für im vom zum zur le la les un une des du et ou de à au aux dans pour avec el los las una y o del al en con por para que".split())


def ending(text: str, at_limit: bool) -> bool:
    """Whether the text's ending shows a cut."""
    body = text.rstrip("\n")
    if not body.strip():
        return False
    if body.endswith("\ufffd") or _MARKED.search(body):
        return True
    line = body.rsplit("\n", 1)[-1]
    stripped = line.rstrip()
    opened_code = body.count("```") % 2 == 1
    if at_limit:
        return not _CLOSED.search(stripped) or opened_code or _odd(body)
    if opened_code:
        return True
    if _odd(body):
        return True
    if _CLOSED.search(stripped):
        return False
    last = re.search(r"[^\W\d_]+$", stripped)
    if last and len(stripped.split()) > 3 and last.group().islower() and last.group() in _OPEN and not _ITEM.match(line):
        return True
    if _TORN.search(stripped) and not stripped.endswith((")",)):
        return not _LABEL.search(stripped) or stripped.endswith(",")
    if _ITEM.match(line) or _LABEL.search(stripped):
        return False
    # The last line is prose if it has earlier sentences or is long; a heading or label has neither.
    sentences = re.split(r"(?<=[.!?])\s+", stripped)
    words = sentences[-1].split()
    if len(sentences) > 1:
        return True
    before = body[: len(body) - len(line)].rstrip("\n")
    previous = before.rsplit("\n", 1)[-1].strip()
    opens = not previous or body[: len(body) - len(line)].endswith("\n\n") or previous.isupper() or previous.startswith(("#", "=")) or previous.startswith("\\") or previous[-1:] in ".!?"
    return opens and len(words) >= _PROSE_WORDS and words[0][:1].isupper() and not stripped.isupper()


def _odd(body: str) -> bool:
    """An environment, formula, table or tag that was opened and not closed at the end."""
    if body.count("\\begin{") > body.count("\\end{"):
        return True
    if body.count("$$") % 2 == 1:
        return True
    if body.count("\n{|") + body.startswith("{|") > body.count("\n|}"):
        return True
    for tag in ("p", "ul", "ol", "table", "pre", "li", "div"):
        if len(re.findall(rf"(?i)<{tag}[\s>]", body)) > len(re.findall(rf"(?i)</{tag}\s*>", body)) and re.match(r"(?i)\s*<", body):
            return True
    return False


def _ends_cut(text: pd.Series, at_limit: pd.Series) -> pd.Series:
    return pd.Series([bool(t) and ending(t, bool(a)) for t, a in zip(text, at_limit, strict=True)], dtype=bool)


def measured(rows: DataFrame) -> DataFrame:
    """rows(key, source, text) -> (key, source, a length for each form, closed, h) of the texts that aren't null or empty; h is a hash of the text."""
    forms = lengths(F.col("text"))
    some = rows.where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("key").isNotNull())
    return some.select("key", source_key().alias("source"), *[v.cast("int").alias(k) for k, v in forms.items()], F.expr("text rlike '[.!?>}`|][\\\\s]*$'").alias("closed"), F.xxhash64("text").alias("h"))


def hidden_limits(lens: DataFrame) -> DataFrame:
    """(source, form, length, texts): the lengths that show a storage limit, under each form. A text counts once, however often it comes."""
    forms = list(lengths(F.col("text")))
    long = lens.dropDuplicates(["source", "h"]).select("source", "closed", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("length")) for f in forms])).alias("x"))
    counts = long.groupBy("source", "x.form", "x.length").agg(F.count("*").alias("texts"), F.count_if("closed").alias("closed"))
    by = Window.partitionBy("source", "form").orderBy("length").rangeBetween(-NEAR, NEAR)
    near = (F.sum("texts").over(by) - F.col("texts")) / F.lit(2.0 * NEAR)
    spikes = counts.withColumn("near", near).where((F.col("texts") >= MIN_AT) & (F.col("texts") >= TIMES * F.greatest("near", F.lit(0.5))) & (2 * F.col("closed") <= F.col("texts")))
    return spikes.select("source", "form", "length", "texts")


def truncated(rows: DataFrame) -> DataFrame:
    """rows(key, source, text) -> (key, source, limited, cut) for every text that isn't null or empty.

    limited: it has exactly the length of a hidden limit of its source; cut: it was truncated. Null and empty texts
    give no row; repeated rows give a row each; an empty table gives none.
    """
    lens = spool(measured(rows))
    limits = hidden_limits(lens)
    forms = list(lengths(F.col("text")))
    per_source = limits.groupBy("source").agg(F.collect_set(F.concat_ws(":", "form", "length")).alias("limits"))
    # A row for each source that has limits, and one for each text at a limit: sent to all executors if they are few, so
    # that neither texts nor lengths are shuffled, and joined else.
    per_source, sources = counted(per_source)
    few = lambda df, n: F.broadcast(df) if n <= SENT else df
    own = F.array(*[F.concat_ws(":", F.lit(f), F.col(f)) for f in forms])
    hit, number = counted(lens.join(few(per_source, sources), "source").where(F.arrays_overlap(own, "limits")).select("key", F.lit(True).alias("limited")).distinct())
    texts = rows.where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("key").isNotNull())
    tail = texts.select("key", source_key().alias("source"), "text").join(few(hit, number), "key", "left")
    return tail.select("key", "source", F.coalesce("limited", F.lit(False)).alias("limited"), F.pandas_udf(_ends_cut, "boolean")("text", F.coalesce("limited", F.lit(False))).alias("cut"))


def truncation_rates(rows: DataFrame) -> DataFrame:
    """(source, texts, cut, at_limit, rate): how often each source truncates, and how many of its cut texts lie at a hidden limit."""
    by = truncated(rows).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("limited")).alias("at_limit"))
    return by.withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(_documents(spark, folder)).where("cut").select(F.col("key").alias("doc_id"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_rates(_documents(spark, folder))


def p10_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden limits of each source."""
    return hidden_limits(measured(_documents(spark, folder)))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_limits": p10_limits}
ORACLES: dict[str, str] = {}
