"""Line-first quality rules: judge each line, drop failing lines, reject documents that lose too much text.

Only DataFrame functions are used and no row is moved: each document is judged where it is read.

Line rules (a line without a word is neither judged nor counted):

* punctuation: three or more words end in a repeated exclamation mark, and these are half of the line's words;
* navigation: three or more separators ``|``, or symbols ``# * $ % & | < >`` at more than a fifth of the words (three at least);
* boilerplate: the line holds a fixed phrase and has at most twelve words.

Defined results: a null text counts as empty; an empty text has no words, so it fails the base rule; a text of any
length is judged whole; equal rows get equal verdicts, one per row; an empty table gives an empty result; other columns are
ignored by ``quality_rules`` and kept by ``clean_documents``, whatever their names. A null id is carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import BLANKS, documents, text_of

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
KEEP_SHARE = 0.5  # a kept document keeps at least this share of its characters in lines with a word
# fixed values: phrases of site furniture
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
               "click here", "sign up for our newsletter", "back to top", "skip to content", "share this", "read more", "lorem ipsum")
SYMBOL, HAS_WORD = "[#*$%&|<>]", r"[^\x20\x09-\x0D]"
SHOUT = r"[^\x20\x09-\x0D]!!+(?:[\x20\x09-\x0D]|$)"


def _bad_line(line: Column) -> Column:
    """True for a line that fails a rule."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    shouts, symbols = F.regexp_count(line, F.lit(SHOUT)), F.regexp_count(line, F.lit(SYMBOL))
    bars = F.regexp_count(line, F.lit(r"\|"))
    phrase = F.lower(line).rlike("|".join(BOILERPLATE)) & (words <= 12)
    return ((shouts >= 3) & (2 * shouts >= words)) | (bars >= 3) | ((symbols >= 3) & (5 * symbols > words)) | phrase


def _sum_lengths(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` has ``_row`` and ``_text``; adds the measures, the lines that stay and the verdict."""
    c = F.col
    # the blank runs at both ends would give empty words: they are trimmed before splitting
    inner = F.regexp_replace("_text", rf"^{BLANKS}|{BLANKS}$", "")
    df = rows.withColumn("_words", F.when(c("_text").rlike(HAS_WORD), F.split(inner, BLANKS)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_n", F.size("_words"))
    df = df.withColumns({
        "_filled": F.filter("_lines", lambda x: x.rlike(HAS_WORD)),
        "_good": F.filter("_lines", lambda x: ~x.rlike(HAS_WORD) | ~_bad_line(x)),
        # a hash of every window tells cheaply whether any window can repeat; equal windows always have equal hashes
        "_hashes": F.when(c("_n") > WINDOW, F.transform(F.sequence(F.lit(1), c("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
    })
    df = df.withColumn("_repeats", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    # only there the windows themselves are sorted with their places: equal neighbours repeat
    df = df.withColumn("_sorted", F.when(c("_repeats"), F.array_sort(F.transform(
        F.sequence(F.lit(1), c("_n") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("at"))))))
    df = df.withColumn("_places", F.when(c("_repeats"), F.array_sort(F.transform(F.filter(
        F.transform("_sorted", lambda x, i: F.when(
            (x["w"] == F.get("_sorted", i - 1)["w"]) | (x["w"] == F.get("_sorted", i + 1)["w"]), x["at"])), lambda p: p.isNotNull()), lambda p: p))))
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    df = df.withColumns({
        "n_words": c("_n").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)).cast("bigint"),
        "n_dup_lines": (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("bigint"),
        "n_repeat_words": F.when(c("_repeats"), covered).otherwise(F.lit(0)).cast("bigint"),
        "line_chars": _sum_lengths(c("_filled")),
        "good_chars": _sum_lengths(F.filter("_good", lambda x: x.rlike(HAS_WORD))),
    })
    df = df.withColumn("base_failed", (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words")))
    return df.withColumn("kept", ~c("base_failed") & (c("good_chars") >= KEEP_SHARE * c("line_chars")))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, measures, verdict, and the text without its failing lines (``clean_text``)."""
    rows = docs.select(docs[doc_id].alias("_row"), text_of(docs, text).alias("_text"))
    return judged(rows).select(
        F.col("_row").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "line_chars", "good_chars", F.array_join("_good", "\n").alias("clean_text"))


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Kept documents with all their columns; failing lines are gone from the text, its length is brought up to date."""
    rows = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("_row"), text_of(docs, text).alias("_text"))
    # the row number keeps the filter above the measures: pushed below, it would split the text once per window
    kept = judged(rows).withColumn("_at", F.monotonically_increasing_id()).filter("kept and _at >= 0")
    changed = F.size("_good") < F.size("_lines")
    out = {text: F.when(changed, F.array_join("_good", "\n")).otherwise(F.col("_row")[text])}
    if n_chars in docs.columns:
        out[n_chars] = F.when(changed, F.length(F.array_join("_good", "\n")).cast(docs.schema[n_chars].dataType)).otherwise(F.col("_row")[n_chars])
    return kept.select(*[out[x].alias(x) if x in out else F.col("_row")[x].alias(x) for x in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W, _HW = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM d WHERE len(w) >= {WINDOW}),
grams AS (SELECT doc_id, pos, array_to_string(w[pos:pos + {WINDOW - 1}], ' ') AS g FROM spots),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest(range(0, {WINDOW})) AS k) z GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
j AS (
  SELECT doc_id, line, {_COUNT.format('line', _W)} AS n, {_COUNT.format('line', SHOUT)} AS shouts,
         {_COUNT.format('line', SYMBOL)} AS symbols, {_COUNT.format('line', r'[|]')} AS bars
  FROM l WHERE regexp_matches(line, '{_HW}')),
k AS (
  SELECT doc_id, sum(length(line)) AS line_chars, count(*) - count(DISTINCT line) AS dup,
         sum(CASE WHEN (shouts >= 3 AND 2 * shouts >= n) OR bars >= 3 OR (symbols >= 3 AND 5 * symbols > n)
                    OR (n <= 12 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) THEN 0 ELSE length(line) END) AS good_chars
  FROM j GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_COUNT.format('t', SYMBOL)} AS n_symbols,
         coalesce(k.dup, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
         coalesce(line_chars, 0) AS line_chars, coalesce(good_chars, 0) AS good_chars
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND good_chars >= {KEEP_SHARE} * line_chars AS kept
FROM m
"""
