"""Quality rules: line-first cleaning, with DataFrame functions only.

Each line is judged by itself: punctuation (hardly any letters, or symbols that crowd them out), navigation (menus and
breadcrumbs) and boilerplate (stock phrases of web pages). Lines that fail go; a document goes when too much of its
text was in such lines, when it is too short, or when it repeats itself.

Defined results: a null or empty text has no words and is rejected (base rule); lines without words neither fail nor
count; equal rows give equal results row by row; other columns pass through `clean_lines` untouched. Everything is one
projection over the row, so nothing is shuffled and one very long text costs O(n log n) in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, let, table, words

#: Phrases of pages, not of prose. A line of at most BOILERPLATE_CHARS characters that holds one at the start of a word fails.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "javascript is disabled", "sign up for our newsletter", "subscribe to our newsletter",
    "click here to", "skip to content", "powered by", "lorem ipsum", "share on facebook", "share this article",
)
BOILERPLATE_CHARS = 360
STOCK = r"(?:^|\x20)(?:" + "|".join(BOILERPLATE) + ")"
#: A line fails when more than this share (in per cent) of its word characters are symbols.
MAX_SYMBOLS = 15
#: A line with at least this many menu separators, and at most three words to each, is navigation.
MENU_SEPARATORS = 3
#: A document goes when more than this share (in per cent) of its word characters was in failed lines.
MAX_LOST = 30
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    some = "[" + "".join(f"\\{c}" for c in chars) + "]"
    return F.when(text.rlike(some), F.length(text) - F.length(F.regexp_replace(text, some, ""))).otherwise(0)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{BLANK}]+", ""))


def has_word(text: Column) -> Column:
    return text.rlike(f"[^{BLANK}]")


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of `width` words that are found twice or more in ws.

    Windows are compared by two 64-bit hashes. Sorting (hash, position) pairs puts equal windows side by side; the
    positions of those with an equal neighbour are sorted again, and each covers min(width, step to the next) words.
    """

    def covered(pos: Column) -> Column:
        gaps = F.transform(pos, lambda p, i: F.when(i + 1 < F.size(pos), F.least(F.lit(width), F.get(pos, i + 1) - p)).otherwise(width))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def equal(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["g"] == b["g"])

    def twice(keys: Column) -> Column:
        found = F.filter(keys, lambda k, i: F.coalesce(equal(k, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(equal(k, F.get(keys, i + 1)), F.lit(False)))
        return let(F.array_sort(F.transform(found, lambda k: k["p"])), covered)

    def keyed(hashes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
        window = lambda p: F.slice(hashes, p, width)
        keys = F.transform(at, lambda p: let(window(p), lambda s: F.struct(F.xxhash64(s).alias("h"), F.hash(s).alias("g"), p.alias("p"))))
        # Most texts repeat nothing: there, distinct first hashes settle it without sorting.
        plain = F.transform(at, lambda p: F.xxhash64(window(p)))
        return let(plain, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(let(F.sort_array(keys), twice)))

    return F.when(F.size(ws) > width, let(F.transform(ws, lambda w: F.xxhash64(w)), keyed)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """True where a line with words breaks a rule."""
    symbols = SYMBOLS + "{}[]\\^~=_"
    crowded = line.rlike("[" + "".join(f"\\{c}" for c in symbols) + "]") & (100 * count_of(line, symbols) > MAX_SYMBOLS * word_chars(line))
    separators = F.size(F.regexp_extract_all(line, F.lit(r"([|»›•·]|\x20>\x20)"), F.lit(1)))
    navigation = line.rlike("[|»›•·>]") & (separators >= MENU_SEPARATORS) & (F.size(F.split(F.trim(line), r"\x20+")) <= 4 * separators + 3)
    stock = (F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(STOCK)
    return crowded | ~line.rlike(r"\p{L}|\p{N}") | navigation | stock


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with clean_text (lines that fail removed), n_failed_lines and lost_chars (their word characters), which no column of
    df may be called (`quality` puts all of its input's columns in a struct)."""
    if clash := {"clean_text", "n_failed_lines", "lost_chars"} & set(df.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def judged(ls: Column) -> Column:
        bad = F.filter(ls, lambda x: has_word(x) & line_fails(x))
        return let(bad, lambda b: F.struct(
            F.when(F.size(b) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.filter(ls, lambda x: ~(has_word(x) & line_fails(x))), "\n")).alias("clean_text"),
            F.size(b).cast("long").alias("n_failed_lines"),
            F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + word_chars(x)).alias("lost_chars"),
        ))

    out = df.withColumn("__judged", let(lines, judged))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__judged.clean_text"), F.col("__judged.n_failed_lines"), F.col("__judged.lost_chars"))


def quality(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: key, counts of its text, base_failed, the method's figures, kept, clean_text, and row
    (a struct of all columns of df, so that no name can clash)."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    raw = clean_lines(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), row))
    counts = let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    dup = let(F.filter(F.split(F.col("text"), "\n", -1), has_word), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    out = raw.withColumns({"__n": counts, "n_dup_lines": dup, "word_chars": word_chars(F.col("text")).cast("long"), "n_symbols": count_of(F.col("text"), SYMBOLS).cast("long")})
    out = out.select(key, F.col("__n.n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__n.n_repeat_words"), "n_failed_lines", "lost_chars", "clean_text", "row")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("word_chars")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT doc_id, x, length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS c,
    len(regexp_extract_all(x, '[|»›•·]|\x20>\x20')) AS seps FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lf AS (SELECT doc_id, x, c, (100 * (length(x) - length(translate(x, '{SYMBOLS}{{}}[]\^~=_', ''))) > {MAX_SYMBOLS} * c) OR NOT regexp_matches(x, '\p{{L}}|\p{{N}}')
    OR (seps >= {MENU_SEPARATORS} AND len(string_split_regex(trim(x), '\x20+')) <= 4 * seps + 3)
    OR (length(x) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(x), '{STOCK}')) AS bad FROM lw),
la AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dups, count(*) FILTER (bad) AS bads, coalesce(sum(c) FILTER (bad), 0) AS lost FROM lf GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(bads, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept FROM r
"""
