"""Line-first quality rules, in DataFrame functions only.

Each line with a word is held against three rules; lines that fail are removed,
and a document that loses too much of its text is rejected:

* punctuation: the line holds a sentence end, and at most a third of its words are shouted (end in ``!!`` or ``??``);
* navigation: it isn't a bar of items (``|``, ``»``, ``>``), nor a lone menu word, nor mostly symbols;
* boilerplate: it holds none of the phrases of ``BOILERPLATE``.

Words are runs of characters other than space and U+0009 to U+000D. A null text
has no words and no lines and fails the base rules, as does an empty one.
Windows of five words are compared by a 64-bit hash of the words. Texts of any
length are judged in whole. Repeated rows give repeated rows; an empty table gives an
empty result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import text_of

BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum",
    "click here", "read more", "subscribe to", "sign up for", "share this", "powered by", "copyright ©", "(c) copyright",
)
MENU_WORDS = ("home", "menu", "login", "log in", "sign in", "sign up", "search", "next", "previous", "back to top", "contact", "contact us", "about", "about us", "sitemap")
#: A document is rejected if more than this share of its lines' characters is removed.
MOST_LOST = 0.5
#: Words in a window, and the share of words in repeated windows (in percent) and words needed by the base rules.
WINDOW, MOST_REPEATED, LEAST_WORDS = 5, 20, 10

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return _let(F.btrim(text, F.lit(_BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPACE + "+")))


def _covered(starts: Column, width: int) -> Column:
    """Positions in windows of this width at the sorted starts."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p.cast("long"))).alias("n"), (p + width).cast("long").alias("end")),
    )
    return step["n"]


def _repeated(words: Column, width: int) -> Column:
    """Words in windows that the text holds twice or more, the first included."""

    def by_neighbours(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return _covered(F.sort_array(F.transform(same, lambda x: x["i"])), width)

        return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), starts)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(by_neighbours(h)))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(found)


def line_passes(line: Column) -> Column:
    low = F.lower(line)
    shouted = F.length(line) - F.length(F.regexp_replace(line, r"(!!|\?\?)(?=[\x20\x09-\x0D]|\z)", "!"))
    n_words = F.size(_words(line))
    punctuation = line.rlike(r"[.!?…:;][\"')»”]*([\x20\x09-\x0D]|\z)") & (shouted * 3 <= n_words)
    symbols = F.length(line) - F.length(F.regexp_replace(line, _SYMBOLS, ""))
    navigation = (symbols * 5 > n_words) | low.contains("»") | F.btrim(low, F.lit(_BLANKS + ".:")).isin(*MENU_WORDS)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return punctuation & ~navigation & ~boilerplate


def evaluate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, n_lines, n_lines_removed, n_chars_lines, n_chars_removed, cleaned (text), kept."""
    base = text_of(docs, id_col, text_col).withColumn("t", F.coalesce("text", F.lit("")))
    length = F.length("t")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w, WINDOW).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def counts(lines: Column) -> Column:
            total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
            return F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                total.alias("n_chars_lines"),
                F.filter(lines, line_passes).alias("passed"),
            )

        return _let(full, counts)

    found = base.select(
        "doc_id",
        (length - F.length(F.regexp_replace("t", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        (length - F.length(F.regexp_replace("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(_words(F.col("t")), of_words).alias("w"),
        _let(F.split("t", "\n"), of_lines).alias("l"),
    )
    failed = (F.col("w.n_words") < LEAST_WORDS) | (100 * F.col("w.n_repeat_words") > MOST_REPEATED * F.col("w.n_words"))
    kept_chars = F.aggregate("l.passed", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return found.select(
        "doc_id",
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("l.n_lines").alias("n_lines"),
        (F.col("l.n_lines") - F.size("l.passed")).alias("n_lines_removed"),
        F.col("l.n_chars_lines").alias("n_chars_lines"),
        (F.col("l.n_chars_lines") - kept_chars).alias("n_chars_removed"),
        F.array_join("l.passed", "\n").alias("cleaned"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_chars_removed") <= MOST_LOST * F.col("n_chars_lines")))


def verdicts(evaluated: DataFrame) -> DataFrame:
    return evaluated.drop("cleaned")


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, x, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS nw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lv AS (SELECT doc_id, x, length(x) AS c,
  regexp_matches(x, '[.!?…:;]["'')»”]*([\x20\x09-\x0D]|\z)')
  AND len(regexp_extract_all(x, '(!!|\?\?)([\x20\x09-\x0D]|\z)')) * 3 <= nw
  AND NOT (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 5 > nw AND NOT contains(lower(x), '»')
  AND trim(lower(x), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.:') NOT IN (%(menu)s)
  AND NOT (%(boiler)s) AS ok FROM ln),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup, sum(c) AS chars, count(*) FILTER (NOT ok) AS rm, coalesce(sum(c) FILTER (NOT ok), 0) AS rmc FROM lv GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(rm, 0) AS BIGINT) AS n_lines_removed,
  CAST(coalesce(chars, 0) AS BIGINT) AS n_chars_lines, CAST(coalesce(rmc, 0) AS BIGINT) AS n_chars_removed
  FROM w LEFT JOIN la USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND n_chars_removed <= 0.5 * n_chars_lines AS kept FROM f
""".replace("%(menu)s", ", ".join(f"'{m}'" for m in MENU_WORDS)).replace("%(boiler)s", " OR ".join(f"contains(lower(x), '{b}')" for b in BOILERPLATE))
