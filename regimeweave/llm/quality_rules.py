"""Line-first cleaning: rules per line, failed lines go, then documents that lost too much go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions.vectors import let
from regimeweave.llm.common import WORD, text_of

SYMBOLS = "#*$%&|<>"
GRAM = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 60
TERMINAL = ".!?:;,\"')]}…”’»。！？"
NAVIGATION = ("|", "›", "»", "•", ">>")
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "lorem ipsum",
)


def occurrences(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def line_fails(line: Column, small: Column) -> Column:
    """Whether a line with a word fails one of the rules.

    Punctuation: no terminal mark at the end of a line of eight or more words, over one symbol
    for every ten characters, or an exclamation mark for every third word. Navigation: three or
    more separators, at least one for every four words. Boilerplate: a fixed phrase in ``small``, the line in lower case.
    """
    bare = F.rtrim(F.translate(line, "\r\t\u000b\u000c", "    "))
    n_words = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    no_end = (n_words >= 8) & ~F.lit(TERMINAL).contains(F.right(bare, F.lit(1)))
    symbols = occurrences(line, SYMBOLS) * 10 > F.char_length(bare)
    shouting = occurrences(line, "!") * 3 > n_words + 2
    separators = sum((F.char_length(line) - F.char_length(F.replace(line, F.lit(s), F.lit("")))) / len(s) for s in NAVIGATION)
    menu = (separators >= 3) & (separators * 4 >= n_words)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | small.contains(p)
    return no_end | symbols | shouting | menu | phrase


def evaluate(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Adds the counts, the cleaned text and the verdict to every row of ``docs``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``cleaned`` (the text without its failed lines; blank lines stay),
    ``lost_chars`` (characters of failed lines) and ``kept``. A null or empty text has no words,
    so it fails. Every row is judged alone: no shuffle. Text columns of ``docs`` other than
    ``text`` pass through; columns with the added names are replaced.

    Repeated windows are found by hash inside the row: windows are hashed once, and only texts
    whose hashes are not all different sort them.
    """
    keep = docs.columns
    words = docs.withColumn("_t", text_of()).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    hashed = words.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": occurrences(F.col("_t"), SYMBOLS).cast("bigint"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
            "_lines": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    ).drop("_w")
    grams = hashed.withColumn(
        "_g",
        F.when(
            F.col("n_words") >= GRAM,
            let(F.col("_h"), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(h, i, GRAM)))),
        ),
    ).drop("_h")
    pairs = grams.withColumn(
        "_p",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    ).drop("_g")
    same = lambda a, p, k: F.coalesce(p["g"] == F.get(a, k)["g"], F.lit(False))
    found = let(F.col("_p"), lambda a: F.filter(a, lambda p, k: same(a, p, k - 1) | same(a, p, k + 1)))
    at = pairs.withColumn("_at", F.sort_array(F.transform(found, lambda p: p["i"]))).drop("_p")
    step = let(F.col("_at"), lambda a: F.transform(a, lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(a, k + 1) - p, F.lit(GRAM)))))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    failed = at.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_out": let(
                let(
                    F.split(F.lower("_t"), "\n", -1),
                    lambda small: F.transform(
                        F.split("_t", "\n", -1),
                        lambda x, i: F.struct(x.alias("line"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x, F.get(small, i))).alias("bad")),
                    ),
                ),
                lambda judged: F.struct(
                    F.char_length(F.array_join(F.transform(F.filter(judged, lambda j: j["bad"]), lambda j: j["line"]), "")).cast("bigint").alias("lost"),
                    F.array_join(F.transform(F.filter(judged, lambda j: ~j["bad"]), lambda j: j["line"]), "\n").alias("cleaned"),
                ),
            ),
        }
    ).drop("_at", "_lines")
    judged = failed.withColumns(
        {
            "lost_chars": F.col("_out.lost"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "cleaned": F.col("_out.cleaned"),
        }
    ).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.char_length("_t")))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost_chars", "kept"]
    return judged.select(*[F.col(f"`{c}`") for c in keep if c not in added], *added)


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their cleaned text; ``n_chars`` follows the text.

    Rows that fail are left out by ``inline`` of no element instead of a filter: a filter would be
    moved below the steps of the evaluation, and its condition would repeat all of them.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    judged = evaluate(docs.select("text", others.alias("_doc"))).select("_doc", "cleaned", "kept")
    kept = judged.select(F.inline(F.when(F.col("kept"), F.array(F.struct("_doc", "cleaned")))))
    new = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("bigint")}
    return kept.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def _sql() -> str:
    terminal = TERMINAL.replace("'", "''")
    separators = " + ".join(f"(length(x) - length(replace(x, '{s}', ''))) / {len(s)}" for s in NAVIGATION)
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + {GRAM - 1}], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM w WHERE len(w) >= {GRAM})),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least({GRAM}, coalesce(nxt - i, {GRAM}))) AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM f) GROUP BY r),
ln AS (SELECT r, x, rtrim(translate(x, chr(13) || chr(9) || chr(11) || chr(12), '    '), ' ') AS bare FROM (SELECT r, unnest(l) AS x FROM w)),
lw AS (SELECT r, x, bare, length(bare) - length(replace(bare, ' ', '')) + 1 AS n FROM ln),
lf AS (SELECT r, length(x) AS chars,
         (n >= 8 AND NOT contains('{terminal}', right(bare, 1)))
         OR (length(x) - length(translate(x, '{SYMBOLS}', ''))) * 10 > length(bare)
         OR (length(x) - length(replace(x, '!', ''))) * 3 > n + 2
         OR (({separators}) >= 3 AND ({separators}) * 4 >= n)
         OR {phrases} AS bad
       FROM lw),
lost AS (SELECT r, sum(chars) FILTER (bad) AS lost FROM lf GROUP BY r),
s AS (SELECT w.r, doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN c USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * length(t) AS kept, lost::BIGINT AS lost_chars
FROM b
"""


SQL = _sql()
