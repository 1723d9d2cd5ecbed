"""Quotation linking: quoted passages point to the message they come from; quotes are then dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.llm.common import SPACE, stage, text_of
from regimeweave.operators.ordering import with_position

MARK = r"^[ \t]{0,3}(?:>[ \t]?)+"
BLOCK = 4096


def quote_level(line: Column) -> Column:
    """Number of ``>`` marks that open the line."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def quoted_body(line: Column) -> Column:
    return F.regexp_replace(line, MARK, "")


def passage_key(body: Column) -> Column:
    """Digest of the line in lower case with single spaces; null for a line without a word."""
    normal = F.lower(F.trim(F.regexp_replace(body, SPACE, " ")))
    return F.when(normal != "", F.md5(normal))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every row of ``messages`` (conv_id, turn, role, text) with its place in the replies.

    Adds ``body`` (the text without quoted lines, trimmed), ``n_quoted`` (quoted lines),
    ``quote_depth`` (deepest level), ``parent_turn`` (the earlier turn that most lines of its outermost
    linked level come from, the latest among equals), ``thread_root``, ``reply_depth`` and ``position``: the 0-based
    place in the conversation when threads follow each other by root and each reply follows its
    parent. A quote that matches no earlier own line links to nothing. Null text is empty; a
    null conversation is one conversation; a null turn comes last and is linked to nothing. Rows that repeat
    a turn are each a message; links go to the turn.

    A passage is matched line by line, so partial quotes link too. Own lines are reduced to the
    first turn of each (conversation, digest) before they meet the quoted lines: the join is
    many-to-one however common a line is. Roots are found by pointer doubling, so a chain of any
    length takes a logarithmic number of rounds. No conversation is gathered in one task.
    """
    own_columns = [c for c in messages.columns if c in ("conv_id", "turn", "role")]
    lines = F.split("_t", "\n", -1)
    parsed = stage(
        messages.select(*own_columns, text_of().alias("_t")).select(
            *own_columns,
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"),
            F.transform(F.filter(lines, lambda x: quote_level(x) > 0), lambda x: F.struct(quote_level(x).alias("level"), passage_key(quoted_body(x)).alias("key"))).alias("_quotes"),
            F.filter(lines, lambda x: quote_level(x) == 0).alias("_own"),
            F.xxhash64("_t").alias("_tie"),
        )
    )
    message = ["_c", "turn"]
    own = parsed.where("turn is not null").select("_c", F.col("turn").alias("_from"), F.explode("_own").alias("_line"))
    firsts = own.select("_c", "_from", passage_key(F.col("_line")).alias("key")).where("key is not null").groupBy("_c", "key").agg(F.min("_from").alias("_from"))
    quotes = parsed.where("turn is not null").select(*message, F.explode("_quotes").alias("q")).select(*message, "q.level", "q.key")
    found = quotes.where("key is not null").join(firsts, ["_c", "key"]).where("_from < turn")
    votes = found.groupBy(*message, "level", "_from").agg(F.count("*").alias("n"))
    parents = votes.groupBy(*message).agg(F.max(F.struct(-F.col("level"), "n", "_from"))["_from"].alias("parent_turn"))

    turns = parsed.where("turn is not null").select(*message).distinct()
    links = turns.join(parents, message, "left")
    up = stage(links.select(*message, F.coalesce("parent_turn", "turn").alias("_up"), F.col("parent_turn").isNotNull().cast("bigint").alias("_far")))
    while True:
        above = up.select("_c", F.col("turn").alias("_up"), F.col("_up").alias("_up2"), F.col("_far").alias("_far2"))
        up2 = stage(up.join(above, ["_c", "_up"]).select("_c", "turn", F.col("_up2").alias("_up"), (F.col("_far") + F.col("_far2")).alias("_far"), (F.col("_far2") > 0).alias("_moved")))
        moved = up2.where("_moved").limit(1).count()
        up = up2.drop("_moved")
        if not moved:
            break
    roots = up.join(parents, message, "left").select(*message, "parent_turn", F.col("_up").alias("thread_root"), F.col("_far").alias("reply_depth"))
    placed = parsed.join(roots, message, "left").withColumns(
        {"_root": F.coalesce("thread_root", F.lit(2**62)), "_turn": F.coalesce("turn", F.lit(2**62)).cast("bigint")}
    )
    block = F.struct("_root", F.floor(F.col("_turn") / BLOCK).alias("b"))
    ordered = with_position(placed, ["_c"], ["_root", "_turn", "_tie"], block, "position")
    return ordered.select(
        *own_columns,
        F.trim(F.array_join("_own", "\n"), F.lit(" \n\t\r")).alias("body"),
        F.size("_quotes").cast("bigint").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("_quotes", lambda q: q["level"])), F.lit(0)).cast("bigint").alias("quote_depth"),
        "parent_turn",
        "thread_root",
        F.coalesce("reply_depth", F.lit(0)).cast("bigint").alias("reply_depth"),
        F.col("position").cast("bigint").alias("position"),
    )


_LEVEL = r"len(regexp_replace(regexp_extract(x, '^[ \t]{0,3}(?:>[ \t]?)+'), '[^>]', '', 'g'))"
SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT r, conv_id, turn, x, {_LEVEL} AS lv,
             lower(trim(regexp_replace(regexp_replace(x, '^[ \t]{{0,3}}(?:>[ \t]?)+', ''), '[\x20\x09-\x0D]+', ' ', 'g'))) AS k
      FROM (SELECT r, conv_id, turn, unnest(string_split(t, chr(10))) AS x FROM m)),
f AS (SELECT conv_id, k, min(turn) AS src FROM l WHERE lv = 0 AND k <> '' GROUP BY ALL),
v AS (SELECT l.conv_id, l.turn, lv, src, count(*) AS n FROM l JOIN f USING (conv_id, k) WHERE lv > 0 AND k <> '' AND src < l.turn GROUP BY ALL),
p AS (SELECT conv_id, turn, src AS parent_turn FROM v
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY lv, n DESC, src DESC) = 1),
t AS (SELECT DISTINCT conv_id, turn, parent_turn FROM m LEFT JOIN p USING (conv_id, turn)),
u AS (SELECT conv_id, turn, parent_turn, turn AS root, 0 AS depth FROM t WHERE parent_turn IS NULL
      UNION ALL SELECT t.conv_id, t.turn, t.parent_turn, u.root, u.depth + 1 FROM t JOIN u ON t.conv_id = u.conv_id AND t.parent_turn = u.turn),
q AS (SELECT r, count(*) FILTER (lv > 0) AS n_quoted, max(lv) AS quote_depth FROM l GROUP BY r)
SELECT m.conv_id, m.turn, role, trim(array_to_string(list_filter(string_split(t, chr(10)), lambda x: {_LEVEL} = 0), chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS body,
       n_quoted, quote_depth::BIGINT AS quote_depth, parent_turn, root AS thread_root, depth::BIGINT AS reply_depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY root, m.turn) - 1 AS position
FROM m JOIN u USING (conv_id, turn) JOIN q USING (r)
"""
