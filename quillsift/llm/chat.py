"""Perspective rotation: every participant's view of a dialogue, in DataFrame functions only.

For each participant the whole dialogue is rendered with that speaker as the assistant, all others as named users
and system turns as they are; the loss mask covers what the assistant says, its end marker included. A view of at
most WINDOW turns is one row; a longer one goes on in further rows, so that no conversation is ever gathered in one
place, and `start` is a row's place in the whole rendered dialogue. The output has a view of every turn for every
participant, which is what rotation means: participants times turns.

Turns are numbered within their conversation by counts of blocks of turn numbers and, inside a block, by a sort that
spills; texts are gathered once, at most WINDOW turns at a time, and places are summed over lengths alone.

Defined results: every turn is kept, repeated ones as often as they occur; turns are ordered by number, speaker and
text, those without a number last; a null text is empty, a null role is the speaker `unknown`; markers inside a text
or a role are broken by a space, so neither can open or close a turn; a very long text is one turn like any other; a
conversation of system turns alone has no participant and no rows; a null conversation is one; an empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns of a row at most, blocks that are summed at once, the role that nobody's perspective takes.
WINDOW, RUN, CONTEXT = 256, 1024, "system"
END = "<|end|>\n"
OWN, SYSTEM, NAMED = "<|assistant|>\n", "<|system|>\n", ("<|user name=", "|>\n")
CONV = ("c", "c_null")


def _broken(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _before(rows: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """rows with `before`, the sum of value over the rows of equal keys that come first. Rows are summed in runs of RUN
    places, and the runs' sums once more."""
    rows = rows.withColumn("_run", F.floor(F.col(order) / RUN))
    ahead = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum")).select(*keys, "_run", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(runs, [*keys, "_run"])
    return both.withColumn("before", F.col("_base") + F.col("_own")).drop("_run", "_base", "_own")


def _windows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, c_null, w, own): the turns of each window of WINDOW turns of a conversation, in order."""
    kind = turns.schema[conv].dataType.simpleString()
    said = turns.select(
        F.coalesce(F.col(conv), F.lit("0").cast(kind)).alias("c"), F.col(conv).isNull().alias("c_null"), F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("who"), _broken(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    ).withColumn("part", F.coalesce(F.floor(F.col("t") / WINDOW).cast("long"), F.lit(2**53)))
    sizes = _before(said.groupBy(*CONV, "part").agg(F.count("*").alias("n")), CONV, "part", "n").select(*CONV, "part", "before")
    place = F.row_number().over(Window.partitionBy(*CONV, "part").orderBy("t", "who", "body"))
    numbered = said.withColumn("at", place).join(sizes, [*CONV, "part"]).withColumn("at", F.col("before") + F.col("at") - 1)
    own = F.sort_array(F.collect_list(F.struct("at", "who", "body")))
    return numbered.groupBy(*CONV, F.floor(F.col("at") / WINDOW).cast("long").alias("w")).agg(own.alias("own"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, perspective, window, n_turns, text, masks as start:end pairs in code points, start). conv: text or a number."""
    windows = cut(_windows(turns, conv, turn, role, text), "chat")
    kind = turns.schema[conv].dataType
    head = lambda who: F.when(who == CONTEXT, F.lit(SYSTEM)).otherwise(F.concat(F.lit(NAMED[0]), _broken(who), F.lit(NAMED[1])))
    spoken = windows.select(*CONV, "w", F.explode("own").alias("x")).select(*CONV, "w", F.col("x.who").alias("perspective"), F.length(head(F.col("x.who"))).cast("long").alias("head"), F.length("x.body").alias("n"))
    mine = spoken.where(F.col("perspective") != CONTEXT).groupBy(*CONV, "w", "perspective").agg(F.sum(F.col("head") - len(OWN)).alias("less"))
    whole = spoken.groupBy(*CONV, "w").agg(F.sum(F.col("head") + F.col("n") + len(END)).alias("whole"))
    seats = mine.select(*CONV, "perspective").distinct()
    views = whole.join(seats, list(CONV)).join(mine, [*CONV, "w", "perspective"], "left").withColumn("size", F.col("whole") - F.coalesce("less", F.lit(0)))
    views = _before(views, (*CONV, "perspective"), "w", "size").select(*CONV, "w", "perspective", F.col("before").alias("start"))
    rows = windows.join(views, [*CONV, "w"])
    shown = F.transform("own", lambda x: F.struct(F.when(x["who"] == F.col("perspective"), F.lit(OWN)).otherwise(head(x["who"])).alias("head"), x["body"].alias("body"), (x["who"] == F.col("perspective")).alias("mine")))
    rows = rows.withColumn("shown", shown)
    end = END.replace("\n", "\\n")
    return rows.select(
        F.when(~F.col("c_null"), F.col("c")).cast(kind).alias(conv), "perspective", F.col("w").alias("window"), F.size("own").cast("long").alias("n_turns"),
        F.expr(f"array_join(transform(shown, x -> concat(x.head, x.body, '{end}')), '')").alias("text"),
        F.expr(f"""aggregate(shown, named_struct('at', 0, 'out', cast(array() as array<string>)),
            (a, x) -> named_struct('at', a.at + length(x.head) + length(x.body) + {len(END)},
                'out', CASE WHEN x.mine THEN concat(a.out, array(concat(a.at + length(x.head), ':', a.at + length(x.head) + length(x.body) + {len(END)}))) ELSE a.out END),
            a -> array_join(a.out, ','))""").alias("masks"),
        "start",
    )


_BROKEN = "replace(replace({}, '<|', '< |'), '|>', '| >')".format
ORACLE = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, {_BROKEN("coalesce(text, '')")} AS body FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, body) - 1 AS k FROM s),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM s WHERE who <> '{CONTEXT}'),
b AS (SELECT n.*, p.perspective, k // {WINDOW} AS w,
  CASE WHEN who = perspective THEN '<|assistant|>' || chr(10) WHEN who = '{CONTEXT}' THEN '<|system|>' || chr(10) ELSE '<|user name=' || {_BROKEN("who")} || '|>' || chr(10) END AS head FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
l AS (SELECT *, head || body || '<|end|>' || chr(10) AS piece,
  coalesce(sum(length(head) + length(body) + {len(END)}) OVER (PARTITION BY conv_id, perspective, w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
g AS (SELECT conv_id, perspective, w, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN who = perspective THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(body) + {len(END)} AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS masks FROM l GROUP BY ALL)
SELECT conv_id, perspective, w AS "window", n_turns, text, masks,
  CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM g
"""
