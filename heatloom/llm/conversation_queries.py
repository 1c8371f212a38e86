"""Damaged conversations and their repair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.conversations import repair
from heatloom.llm.crc_sql import TABLE, crc32
from heatloom.llm.registry import query, table


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planned faults; dropped rows stay with ``alive`` false, so that their
    conversations are known. Nulls are one space, in the key of the plan too."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"),
                       (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("plan"))
    plan = F.col("plan")
    text = F.when(plan == 1, "").when(plan == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(plan == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (plan != 0).alias("alive"), F.explode(F.when(plan == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


def _steps() -> str:
    """Candidate states after a row as SQL structs: state after, cost, audit and lines; ``st`` holds the states before."""
    turn = {1: 3, 2: 3, 3: 4, 4: 3}  # start, after system, after user, after assistant
    names = {3: "user", 4: "assistant"}
    out = []
    for before in turn:
        state, letters, cost, lines = before, "", 0, f"st[{before}].o"
        for _ in range(3):
            then = turn[state]
            add = lambda after, price, letter, more, when: out.append(
                f"CASE WHEN st[{before}].c < 1000000000 AND {when} THEN {{'t': {after}, 'c': st[{before}].c + {cost + price}"
                f"{'' if letter == 'D' else ' + extra'}, 'a': st[{before}].a || '{letters}{letter}', 'o': {more}}} END")
            add(state, 4, "D", lines, "true")
            add(then, 0, "K", f"list_append({lines}, role || ':' || text)", f"NOT gone AND ini = '{names[then][0]}'")
            if state == 1:
                add(2, 0, "K", f"list_append({lines}, role || ':' || text)", "NOT gone AND ini = 's'")
            add(then, 3, "R", f"list_append({lines}, '{names[then]}:' || text)", "NOT gone")
            lines, state, letters, cost = f"list_append({lines}, '{names[then]}:')", then, letters + "I", cost + 3
    return ", ".join(out)


_OFF = "{'t': 0, 'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"
REPAIR_SQL = rf"""
WITH RECURSIVE k AS (SELECT {TABLE} AS crc),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')", 'crc')} % 20 AS plan FROM conversations, k),
x AS (SELECT conv_id, turn, CASE WHEN plan = 4 THEN 'user' ELSE role END AS role, CASE WHEN plan = 1 THEN ''
  WHEN plan = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN plan = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE plan <> 0),
o AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
w(conv_id, i, st) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [{{'t': 1, 'c': 0, 'a': '', 'o': []::VARCHAR[]}}, {_OFF}, {_OFF}, {_OFF}] FROM conversations
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: coalesce(list_sort(list_filter(cand, lambda z: z.t = s))[1], {_OFF})) FROM (
    SELECT w.conv_id, g.i, [{_steps()}] AS cand FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1)),
z AS (SELECT conv_id, list_sort([{{'c': st[1].c, 'a': st[1].a, 'o': st[1].o}},
  {{'c': st[2].c + 6, 'a': st[2].a || 'II', 'o': list_concat(st[2].o, ['user:', 'assistant:'])}},
  {{'c': st[3].c + 3, 'a': st[3].a || 'I', 'o': list_append(st[3].o, 'assistant:')}},
  {{'c': st[4].c, 'a': st[4].a, 'o': st[4].o}}])[1] AS best FROM (SELECT conv_id, arg_max(st, i) AS st FROM w GROUP BY conv_id)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON z.conv_id IS NOT DISTINCT FROM n.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, root):
    return repair(damaged(table(spark, root, "conversations")), alive_col="alive")
