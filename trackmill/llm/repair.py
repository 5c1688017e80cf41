"""Conversation repair: a fold over a conversation's turns that carries four (cost, audit) structs.

Windows flag each turn's first fault. The turns of a conversation are collected as sorted structs,
and aggregate() carries for each state of `(s?(ua)+)?` the cheapest edits that lead to it: nothing
yet, after system, after user, after assistant. Edits are told by letters whose order is that of the
audit's: D deletes, I and J insert a user or an assistant, K keeps, R and S turn the role into user
or assistant. least() on (cost, audit) is exact: two audits of equal cost over the same turns are
never one the start of the other, as what is longer holds more inserts and costs more.

Only SQL functions are used. One shuffle, by conversation: both windows and the fold share it. A
conversation's turns must fit in a task, as its repaired text is digested as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.sources.tables import table

#: Costs of edits; MORE is added for every turn that stays truncated; NEVER is above any cost.
DELETE, REROLE, INSERT, MORE, NEVER = 4, 3, 3, 3, 1 << 40
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
NOWHERE = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, k_copy, k_there: rows damaged by crc32(conv_id:turn) mod 20, nulls
    read as one space (a null turn stays null in its column). Dropped rows stay, with k_there false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return turns.select(
        F.col("conv_id"), F.col("turn"), F.when(code == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (code != 0).alias("k_there"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k_copy"),
    )


def _step(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.struct((state["c"] + cost).alias("c"), F.concat(state["a"], letter).alias("a"))


def _states(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    return F.struct(s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))


def _inserted(x: Column) -> Column:
    """The states, where any number of inserts may follow."""
    s2 = F.least(x["s2"], _step(x["s0"], INSERT, "I"), _step(x["s1"], INSERT, "I"), _step(x["s3"], INSERT, "I"))
    half = F.array(_states(x["s0"], x["s1"], s2, x["s3"]))
    return F.transform(half, lambda y: _states(y["s0"], y["s1"], y["s2"], F.least(y["s3"], _step(y["s2"], INSERT, "J"))))[0]


def _turn(x: Column, r: Column) -> Column:
    """The states after one more turn r: deleted, kept, or with another role."""
    more = F.when(r["gone"], NEVER).when(r["cut"], MORE).otherwise(0).cast("long")
    user, helper = r["first"] == "u", r["first"] == "a"
    to_user = lambda s: _step(s, more + F.when(user, 0).otherwise(REROLE), F.when(user, "K").otherwise("R"))
    raw = _states(
        _step(x["s0"], DELETE, "D"),
        F.least(_step(x["s1"], DELETE, "D"), _step(x["s0"], F.when(r["first"] == "s", more).otherwise(NEVER), "K")),
        F.least(_step(x["s2"], DELETE, "D"), to_user(x["s0"]), to_user(x["s1"]), to_user(x["s3"])),
        F.least(_step(x["s3"], DELETE, "D"), _step(x["s2"], more + F.when(helper, 0).otherwise(REROLE), F.when(helper, "K").otherwise("S"))),
    )
    return F.transform(F.array(raw), _inserted)[0]


def _one(cost: int, audit: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("c"), F.lit(audit).alias("a"))


def _repaired(rows: Column, edits: Column) -> Column:
    """The lines of the repaired conversation, each with its line end, out of rows and edit letters."""
    added = lambda run: F.replace(F.replace(run, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))
    runs, ops = F.split(edits, "[DKRS]", -1), F.split(F.translate(edits, "IJ", ""), "")

    def line(r: Column, i: Column) -> Column:
        op = F.get(ops, i)
        role = F.when(op == "R", "user").when(op == "S", "assistant").otherwise(r["role"])
        return F.concat(added(F.get(runs, i)), F.when(op == "D", "").otherwise(F.concat(role, F.lit(":"), r["text"], F.lit("\n"))))

    return F.concat(F.array_join(F.transform(rows, line), ""), added(F.get(runs, F.size(rows))))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, of rows
    as damaged() gives them; where k_there is false a row only names its conversation.

    Rows are taken by turn (nulls first), of equal turns by role, text and copy. A role of no letters
    has no initial: such rows can't be kept as they are. A null conv_id is a conversation of its own;
    repeated rows are duplicates; a conversation without rows gives zeros, an empty audit and an
    empty text; an empty table gives no rows; other columns are ignored.
    """
    order = ["turn", "role", "text", "k_copy"]
    spread = rows.select("conv_id", "turn", "role", "text", "k_copy", "k_there").repartition("conv_id")
    along = Window.partitionBy("conv_id", "k_there").orderBy(*order)
    seen = F.row_number().over(Window.partitionBy("conv_id", "k_there", "role", "text").orderBy(*order)) > 1
    first = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(VISIBLE)
    fault = F.when(blank, "blank").when(F.col("k_seen"), "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    told = spread.withColumn("k_seen", seen).select(
        "conv_id", "turn", "role", "text", "k_there", F.row_number().over(along).alias("n"), fault.alias("fault"), first.alias("first"),
        F.concat(F.lag(first).over(along), first).alias("k_pair"),
    )
    there = F.col("k_there")
    count = lambda x: F.count_if(there & x)
    turn = F.when(there, F.col("turn"))
    one = F.when(there, F.struct("n", "role", "text", "first", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), (F.coalesce(F.col("fault") == "truncated", F.lit(False))).alias("cut")))
    folded = told.groupBy("conv_id").agg(
        (F.max(turn) - F.min(turn) + 1).alias("k_span"), F.size(F.collect_set(turn)).alias("k_turns"),
        *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        count(~F.col("k_pair").isin(*NOWHERE)).alias("illegal"), F.array_sort(F.collect_list(one)).alias("k_rows"),
    )
    begin = _states(_one(0, ""), _one(NEVER, ""), _one(INSERT, "I"), _one(2 * INSERT, "IJ"))
    best = folded.withColumn("k_best", F.aggregate("k_rows", begin, _turn, lambda x: F.least(x["s0"], x["s3"])))
    return best.select(
        "conv_id", F.coalesce(F.col("k_span").cast("long") - F.col("k_turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("k_best.c").alias("cost"), F.translate("k_best.a", "JS", "IR").alias("audit"), F.regexp_replace(_repaired(F.col("k_rows"), F.col("k_best.a")), r"\n\z", "").alias("repaired"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).select("*", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256")).drop("repaired")


SQL = {
    "op12_repair": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: unicode(substr(key, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS code
  FROM named, crc_table
), rows_left AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM coded, range(2) t(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)
), placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS first, row_number() OVER w AS n, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM rows_left WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed
), costs AS (
  SELECT conv_id, n, role, text, first, CASE WHEN fault IN ('blank', 'duplicate') THEN 1099511627776 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faults
), fold AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 1099511627776, 'a': ''} AS s1, {'c': 3::BIGINT, 'a': 'I'} AS s2, {'c': 6::BIGINT, 'a': 'IJ'} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, s0, s1, t2 AS s2, list_sort([s3, {'c': t2.c + 3, 'a': t2.a || 'J'}])[1] AS s3 FROM (
    SELECT conv_id, n, s0, s1, s3, list_sort([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}])[1] AS t2 FROM (
      SELECT f.conv_id, r.n, {'c': s0.c + 4, 'a': s0.a || 'D'} AS s0,
        list_sort([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': s0.c + CASE WHEN first = 's' THEN more ELSE 1099511627776 END, 'a': s0.a || 'K'}])[1] AS s1,
        list_sort([{'c': s2.c + 4, 'a': s2.a || 'D'}] || list_transform([s0, s1, s3], lambda s: {'c': s.c + more + CASE WHEN first = 'u' THEN 0 ELSE 3 END, 'a': s.a || CASE WHEN first = 'u' THEN 'K' ELSE 'R' END}))[1] AS s2,
        list_sort([{'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': s2.c + more + CASE WHEN first = 'a' THEN 0 ELSE 3 END, 'a': s2.a || CASE WHEN first = 'a' THEN 'K' ELSE 'S' END}])[1] AS s3
      FROM fold f JOIN costs r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = f.n + 1)))
, best AS (
  SELECT conv_id, list_sort([s0, s3])[1] AS b FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), lines AS (
  SELECT c.conv_id, c.n, replace(replace(string_split_regex(b.a, '[DKRS]')[c.n], 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) ||
    CASE substr(translate(b.a, 'IJ', ''), c.n, 1) WHEN 'D' THEN '' WHEN 'R' THEN 'user:' || text || chr(10) WHEN 'S' THEN 'assistant:' || text || chr(10) ELSE role || ':' || text || chr(10) END AS line
  FROM costs c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
), ends AS (
  SELECT conv_id, replace(replace(regexp_extract(b.a, '([IJ]*)$', 1), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) AS tail FROM best
), texts AS (
  SELECT e.conv_id, coalesce(string_agg(line, '' ORDER BY n), '') || any_value(tail) AS repaired FROM ends e LEFT JOIN lines l ON e.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY e.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, translate(b.a, 'JS', 'IR') AS audit, sha256(regexp_replace(repaired, '\n\z', '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON b.conv_id IS NOT DISTINCT FROM t.conv_id
"""
}
