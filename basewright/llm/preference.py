"""Preference formatting of conversation pairs, in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text) is rendered once as the
prompt; what follows in each is its completion, rendered turn by turn with a mask: 1 for turns to learn from (TRAINED roles),
0 for the others, and with the spans of the text to learn from, start:end in characters of the completion. The spans hold
even where a text contains the template's own marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, small_enough, table

#: Openings (a hash and two ids each) up to which they are broadcast.
BROADCAST_ROWS = 100_000

#: Fixed values of the template.
START, END, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == TRAINED, "1").otherwise("0")), ",")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's (role, text) in order of turn, then role, then text; one row holds one conversation."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", empty("role"), empty("text")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _spans(turns: Column) -> Column:
    head, tail = len(START) + 1, len(END)
    state = lambda pos, out: F.struct(pos.alias("pos"), out.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + head + F.length(t["role"])
        end = start + F.length(t["text"])
        own = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return state(end + tail, F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]))

    return F.array_join(F.aggregate(turns, state(F.lit(0), F.array().cast("array<string>")), step, lambda acc: acc["out"]), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen_id, rejected_id, a, b), a and b turns -> pair_id, chosen_id, rejected_id, n_prompt, prompt, and of chosen and rejected the text, _mask and _spans."""
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    out = pairs.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    sides = [f(rest(c)).alias(name + suffix) for name, c in (("chosen", "a"), ("rejected", "b")) for suffix, f in (("", _rendered), ("_mask", _mask), ("_spans", _spans))]
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt"), _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), *sides)


def preference_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen_id, rejected_id) -> as formatted.

    Defined cases: a missing conversation (null or unknown id) has no turns, so the prompt is empty too; equal conversations leave both completions
    empty; null roles and texts count as empty; turns with equal numbers are ordered by role and text; repeated rows are
    repeated turns; rows without conv_id belong to no conversation; empty tables give no rows; extra columns are ignored.
    """
    return paired(conversation_turns(conversations), pairs)


def paired(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """preference_pairs of conversation_turns. Where one conversation is in many pairs, turns should be checkpointed, so that Spark can split the join."""
    side = lambda name: turns.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    out = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    return formatted(out.select("pair_id", "chosen_id", "rejected_id", F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b")))


def neighbour_ids(turns: DataFrame) -> DataFrame:
    """Of conversation_turns: conversations 2k (chosen) and 2k + 1 (rejected) as pair k; a pair with one of them missing is kept."""
    k = F.floor(F.col("conv_id") / 2).cast("long")
    ids = turns.select(k.alias("pair_id"), "conv_id")
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1
    return ids.groupBy("pair_id").agg(F.max(F.when(~odd, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(odd, F.col("conv_id"))).alias("rejected_id"))


def opening_ids(turns: DataFrame) -> DataFrame:
    """Of conversation_turns: every conversation (rejected, its id is the pair's) with the least one (chosen) that begins with the same turn, itself left out."""
    first = turns.select("conv_id", F.sha2(F.to_json(F.col("turns")[0]), 256).alias("opening"))
    least = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("last")).where("chosen_id < last")
    least = checkpointed(least)  # so that a common opening's join is one that Spark can split
    return first.join(F.broadcast(least) if small_enough(least, BROADCAST_ROWS) else least, "opening").where("conv_id <> chosen_id").select(F.col("conv_id").alias("pair_id"), "chosen_id", F.col("conv_id").alias("rejected_id"))


def retry_pairs(turns: DataFrame) -> DataFrame:
    """Of conversation_turns: conversations cut after their last TRAINED turn (chosen) and the same with that turn replaced by the TRAINED one before it
    (rejected), as formatted; conversations with fewer than two such turns have no pair."""
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED)
    cut = turns.withColumn("at", places).where(F.size("at") > 1)
    last, before = F.element_at("at", -1), F.element_at("at", -2)
    a, b = F.slice("turns", F.lit(1), last), F.concat(F.slice("turns", F.lit(1), last - 1), F.array(F.element_at("turns", before)))
    return formatted(cut.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), a.alias("a"), b.alias("b")))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of three kinds: neighbours, conversations with one opening, and retries within a conversation."""
    turns = checkpointed(conversation_turns(table(spark, sf_dir, "conversations")))
    kinds = [("neighbours", paired(turns, neighbour_ids(turns))), ("opening", paired(turns, opening_ids(turns))), ("retry", retry_pairs(turns))]
    out = [df.select(F.lit(kind).alias("kind"), *df.columns) for kind, df in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


#: DuckDB.
ORACLE = """
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
near AS (SELECT 'neighbours' AS kind, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN conv_id % 2 <> 0 THEN conv_id END) AS rejected_id
         FROM t GROUP BY 2),
first AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY turns[1]) AS least FROM t),
ids AS (SELECT * FROM near UNION ALL SELECT 'opening', conv_id, least, conv_id FROM first WHERE conv_id <> least),
cut AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS p FROM t),
j AS (SELECT ids.*, coalesce(x.turns, []) AS a, coalesce(y.turns, []) AS b FROM ids LEFT JOIN t x ON x.conv_id = chosen_id LEFT JOIN t y ON y.conv_id = rejected_id
      UNION ALL SELECT 'retry', conv_id, conv_id, conv_id, turns[1:p[-1]], list_concat(turns[1:p[-1] - 1], [turns[p[-2]]]) FROM cut WHERE len(p) > 1),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM j),
r AS (SELECT kind, pair_id, chosen_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM n)
SELECT kind, pair_id, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt, {p} AS prompt,
       {a} AS chosen, {ma} AS chosen_mask, {sa} AS chosen_spans, {b} AS rejected, {mb} AS rejected_mask, {sb} AS rejected_spans FROM r
"""
_TEXT = "array_to_string(list_transform({x}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')"
_MASKS = "array_to_string(list_transform({x}, lambda t: CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END), ',')"
_BEFORE = "CAST(coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: length(t.role) + length(t.text) + 24)), 0) AS BIGINT) + length({x}[i].role) + 13"
_PLACES = "array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: (" + _BEFORE + ") || ':' || (" + _BEFORE + " + length({x}[i].text))), ',')"
for _name, _form, _side in (("p", _TEXT, "p"), ("a", _TEXT, "a"), ("b", _TEXT, "b"), ("ma", _MASKS, "a"), ("mb", _MASKS, "b"), ("sa", _PLACES, "a"), ("sb", _PLACES, "b")):
    ORACLE = ORACLE.replace("{" + _name + "}", _form.replace("{x}", _side))
