"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering in which that speaker is the assistant, the
others are named users and only the assistant's words are trained on. A rendering is cut into blocks of
``block`` turns, so that a conversation of any length is spread over tasks; a block says where it
starts, and blocks in order give the whole rendering. Masks are half-open character ranges of the
block's text that hold the assistant's words and the mark that ends them.

Turns are ranked and blocks are placed by prefix sums in two levels: within a task's range of the
sorted turns, then over the ranges. DataFrame operations only.

Defined results: turns follow the order of turn number, then role, then text, nulls first; a null role
speaks as ``unknown``; ``system`` is no participant; null text is an empty turn; a null conversation id is a
conversation of its own; repeated rows are repeated turns; marks inside texts are broken by a backslash
so that they cannot end a turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import flag_blank, join_null_safe, materialize, shuffle_partitions

#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"


def ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and ``rank``, the turn's place in its conversation from 0."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), flag_blank(F.col("text")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    sort = [F.col(k).asc_nulls_first() for k in keys]
    spread = rows.withColumn("_any", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(shuffle_partitions(spark), *[F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "role", "_any")])
    dealt = materialize(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("own", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*sort)) - 1)
    counts = dealt.groupBy("range", "conv_id").count()
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    return join_null_safe(local, counts, ["range", "conv_id"]).select("conv_id", "role", "text", (F.col("ahead") + F.col("own")).alias("rank"))


def _rendered(turn: Column, speaker: Column) -> tuple[Column, Column]:
    """(head, words with their end mark) of a turn in the rendering for ``speaker``."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    role = F.when(turn["role"] == speaker, "assistant").when(turn["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), safe(turn["role"])))
    return F.concat(F.lit(START), role, F.lit("\n")), F.concat(safe(turn["text"]), F.lit(END + "\n"))


def rotate(conversations: DataFrame, block: int = 64) -> DataFrame:
    """conv_id, participant, block, block_start, n_turns, text, mask ("from-to" joined by commas), n_masked."""
    turns = materialize(ranked(conversations), "ranked")
    blocks = turns.withColumn("block", F.floor(F.col("rank") / block)).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns")
    )
    speakers = turns.filter("role <> 'system'").select("conv_id", F.col("role").alias("participant")).distinct()
    both = join_null_safe(blocks, speakers, ["conv_id"])

    def step(acc: Column, turn: Column) -> Column:
        head, words = _rendered(turn, F.col("participant"))
        begin = acc["at"] + F.length(head)
        # the line break that follows the end mark is not trained on
        end = begin + F.length(words) - 1
        own = turn["role"] == F.col("participant")
        return F.struct(
            (end + 1).alias("at"), F.array_append(acc["parts"], F.concat(head, words)).alias("parts"),
            F.when(own, F.array_append(acc["mask"], F.concat_ws("-", begin, end))).otherwise(acc["mask"]).alias("mask"),
            (acc["n"] + F.when(own, end - begin).otherwise(0)).alias("n"),
        )

    none = F.expr("cast(array() as array<string>)")
    walked = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("parts"), none.alias("mask"), F.lit(0).alias("n")), step)
    made = both.select("conv_id", "participant", "block", F.size("turns").cast("long").alias("n_turns"), walked.alias("w"))
    made = materialize(made.select(
        "conv_id", "participant", "block", "n_turns", F.array_join("w.parts", "").alias("text"), F.array_join("w.mask", ",").alias("mask"),
        F.col("w.n").cast("long").alias("n_masked"), F.col("w.at").cast("long").alias("chars"),
    ), "rendered")
    # 1024 blocks make a stretch: starts within a stretch, then over the stretches
    slim = made.select("conv_id", "participant", "block", F.floor(F.col("block") / 1024).alias("stretch"), "chars")
    key = ["conv_id", "participant"]
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = slim.groupBy(*key, "stretch").agg(F.sum("chars").alias("chars")).withColumn("base", F.coalesce(F.sum("chars").over(before), F.lit(0))).drop("chars")
    within = Window.partitionBy(*key, "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("ahead", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    starts = join_null_safe(slim, stretches, [*key, "stretch"]).select(*key, "block", (F.col("base") + F.col("ahead")).alias("block_start"))
    return join_null_safe(made, starts, [*key, "block"]).select(*key, "block", "block_start", "n_turns", "text", "mask", "n_masked")


ORACLE = f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank
        FROM conversations),
    speakers AS (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system'),
    rendered AS (
        SELECT t.conv_id, participant, rank, CAST(floor(rank / 64.0) AS BIGINT) AS block, role = participant AS own,
               '{START}' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
                                 ELSE 'user name=' || replace(role, '<|', '<\\|') END || chr(10) AS head,
               replace(text, '<|', '<\\|') || '{END}' || chr(10) AS words
        FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
    placed AS (
        SELECT *, coalesce(sum(length(head) + length(words)) OVER (PARTITION BY conv_id, participant ORDER BY rank
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM rendered),
    based AS (SELECT *, min(place) OVER (PARTITION BY conv_id, participant, block) AS block_start FROM placed)
    SELECT conv_id, participant, block, CAST(any_value(block_start) AS BIGINT) AS block_start, count(*) AS n_turns,
           string_agg(head || words, '' ORDER BY rank) AS text,
           coalesce(string_agg(CASE WHEN own THEN CAST(place - block_start + length(head) AS BIGINT) || '-' || CAST(place - block_start + length(head) + length(words) - 1 AS BIGINT) END, ',' ORDER BY rank), '') AS mask,
           CAST(sum(CASE WHEN own THEN length(words) - 1 ELSE 0 END) AS BIGINT) AS n_masked
    FROM based GROUP BY conv_id, participant, block"""
