"""Chat formatting from every participant's view, with DataFrame operations only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; system turns stay system turns. A rendered dialogue is its segments, one per turn, in order: each has its
text, its place in the dialogue, and the span that is trained on (what the assistant of this view says, with the end
marker). Segments are rows, so a conversation with a third of all turns is no task of its own. Turns are dealt to blocks;
lengths are summed per block, prefix sums over blocks give where each block of each view begins, and texts are shuffled
once, to their blocks, where a running sum places them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side

START, END = "<|im_start|>", "<|im_end|>\n"
#: Markers inside a text or a name get a space, so that no text can open or close a turn.
MARKER, HARMLESS = r"<\|(im_start|im_end)\|>", "< |$1|>"
#: Turn numbers in a block, and turns from which on a block is split by turn number and by hash.
BLOCK, MOST = 256, 4096


def _opening(role: Column, speaker: Column) -> Column:
    name = F.translate(F.regexp_replace(speaker, MARKER, HARMLESS), "\r\n\t", "   ")
    return F.when(role == "user", F.concat(F.lit(f"{START}user name="), name, F.lit("\n"))).otherwise(F.concat(F.lit(START), role, F.lit("\n")))


def _role(speaker: Column, perspective: Column | str, system: str) -> Column:
    return F.when(speaker == system, "system").when(speaker == perspective, "assistant").otherwise("user")


def _in_blocks(turns: DataFrame, block: int, most: int) -> DataFrame:
    """turns with `block` (a struct with an order): a run of turn numbers, or, where that holds over `most` turns, a part
    of one turn number's turns, by ranges of the key that orders them."""
    run = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    per_turn = turns.groupBy("conv_key", run.alias("run"), "turn").agg(F.count("*").alias("n"))
    full = per_turn.withColumn("all", F.sum("n").over(Window.partitionBy("conv_key", "run"))).where(F.col("all") > most)
    full = full.select(F.col("conv_key").alias("of_conv"), F.col("turn").alias("of_turn"), F.ceil(F.col("n") / block).alias("parts"))
    split = turns.join(small_side(full), (F.col("conv_key") == F.col("of_conv")) & F.col("turn").eqNullSafe(F.col("of_turn")), "left")
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(1 << 32))
    at = F.struct(run.alias("run"), F.when(F.col("parts").isNotNull(), F.col("turn")).alias("turn"), F.coalesce(part, F.lit(0)).alias("part"))
    return split.withColumn("block", at).drop("of_conv", "of_turn", "parts")


def perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", block: int = BLOCK, most: int = MOST) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, char_start, char_end, mask_start, mask_end.

    One row per turn and participant of its conversation. role is assistant, user or system; offsets count characters
    of the dialogue as this participant's view renders it; the mask is null where nothing is trained on. A conversation
    with system turns alone has no view. A null text counts as empty, a null speaker is the participant ''; null
    conversation ids are one conversation, a null turn comes first; turns that share a number go by the md5 of speaker,
    a line feed and text. Markers in texts and names are made harmless, and line breaks in names become spaces.
    """
    conv, speaker = F.col(conv_col), F.coalesce(F.col(speaker_col).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text_col), F.lit(""))
    t = turns.select(
        conv.alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.regexp_replace(raw, MARKER, HARMLESS).alias("text"),
        F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("+"), conv.cast("string"))).alias("conv_key"), F.md5(F.concat(speaker, F.lit("\n"), raw)).alias("key"),
    )
    t = _in_blocks(t, block, most)
    # Lengths as if nobody were the assistant; a view differs by a constant for each turn of its participant.
    said, as_user = F.length("text").cast("long") + len(END), F.length(_opening(_role(F.col("speaker"), F.lit(None), system), F.col("speaker")))
    units = t.groupBy("conv_key", "block", "speaker").agg(F.sum(said + as_user).alias("n"), F.count("*").alias("turns"))
    blocks = units.groupBy("conv_key", "block").agg(F.sum("n").alias("n"))
    views = units.where(F.col("speaker") != system).select("conv_key", F.col("speaker").alias("perspective")).distinct()
    own = units.select("conv_key", "block", F.col("speaker").alias("perspective"), "turns")
    less = F.length(_opening(F.lit("user"), F.col("perspective"))) - F.length(_opening(F.lit("assistant"), F.col("perspective")))
    here = F.col("n") - less * F.coalesce("turns", F.lit(0))
    placed = blocks.join(views, "conv_key").join(own, ["conv_key", "block", "perspective"], "left").select("conv_key", "block", "perspective", here.alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("conv_key", "perspective").orderBy("block")) - F.col("here")
    starts = placed.select("conv_key", "block", "perspective", ahead.alias("start"))
    role = _role(F.col("speaker"), F.col("perspective"), system)
    # Never a broadcast: the join deals texts to their blocks, and the window stays there.
    rows = t.join(starts.hint("merge"), ["conv_key", "block"]).withColumn("role", role).withColumn("opening", _opening(F.col("role"), F.col("speaker")))
    rows = rows.withColumn("n", F.length("opening") + said)
    inside = Window.partitionBy("conv_key", "block", "perspective").orderBy(F.asc_nulls_first("turn"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("char_end", F.col("start") + F.sum("n").over(inside)).withColumn("char_start", F.col("char_end") - F.col("n"))
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", "role", F.concat("opening", "text", F.lit(END)).alias("segment"), "char_start", "char_end",
        F.when(trained, F.col("char_start") + F.length("opening")).alias("mask_start"), F.when(trained, F.col("char_end")).alias("mask_end"),
    )


#: Characters of a dialogue from which on a new part begins.
PART = 1 << 16


def dialogues(segments: DataFrame, part: int = PART) -> DataFrame:
    """Segments of perspectives() -> conv_id, perspective, part, text, spans: the dialogue put together, a part for the
    segments that begin within the same `part` characters of it, so that a row stays bounded for any number of turns;
    spans are trained, in part's characters."""
    part = F.floor(F.col("char_start") / part).alias("part")
    grouped = segments.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(F.struct("char_start", "segment", "mask_start", "mask_end"))).alias("s"))
    first = F.col("s")[0]["char_start"]
    return grouped.select(
        "conv_id", "perspective", "part", F.array_join(F.col("s.segment"), "").alias("text"),
        F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct((x["mask_start"] - first).alias("start"), (x["mask_end"] - first).alias("end"))).alias("spans"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g') AS text,
             translate(regexp_replace(coalesce(role, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g'), chr(13) || chr(10) || chr(9), '   ') AS name FROM conversations),
v AS (SELECT DISTINCT conv_id AS vc, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN v ON conv_id IS NOT DISTINCT FROM vc),
s AS (SELECT *, CASE WHEN role = 'user' THEN '<|im_start|>user name=' || name || chr(10) ELSE '<|im_start|>' || role || chr(10) END AS opening,
             text || '<|im_end|>' || chr(10) AS body FROM r),
e AS (SELECT *, CAST(length(opening) + length(body) AS BIGINT) AS n, CAST(sum(length(opening) + length(body)) OVER (
             PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, md5(speaker || chr(10) || raw) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM s)
SELECT conv_id, perspective, turn, speaker, role, opening || body AS segment, char_end - n AS char_start, char_end,
       CASE WHEN role = 'assistant' THEN char_end - n + length(opening) END AS mask_start, CASE WHEN role = 'assistant' THEN char_end END AS mask_end
FROM e
"""
