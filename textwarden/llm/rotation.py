"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; only the assistant's own words and end marks are to be
learned, and the mask spans say where they are. Context roles (system) are rendered as they are
and take no perspective.

A dialogue is cut into parts of ``PART`` turn numbers, so a conversation of any length is never
gathered in one place; parts in the order of (block, sub) make up the whole. Turns that crowd
under few numbers are cut further, by turn and by hash. Defined results: rows with the same turn
follow each other by a hash of role and text, a null turn comes last; a null role is ``unknown``,
a null text is empty; a null conversation is one of its own; repeated rows are turns of their
own. The opening of a marker inside a text or name is written with a backslash. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.llm.common import salted_join

CONTEXT = ("system",)
PART = 64
#: a part may hold this many times PART turns before it is cut by turn
CROWD = 4
_CONVERSATION = ["no_conv", "conv"]


def _safe(column: Column) -> Column:
    return F.replace(column, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", context: tuple[str, ...] = CONTEXT, part: int = PART) -> DataFrame:
    """(conv, perspective, block, sub, n_turns, n_own, text, spans) for every participant and part.

    ``spans`` are the half-open character ranges (first, last) of ``text`` that are learned.
    """
    conv = F.col(conv_col)
    rows = turns.select(
        conv.isNull().alias("no_conv"), conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        _safe(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"))
    empty = F.lit(0).cast(turns.schema[conv_col].dataType) if turns.schema[conv_col].dataType.typeName() != "string" \
        else F.lit("")
    rows = (rows.withColumn("conv", F.coalesce("conv", empty))
            .withColumns({"block": F.floor(F.col("turn") / part), "order": F.xxhash64("role", "body")}))
    known = rows.withColumn("block", F.coalesce("block", F.lit((1 << 62))))  # a null turn comes last
    key = [*_CONVERSATION, "block"]

    # blocks with too many turns are cut by turn, and a crowded turn by the order of its hashes
    crowded = (known.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD * part)
               .select(*key, F.lit(True).alias("crowded")))
    per_turn = (salted_join(known.select(*key, "turn", "order"), crowded, key, F.col("order"))
                .groupBy(*key, F.coalesce("turn", F.lit(0)).alias("at"))
                .agg(F.ceil(F.count(F.lit(1)) / part).alias("cuts")))
    place = F.floor((F.col("order").cast("double") / 2.0 ** 64 + 0.5) * F.col("cuts"))
    cut = (salted_join(known.withColumn("at", F.coalesce("turn", F.lit(0))), per_turn, [*key, "at"], F.col("order"), "left")
           .withColumn("sub", F.when(F.col("cuts").isNull(), F.lit(0).cast("long"))
                       .otherwise(F.pmod(F.col("at"), F.lit(part)) * (1 << 32) + F.least(place, F.col("cuts") - 1))))
    parts = (cut.groupBy(*key, "sub")
             .agg(F.sort_array(F.collect_list(F.struct("at", "order", "role", "body"))).alias("turns")))
    speakers = (known.filter(~F.col("role").isin(*context)).select(*_CONVERSATION, F.col("role").alias("perspective"))
                .distinct())
    seen = salted_join(parts, speakers, _CONVERSATION, F.struct("block", "sub"))

    system = " OR ".join(f"t.role = '{c}'" for c in context) or "false"
    head = f"""CASE WHEN {system} THEN concat('<|im_start|>', t.role, '\n')
                    WHEN t.role = perspective THEN '<|im_start|>assistant\n'
                    ELSE concat('<|im_start|>user name=', t.role, '\n') END"""
    said = seen.withColumn("said", F.expr(
        f"transform(turns, t -> named_struct('own', t.role = perspective, 'head', {head}, 'body', concat(t.body, '<|im_end|>')))"))
    walked = F.expr("""aggregate(said, named_struct('at', 0L, 'spans', cast(array() AS array<struct<first: bigint, last: bigint>>)),
        (s, t) -> named_struct(
            'at', s.at + char_length(t.head) + char_length(t.body) + 1,
            'spans', if(t.own, array_append(s.spans, named_struct('first', s.at + char_length(t.head),
                                                                  'last', s.at + char_length(t.head) + char_length(t.body))),
                        s.spans)),
        s -> s.spans)""")
    return said.select(
        F.when(~F.col("no_conv"), F.col("conv")).alias(conv_col), "perspective",
        F.when(F.col("block") < (1 << 62), F.col("block")).alias("block"), "sub",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("cast(size(filter(said, t -> t.own)) AS bigint)").alias("n_own"),
        F.expr("array_join(transform(said, t -> concat(t.head, t.body, '\n')), '')").alias("text"),
        walked.alias("spans"))
