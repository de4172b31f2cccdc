"""Conversations as marked text with a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template. A message is START role, a new line, its texts with BETWEEN, END.
START, BETWEEN, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"

#: Conversations of more than one part that are named in a broadcast; beyond it they are joined like any table.
MOST_NAMED = 100_000


def escaped(text: Column) -> Column:
    """Without any ``<|``, which all marks begin with: one backslash more between ``<`` and ``|``, however many there are."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """On one line, too: backslashes become ``\\b``, new lines ``\\n``."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def merged(turns: Column) -> Column:
    """Messages of sorted turns: the texts of neighbours with the same role in one array."""

    def add(messages: Column, turn: Column) -> Column:
        n = F.size(messages)
        last = F.get(messages, n - 1)
        alone = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        return F.when(last["role"] == turn["role"], F.concat(F.slice(messages, 1, n - 1), F.array(longer))).otherwise(
            F.concat(messages, F.array(alone))
        )

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), add)


def pieces(messages: Column, loss_roles: Column) -> Column:
    """(before, body, after, loss) of every turn in order: marks, escaped text, marks, and whether the text is learned."""

    def of_message(m: Column) -> Column:
        return F.transform(
            m["texts"],
            lambda x, k: F.struct(
                F.when(k == 0, F.concat(F.lit(START), escaped_role(m["role"]), F.lit("\n"))).otherwise(BETWEEN).alias("before"),
                escaped(x).alias("body"),
                F.when(k == F.size(m["texts"]) - 1, F.lit(END)).otherwise("").alias("after"),
                F.array_contains(loss_roles, m["role"]).alias("loss"),
            ),
        )

    return F.flatten(F.transform(messages, of_message))


def spans(of_pieces: Column) -> Column:
    """(start, length) in code points of the texts that are learned."""
    nothing = F.expr("cast(struct(0, array()) as struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>)")

    def add(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["before"])
        length = F.length(p["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + F.length(p["after"])).alias("at"),
            F.when(p["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(of_pieces, nothing, add, lambda done: done["spans"])


def formatted(
    turns: DataFrame,
    loss_roles: tuple[str, ...] = ("assistant",),
    part_turns: int = 128,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Conversations in parts: conv_id, part, formatted, loss_spans.

    The turns of a conversation stand by their numbers, those of equal numbers by role and text. Neighbours with the same
    role are one message, whose texts a mark separates; marks in texts and roles are escaped, so the turns can be read back
    (see ``turns_of``). ``loss_spans`` are the places (start, length) in code points of the texts, without any mark, of
    ``loss_roles``.

    A part holds the turns whose numbers have the same quotient by ``part_turns``, and messages end with it. So the arrays of
    a group are bounded where numbers don't repeat, a conversation with a third of all rows is spread like any other,
    and there is one shuffle. The formatted conversation is its parts in order, joined by nothing.

    A null text or role is empty. Turns without a number come first, in a part of their own with a null number; rows without a
    conversation belong to one of their own. Repeated rows are turns of their own. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.floor(F.col(turn_col) / part_turns).cast("bigint").alias("part"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    learned = F.array(*[F.lit(r) for r in loss_roles])
    return (
        rows.groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .withColumn("pieces", pieces(merged(F.col("turns")), learned))
        .select(
            "conv_id",
            "part",
            F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
            spans(F.col("pieces")).alias("loss_spans"),
        )
    )


def turns_of(text: Column) -> Column:
    """(role, text) of every turn of a formatted text, as they were before they were escaped."""
    messages = F.filter(F.split(text, r"\Q" + END + r"\E", -1), lambda m: m != "")

    def of_message(m: Column) -> Column:
        role = F.substring_index(F.substr(m, F.lit(len(START) + 1)), "\n", 1)
        body = F.substr(m, F.lit(len(START) + 2) + F.length(role))
        return F.transform(
            F.split(body, r"\Q" + BETWEEN + r"\E", -1),
            lambda x: F.struct(unescaped_role(role).alias("role"), unescaped(x).alias("text")),
        )

    return F.flatten(F.transform(messages, of_message))


def read_back(parts: DataFrame) -> DataFrame:
    """``parts`` with what the formatted text itself says: turns, and learned, the texts under the mask."""
    learned = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return parts.withColumn("turns", turns_of(F.col("formatted"))).withColumn("learned", learned)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ``parts``.

    A digest is of one value, so the texts of a conversation of several parts meet here, in one row of at most two
    gigabytes. Conversations of one part are digested where they are; which have more is found from their numbers alone, and
    said to all tasks if they are few.
    """
    several = (
        parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id"))
    )
    n_long = several.limit(MOST_NAMED + 1).count()
    read = read_back(parts).select(
        "conv_id",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    columns = ("conv_id", "n_turns", "said", "learned", "formatted_chars")
    whole = read.select(*columns)
    if n_long:
        long_id = F.broadcast(several) if n_long <= MOST_NAMED else several
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "").alias(c)
        together = (
            read.join(long_id, same, "left_semi")
            .groupBy("conv_id")
            .agg(
                F.sum("n_turns").alias("n_turns"),
                F.sum("formatted_chars").alias("formatted_chars"),
                F.sort_array(F.collect_list(F.struct("part", "said", "learned"))).alias("parts"),
            )
            .select("conv_id", "n_turns", joined("said"), joined("learned"), "formatted_chars")
        )
        whole = read.join(long_id, same, "left_anti").select(*columns).unionByName(together)
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
