"""Conversations in long form (conv_id, turn, role, text): sequencing, contexts, samples and budgets.

Everything is a window over one conversation, so one shuffle on the conversation serves a whole chain of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import rough_tokens, strip

ROLES = ("system", "user", "assistant")
# Other names of the roles.
ROLE_ALIASES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "assistant": "assistant", "system": "system"}


def by_turn():
    """A conversation's turns in order."""
    return W.partitionBy("conv_id").orderBy("turn")


def earlier():
    return by_turn().rowsBetween(W.unboundedPreceding, -1)


def normal_role(role: Column) -> Column:
    """The role an alias stands for, or null."""
    names = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    return F.try_element_at(names, F.lower(strip(role)))


def normal_messages(turns: DataFrame) -> DataFrame:
    """Known roles in lower case and contents that are not blank."""
    role = F.lower(strip(F.col("role")))
    return turns.withColumn("role", role).filter(F.col("role").isin(*ROLES) & (strip(F.col("text")) != ""))


def first_of(struct: Column, *names: str) -> Column:
    """The first field of a struct that is not null, under whichever of the names it has."""
    return F.coalesce(*[struct[n] for n in names])


def flat_content(parts: Column) -> Column:
    """An array of (type, text) as text: the text parts, a line each."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")


def prompt_samples(turns: DataFrame, *, context: int = 12, min_prompt: int = 1, min_reference: int = 1) -> DataFrame:
    """A sample for each assistant turn that directly follows a user turn: the ``context`` messages before it as prompt
    and itself as reference. Whether there was a user is asked of all earlier turns, lengths of what is kept."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    messages = normal_messages(turns).select(
        "conv_id", "turn", "role", "text", F.lag("role").over(by_turn()).alias("_before"),
        F.max(F.col("role") == "user").over(earlier()).alias("_user"),
        F.collect_list(line).over(by_turn().rowsBetween(-context, -1)).alias("_context"),
    )
    prompt = F.array_join("_context", "\n")
    kept = messages.filter((F.col("role") == "assistant") & F.col("_user") & (F.col("_before") == "user"))
    kept = kept.select("conv_id", "turn", F.size("_context").cast("long").alias("n_context"), prompt.alias("prompt"), strip(F.col("text")).alias("reference"))
    return kept.filter((F.length("prompt") >= min_prompt) & (F.length("reference") >= min_reference))


def sample_ids(samples: DataFrame, turns: DataFrame, source: str) -> DataFrame:
    """``samples`` with an id source:conversation:offset:number. The offset of a turn counts all rows of its
    conversation, kept or not; the number counts kept samples."""
    offset = turns.select("conv_id", "turn", (F.row_number().over(by_turn()) - 1).alias("_offset"))
    number = F.row_number().over(by_turn()) - 1
    return (
        samples.join(offset, ["conv_id", "turn"])
        .withColumn("id", F.concat_ws(":", F.lit(source), F.col("conv_id").cast("string"), F.col("_offset").cast("string"), number.cast("string")))
        .drop("_offset")
    )


def collapse_runs(turns: DataFrame) -> DataFrame:
    """User and assistant turns in strict alternation from user to assistant: of a run of one role the last stays, an
    assistant at the start and a user at the end go. Conversations without a pair vanish. ``pos`` counts from 1."""
    dialogue = turns.filter(F.col("role").isin("user", "assistant"))
    last = dialogue.withColumn("_next", F.lead("role").over(by_turn())).filter(F.col("_next").isNull() | (F.col("_next") != F.col("role"))).drop("_next")
    ends = last.withColumn("_first", F.lag("role").over(by_turn()).isNull()).withColumn("_last", F.lead("role").over(by_turn()).isNull())
    kept = ends.filter(~(F.col("_first") & (F.col("role") == "assistant")) & ~(F.col("_last") & (F.col("role") == "user")))
    return kept.drop("_first", "_last").withColumn("pos", F.row_number().over(by_turn()).cast("long"))


def trim_to_budget(turns: DataFrame, *, budget: int, tokens: Column | None = None) -> DataFrame:
    """System turns and the longest tail of (user, assistant) pairs whose tokens, with the system's, are within the
    budget. A conversation that keeps no pair vanishes."""
    tokens = rough_tokens(F.col("text")) if tokens is None else tokens
    systems = turns.filter(F.col("role") == "system").withColumn("tokens", tokens.cast("long"))
    pairs = collapse_runs(turns).withColumn("tokens", tokens.cast("long"))
    from_here = W.partitionBy("conv_id").orderBy(F.col("_pair").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    fixed = systems.groupBy("conv_id").agg(F.sum("tokens").alias("_fixed"))
    tail = pairs.withColumn("_pair", F.floor((F.col("pos") + 1) / 2)).withColumn("_tail", F.sum("tokens").over(from_here))
    kept = tail.join(fixed, "conv_id", "left").filter(F.col("_tail") + F.coalesce("_fixed", F.lit(0)) <= budget)
    kept = kept.select("conv_id", "turn", "role", "text", "tokens")
    return kept.unionByName(systems.select(kept.columns).join(kept.select("conv_id").distinct(), "conv_id", "left_semi"))


def drop_repeated_system(turns: DataFrame, pattern: str) -> DataFrame:
    """Without system turns, after the first, that match a pattern."""
    nth = F.sum((F.col("role") == "system").cast("int")).over(by_turn().rowsBetween(W.unboundedPreceding, W.currentRow))
    return turns.withColumn("_nth", nth).filter(~((F.col("role") == "system") & (F.col("_nth") > 1) & F.col("text").rlike(pattern))).drop("_nth")


def recent_digest(turns: DataFrame, *, pairs: int = 6, chars: int = 220) -> DataFrame:
    """(conv_id, digest): the last 2 * pairs turns in order, a line each, cut to ``chars``."""
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    line = F.concat(F.lit("- ("), F.col("turn").cast("string"), F.lit(") "), F.when(F.col("role") == "user", "user").otherwise("assistant"), F.lit(": "), F.substring("text", 1, chars))
    last = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2 * max(1, pairs))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("digest"))


def partner_context(turns: DataFrame) -> DataFrame:
    """``turns`` with ``partner``: the nearest earlier text of the other one of user and assistant."""
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(earlier())
    return turns.withColumn("partner", F.when(F.col("role") == "user", last("assistant")).when(F.col("role") == "assistant", last("user")))


def last_by_role(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))


def history(turns: DataFrame, *, size: int = 6) -> DataFrame:
    """``turns`` with the texts of the ``size`` turns before each."""
    return turns.withColumn("history", F.collect_list("text").over(by_turn().rowsBetween(-size, -1)))


def until_last_user(turns: DataFrame) -> DataFrame:
    """Each conversation up to its last user turn; without one it vanishes."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return turns.withColumn("_last", last).filter(F.col("turn") <= F.col("_last")).drop("_last")


def label_mask(ids: Column, answer_from: Column) -> Column:
    """Labels for training: -100 before a 0-based position, the ids from there on."""
    n = F.least(answer_from, F.size(ids))
    return F.concat(F.array_repeat(F.lit(-100), n.cast("int")), F.slice(ids, n + 1, F.size(ids)))


def streak(turns: DataFrame, flag: Column, name: str = "streak") -> DataFrame:
    """``turns`` with how many turns up to each the flag has held without a break."""
    resets = F.sum((~F.coalesce(flag, F.lit(False))).cast("int")).over(by_turn().rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = turns.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", resets)
    inside = W.partitionBy("conv_id", "_island").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn(name, F.sum(F.col("_flag").cast("long")).over(inside)).drop("_flag", "_island")


def validate(messages: Column) -> Column:
    """Whether an array of (role, content) can be trained on: known roles, no blank content, an assistant."""
    return (
        F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False)) & F.coalesce(strip(m["content"]) != "", F.lit(False)))
        & F.exists(messages, lambda m: F.coalesce(m["role"] == "assistant", F.lit(False)))
    )


def nest(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): conversations as arrays of (role, content)."""
    item = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def unnest(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))


def flat_prompt(messages: Column, *, skip_empty: bool = False) -> Column:
    """``ROLE: content`` lines of an array of messages."""
    if skip_empty:
        messages = F.filter(messages, lambda m: (F.coalesce(strip(m["role"]), F.lit("")) != "") & (F.coalesce(strip(m["content"]), F.lit("")) != ""))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n")
