"""The gate that a generated turn passes: cleaned first, then held against the rules of its role and what was said before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import turns as rules
from colloquy.functions.similarity import is_echo, is_redundant
from colloquy.functions.text import first_failure, intent, one_space, signature

# How alike a repeat and an echo are.
REPEAT_FROM = 0.7
ECHO_FROM = 0.8


def cleaned(text: Column, player: Column, protagonist: Column) -> Column:
    """Without lines about the task, square brackets and labels, and with people under their own names."""
    named = rules.player_named(rules.protagonist_named(rules.without_square_brackets(rules.without_meta(text)), protagonist), player)
    return F.array_join(rules.unlabelled_lines(named), "\n")


def turn_gate(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, code) of user and assistant turns with columns ``player`` and ``protagonist``: the
    cleaned text and the first rule it breaks, empty if none. What is compared with before are the quotes of earlier
    turns that break no rule of their own; repeats among those still count as said. One sort by conversation."""
    clean = turns.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", "player", "protagonist", cleaned(F.col("text"), F.col("player"), F.col("protagonist")).alias("text")
    )
    of_user = F.col("role") == "user"
    player, protagonist, text = F.col("player"), F.col("protagonist"), F.col("text")
    told = F.coalesce(F.get(rules.visible_lines(text), F.lit(0)), F.lit(""))
    acts = (player != "") & F.rlike(told, F.concat(F.lit("(?U)^"), rules.literal(player), F.lit(r"(이|가|은|는)\b")))
    of_assistant = F.when(acts, "asst_role_conflict").otherwise(rules.assistant_code(text, player, protagonist))
    coded = clean.select(
        "conv_id", "turn", "role", "text",
        F.when(of_user, rules.user_code(text, player, protagonist)).otherwise(of_assistant).alias("broken"),
        F.coalesce(rules.single_quote(text), F.lit("")).alias("said"),
    ).withColumns({"fine": F.when(F.col("broken") == "", F.col("said")), "spoken": F.when(F.col("broken") == "", F.col("text"))})
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)

    def last(column: str, role: Column) -> Column:
        return F.coalesce(F.last(F.when(role, F.col(column)), ignorenulls=True).over(before), F.lit(""))

    seen = coded.withColumns({
        "user_said": last("fine", of_user), "asst_said": last("fine", ~of_user), "user_text": last("spoken", of_user),
    }).withColumns({"own": F.when(of_user, F.col("user_said")).otherwise(F.col("asst_said")), "other": F.when(of_user, F.col("asst_said")).otherwise(F.col("user_said"))})
    said, own = F.col("said"), F.col("own")
    aim = intent(said)
    repeats = (said != "") & (own != "") & (aim != "") & (aim == intent(own)) & (
        ((signature(said) != "") & (signature(said) == signature(own))) | is_echo(said, own, REPEAT_FROM)
    )
    echoes = is_echo(said, F.col("other"), ECHO_FROM)
    broken, same = F.col("broken"), (F.col("user_text") != "") & (one_space(F.col("text")) == one_space(F.col("user_text")))
    user = first_failure([("user_repeat_turn", repeats), ("user_repeat_turn", is_redundant(said, own)), ("user_echo_assistant", echoes)])
    assistant = first_failure([("asst_repeat_turn", repeats), ("asst_echo_user", echoes)])
    code = F.when(~of_user & same, "asst_echo_user").when(broken != "", broken).when(of_user, user).otherwise(assistant)
    return seen.select("conv_id", "turn", "role", "text", code.alias("code"))
