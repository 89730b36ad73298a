"""Rows of other shapes as messages, prompts and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.conversations import flat_prompt

# Roles and headings of prompts.
ROLES = ("system", "user", "assistant")
INSTRUCTION, INPUT, OUTPUT, RESPONSE = "### Instruction:\n", "### Input:\n", "### Output:\n", "### Response:\n"
MESSAGES = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def three_messages(system: Column, user: Column, assistant: Column, *, strict: bool = True) -> Column:
    """Three texts as messages. One that is null or empty is an error, or with ``strict`` off makes the row null."""
    given = F.lit(True)
    for c in (system, user, assistant):
        given = given & F.coalesce(c != "", F.lit(False))
    rows = F.array(_message("system", system), _message("user", user), _message("assistant", assistant))
    return F.when(given, rows).otherwise(F.raise_error(F.lit("a field of system, user and assistant is missing")).cast(MESSAGES) if strict else F.lit(None).cast(MESSAGES))


def normal_messages(messages: Column, system: Column, user: Column, assistant: Column) -> Column:
    """Messages of the three roles, trimmed, without blank ones; where none is left, the three texts as messages, and
    null where one of those is null."""
    trimmed = F.transform(messages, lambda m: F.struct(F.lower(strip(m["role"])).alias("role"), strip(m["content"]).alias("content")))
    kept = F.filter(trimmed, lambda m: F.coalesce(m["role"].isin(*ROLES) & (m["content"] != ""), F.lit(False)))
    legacy = F.array(_message("system", strip(system)), _message("user", strip(user)), _message("assistant", strip(assistant)))
    return F.when(F.size(kept) > 0, kept).when(system.isNotNull() & user.isNotNull() & assistant.isNotNull(), legacy)


def nested_pairs(rows: DataFrame, *, block: str = "scene.dialogue", source: str = "ko", target: str = "jp") -> DataFrame:
    """(source, target) texts out of nested fields; pairs with a null or blank side go."""
    a, b = F.col(f"{block}.{source}"), F.col(f"{block}.{target}")
    return rows.filter((strip(a) != "") & (strip(b) != "")).select(a.alias("source"), b.alias("target"))


def quoted_span_rows(turns: DataFrame, most: int = 600) -> DataFrame:
    """(conv_id, turn, span, text): each quoted span of an assistant's turns, counted from 0 within its turn."""
    spans = F.regexp_extract_all("text", F.lit(f'"([^"\\n]{{1,{most}}})"'), 1)
    return turns.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(spans).alias("span", "text"))


def translation_prompt(instruction: Column, given: Column) -> Column:
    a, b = (strip(F.coalesce(c, F.lit(""))) for c in (instruction, given))
    return F.concat(F.lit(INSTRUCTION), a, F.lit("\n\n" + INPUT), b, F.lit("\n\n" + OUTPUT))


def instruction_prompt(instruction: Column, given: Column) -> Column:
    """Without an input its heading goes too."""
    a, b = (strip(F.coalesce(c, F.lit(""))) for c in (instruction, given))
    middle = F.when(b == "", "").otherwise(F.concat(F.lit(INPUT), b, F.lit("\n\n")))
    return F.concat(F.lit(INSTRUCTION), a, F.lit("\n\n"), middle, F.lit(RESPONSE))


def with_prompt(rows: DataFrame) -> DataFrame:
    """Rows with a text ``prompt``: from ``prompt_messages`` where the table and the row have them, else as it is; blank
    prompts go, and a table with neither column is an error."""
    if not {"prompt", "prompt_messages"} & set(rows.columns):
        raise ValueError("a table of prompts needs prompt or prompt_messages")
    given = [flat_prompt(F.col("prompt_messages"), skip_empty=True)] if "prompt_messages" in rows.columns else []
    prompt = F.coalesce(*given, *([F.col("prompt")] if "prompt" in rows.columns else []))
    return rows.withColumn("prompt", prompt).filter(strip(F.col("prompt")) != "")


def latest_by_digits(paths: DataFrame, path: str = "path", *, like: str = r"(^|/)G_[^/]*\.pth$") -> DataFrame:
    """One row: the path whose digits, put together, are the largest number; none if no path matches. Ties go to the
    greater path, and paths without digits do not count. Numbers of any length are compared as texts of equal length."""
    digits = F.regexp_replace(F.regexp_replace(path, r"\D", ""), "^0+(?=.)", "")
    found = paths.filter(F.col(path).rlike(like) & (digits != ""))
    return found.select(F.max_by(F.col(path), F.struct(F.length(digits), digits, F.col(path))).alias("path")).filter("path IS NOT NULL")


def seconds_total(files: DataFrame, seconds: str = "seconds") -> DataFrame:
    """(seconds, n_files) of a listing; an empty one gives 0 and 0."""
    return files.agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"), F.count("*").alias("n_files"))


def not_thrice(history: Column, actions: Column) -> Column:
    """The actions that may follow: all but the one that the last two both were, if another is left."""
    kept = F.slice(F.when(F.size(history) > 6, F.slice(history, -6, 6)).otherwise(history), 1, 6)
    twice = (F.size(kept) >= 2) & (F.try_element_at(kept, F.lit(-1)) == F.try_element_at(kept, F.lit(-2)))
    return F.when(twice & (F.size(actions) > 1), F.array_remove(actions, F.try_element_at(kept, F.lit(-1)))).otherwise(actions)


def looked_up(wanted: DataFrame, *models: DataFrame, name: str = "style") -> DataFrame:
    """Each wanted name with its ``vector`` in every model as ``vector_0``, ``vector_1`` and so on; a name that a model
    lacks is an error."""
    out = wanted.select(name).distinct()
    for i, m in enumerate(models):
        out = out.join(m.select(name, F.col("vector").alias(f"vector_{i}")), name, "left")
        missing = F.raise_error(F.concat(F.lit(f"model {i} has no "), F.col(name)))
        out = out.withColumn(f"vector_{i}", F.coalesce(f"vector_{i}", missing.cast(m.schema["vector"].dataType)))
    return out
