"""Instruction and preference records, conversations and risk-report prompts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import sha_hex, stable_int

MESSAGES = "array<struct<role:string,content:string>>"

# ---- Fixed values: personal data that must not reach a training set ----
PERSONAL = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("CARD", r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE", r"\+?[0-9][0-9() .-]{8,}[0-9]"),
]

# ---- Fixed values: the request of a risk report ----
REPORT_INSTRUCTION = "Write a business-readable fraud risk assessment report."
SYSTEM_TEXT = ("You assess payment fraud risk. Use only the transaction, the model results and the customer context "
               "given below, and do not speculate. Report the overall risk, its main drivers, signals from the "
               "account network, the recommended action and how sure you are.")


def _has(record: Column, *keys: str) -> Column:
    found = F.json_object_keys(record)
    out = F.lit(True)
    for k in keys:
        out = out & F.coalesce(F.array_contains(found, k), F.lit(False))
    return out


def _field(record: Column, key: str) -> Column:
    return F.get_json_object(record, f"$.{key}")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _question(record: Column) -> Column:
    """The instruction, with the input below it unless the input is empty."""
    extra = _field(record, "input")
    filled = extra.isNotNull() & ~extra.isin("", "0", "0.0", "false", "[]", "{}")
    text = _field(record, "instruction")
    return F.when(filled, F.concat(text, F.lit("\n\nInput:\n"), extra)).otherwise(text)


def normalize_instruction(records: DataFrame, column: str = "record") -> DataFrame:
    """Add `shape` and the normalised fields; the first matching shape wins, none gives NULL."""
    r = F.col(column)
    shape = (F.when(_has(r, "messages"), "messages").when(_has(r, "prompt", "completion"), "completion")
             .when(_has(r, "text"), "text").when(_has(r, "instruction", "output"), "instruction"))
    dialog = F.array(_message("user", _question(r)), _message("assistant", _field(r, "output")))
    s = F.col("shape")
    return records.withColumn("shape", shape).withColumns({
        "messages": F.when(s == "messages", F.from_json(_field(r, "messages"), MESSAGES)).when(s == "instruction", dialog),
        # as given, with all keys of a message
        "messages_json": F.when(s == "messages", _field(r, "messages")).when(s == "instruction", F.to_json(dialog)),
        "prompt": F.when(s == "completion", _field(r, "prompt")),
        "completion": F.when(s == "completion", _field(r, "completion")),
        "text": F.when(s == "text", _field(r, "text")),
    })


def normalize_preference(records: DataFrame, column: str = "record") -> DataFrame:
    """prompt / chosen / rejected, as given or as message lists from an instruction."""
    r = F.col(column)
    shape = (F.when(_has(r, "prompt", "chosen", "rejected"), "preference")
             .when(_has(r, "instruction", "chosen", "rejected"), "instruction"))

    def value(key, role, text):
        # message lists stay JSON text, so that both record forms share one column type
        return F.when(F.col("shape") == "preference", _field(r, key)).when(
            F.col("shape") == "instruction", F.to_json(F.array(_message(role, text))))

    return records.withColumn("shape", shape).withColumns({
        "prompt": value("prompt", "user", _question(r)),
        "chosen": value("chosen", "assistant", _field(r, "chosen")),
        "rejected": value("rejected", "assistant", _field(r, "rejected")),
    })


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("shape is not null")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where("shape is null")


def conversation_messages(turns: DataFrame, max_turns: int = 10_000) -> DataFrame:
    """One record per conversation and part: conv_id, part, messages in order.

    A record is one value, so its size must be bounded: part n holds the turns numbered from
    n * max_turns on. Ordinary conversations have part 0 only; no turn is left out.
    """
    part = F.floor(F.col("turn") / max_turns).cast("bigint").alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id", part).agg(ordered.alias("_t")).select(
        "conv_id", "part", F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def mask_personal(text: Column) -> Column:
    for name, pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def tokenize_id(value: Column, salt: str = "") -> Column:
    return F.substring(sha_hex(F.concat(F.lit(salt), value.cast("string"))), 1, 16)


def held_out(row_id: Column, one_in: int = 10) -> Column:
    return F.when(stable_int(row_id, one_in) == 0, "held_out").otherwise("train")


def class_coverage(labelled: DataFrame, label: str) -> DataFrame:
    """Rows of both classes, and whether both occur, per split."""
    counts = labelled.groupBy("split").agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("positive"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("bigint").alias("negative"))
    return counts.withColumn("both_present", (F.col("positive") > 0) & (F.col("negative") > 0))


def preference_coverage(pairs: DataFrame) -> DataFrame:
    """How the preferred answers differ: shorter, longer, equal, identical text."""
    a, b = F.length("chosen"), F.length("rejected")
    kind = F.when(F.col("chosen") == F.col("rejected"), "identical").when(a < b, "chosen_shorter").when(
        a > b, "chosen_longer").otherwise("same_length")
    return pairs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pairs"))


def report_prompts(rows: DataFrame, transaction: Column, result: Column, context: Column | None = None,
                   instruction: Column | None = None) -> DataFrame:
    """Add `messages`: the system text and the request as JSON. An absent context is an empty
    object; an absent or empty instruction becomes the standard one."""
    asked = F.lit(None).cast("string") if instruction is None else instruction
    asked = F.when(asked.isNull() | (asked == ""), F.lit(REPORT_INSTRUCTION)).otherwise(asked)
    known = F.lit("{}") if context is None else F.coalesce(F.to_json(context), F.lit("{}"))
    body = F.concat(
        F.lit('{"transaction":'), F.to_json(transaction, {"ignoreNullFields": "false"}),
        F.lit(',"classification_result":'), F.to_json(result, {"ignoreNullFields": "false"}),
        F.lit(',"customer_context":'), known,
        F.lit(',"report_instruction":'), F.regexp_extract(F.to_json(F.struct(asked.alias("v"))), r"^\{\"v\":(.*)\}$", 1),
        F.lit("}"))
    return rows.withColumn("messages", F.array(_message("system", F.lit(SYSTEM_TEXT)), _message("user", body)))
