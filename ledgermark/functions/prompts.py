"""Prompt text as column expressions (PRM-1..11). All wording is this package's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, last_of

CODE_MARK = "#Python\n"

ANNOTATE = "Use the report excerpt below and write Python that follows the given calculation.\n"
DEFINE = "A calculation is given below. Name each of its numbers as a Python variable after its meaning in the report.\n"
STORE_ANS = "Keep the final result in a variable called ans.\n"
NO_COMMENTS = "Write no comments and print nothing; keep the final result in ans.\n"
ANSWER_ONE = "Using the report excerpt, write Python that answers the question.\n"
ANSWER_LAST = "Using the report excerpt, write Python that answers the last of several linked questions.\n"
STORE_SCALED = "Keep the final result in ans and its unit in scale.\n"
SCALES = "For a number, scale is one of '', 'percent', 'thousand', 'million' or 'billion'; for anything else it is ''.\n"
TABLES_GIVEN = "These tables belong to the question.\n"

POT_SYSTEM = "You work in finance. Answer with a Python program.\n"
POT_FLAT = "Assign the inputs, compute step by step and end by setting ans.\n```python\n"
POT_FUNCTION = "Complete this function so that it returns the answer.\n```python\ndef solution():\n"
COT_SYSTEM = "You work in finance. Reason in numbered steps and finish with one number as the answer."
COT_CUE = "Work through it one step at a time.\n"

# Model families that take no system message.
FAMILIES_WITHOUT_SYSTEM = ("gemma", "OLMo", "Mistral", "Mixtral", "starcoder2")


def _line(value: Column) -> Column:
    return F.concat(value, F.lit("\n"))


def _optional(value: Column) -> Column:
    """The value and a newline, or nothing when it is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", _line(value)).otherwise(F.lit(""))


def _trimmed(value: ColumnOrName) -> Column:
    return F.regexp_replace(F.coalesce(as_col(value), F.lit("")), r"(?U)^\s+|(?<!\s)\s++$", "")


def _calculation(lead: str, text, table, program, question) -> Column:
    return F.concat(
        F.lit(lead),
        _optional(as_col(text)),
        _line(_trimmed(table)),
        F.lit("Calculation: "),
        _line(as_col(program)),
        F.lit("Question: "),
        _line(as_col(question)),
        F.lit(NO_COMMENTS),
        F.lit(CODE_MARK),
    )


def annotate_prompt(text="text", table="table", program="program", question="question") -> Column:
    """PRM-1: instruction, text if any, table, calculation, question, note, code mark."""
    return _calculation(ANNOTATE, text, table, program, question)


def definition_prompt(text="text", table="table", program="program", question="question") -> Column:
    """PRM-2: as PRM-1, asking for the variable definitions only."""
    return _calculation(DEFINE, text, table, program, question)


def calculation_prompt(definitions: ColumnOrName, text="text", table="table", program="program", question="question") -> Column:
    """PRM-3: as PRM-1, the definitions found so far following the code mark."""
    return F.concat(_calculation(ANNOTATE, text, table, program, question), as_col(definitions))


def qa_prompt(text="text", table="table", question="question", note_first: bool = True) -> Column:
    """PRM-4: instruction, text if any, table, question; the note leads or follows the table."""
    note = F.lit(STORE_ANS)
    empty = F.lit("")
    return F.concat(
        F.lit(ANSWER_ONE),
        note if note_first else empty,
        _optional(as_col(text)),
        _line(_trimmed(table)),
        empty if note_first else note,
        F.lit("Question: "),
        _line(as_col(question)),
        F.lit(CODE_MARK),
    )


def conversation_head(text="text", table="table", note_first: bool = True) -> Column:
    """Everything of PRM-5 that comes before the questions."""
    note = F.lit(STORE_ANS)
    empty = F.lit("")
    return F.concat(
        F.lit(ANSWER_LAST),
        note if note_first else empty,
        _optional(_trimmed(text)),
        _optional(_trimmed(table)),
        empty if note_first else note,
        F.lit("Questions: "),
    )


def conversation_tail(last_question: ColumnOrName) -> Column:
    """Everything of PRM-5 that comes after the earlier questions."""
    return F.concat(F.lit("\nQuestion: "), _line(as_col(last_question)), F.lit(CODE_MARK))


def conversation_prompt(text="text", table="table", questions="questions", note_first: bool = True) -> Column:
    """PRM-5: the earlier questions on one line, then the last one."""
    asked = as_col(questions)
    earlier = F.array_join(F.slice(asked, F.lit(1), F.greatest(F.size(asked) - 1, F.lit(0))), " ")
    return F.concat(conversation_head(text, table, note_first), earlier, conversation_tail(last_of(asked)))


def scaled_qa_prompt(text="text", table="table", question="question", name_scales: bool = True) -> Column:
    """PRM-6: as PRM-4 for answers with a unit; optionally lists the unit words."""
    return F.concat(
        F.lit(ANSWER_ONE),
        F.lit(STORE_SCALED),
        F.lit(SCALES if name_scales else ""),
        _optional(_trimmed(text)),
        _line(_trimmed(table)),
        F.lit("Question: "),
        _line(as_col(question)),
        F.lit(CODE_MARK),
    )


def _with_tables(tables: Column, lead: str, body: Column, question: Column) -> Column:
    asked = F.concat(F.lit("Question: "), _line(question))
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, F.concat(F.lit(lead), body, F.lit("\n"), asked)).otherwise(asked)


def program_of_thought_prompt(tables="tables", question="question", function_style: bool = False) -> Column:
    """PRM-7: struct of system and user text; each table on its own line, then a code skeleton."""
    t = as_col(tables)
    body = F.array_join(F.transform(t, _line), "")
    user = F.concat(
        _with_tables(t, TABLES_GIVEN, body, as_col(question)),
        F.lit("\n"),
        F.lit(POT_FUNCTION if function_style else POT_FLAT),
    )
    return F.struct(F.lit(POT_SYSTEM).alias("system"), user.alias("user"))


def chain_of_thought_prompt(tables="tables", question="question") -> Column:
    """PRM-8: struct of system and user text; tables apart by a blank line, then a cue."""
    t = as_col(tables)
    user = F.concat(_with_tables(t, TABLES_GIVEN, _line(F.array_join(t, "\n\n")), as_col(question)), F.lit("\n"), F.lit(COT_CUE))
    return F.struct(F.lit(COT_SYSTEM).alias("system"), user.alias("user"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(system: ColumnOrName, user: ColumnOrName, model: ColumnOrName) -> Column:
    """PRM-9: chat messages; families without a system role get it merged into the user turn."""
    s, u, name = as_col(system), as_col(user), as_col(model)
    merged = name.rlike("|".join(FAMILIES_WITHOUT_SYSTEM))
    return F.when(merged, F.array(_message("user", F.concat(s, F.lit("\n"), u)))).otherwise(
        F.array(_message("system", s), _message("user", u))
    )


def with_few_shot(prompt: ColumnOrName, block: str | None) -> Column:
    """PRM-10: worked examples, a blank line, the prompt."""
    return F.concat(F.lit(block + "\n\n"), as_col(prompt)) if block else as_col(prompt)


def mixture_prompt(data_type: str = "mix", dataset="dataset", text="text", table="table", question="question", questions="questions") -> Column:
    """PRM-11: prompt style by the row's data set, or one style for all rows.

    Unknown data sets in a mix get PRM-4; a fixed type that is neither of the
    single-question ones gets PRM-5.
    """
    single = qa_prompt(text, table, question)
    linked = conversation_prompt(text, table, questions)
    scaled = scaled_qa_prompt(text, table, question)
    if data_type == "mix":
        name = as_col(dataset)
        return F.when(name == "convfinqa", linked).when(name == "tatqa", scaled).otherwise(single)
    return {"finqa": single, "tatqa": scaled}.get(data_type, linked)
