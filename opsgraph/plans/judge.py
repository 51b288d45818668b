"""Answers written and graded by any function of a prompt, and whether that judge can be trusted."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.operators import evaluate

REFUSAL = "NOT IN THE RECORDS"


def answer_prompt(question: str, context: str) -> str:
    return f"Answer the question from these records alone, in three sentences at most. If they don't hold the answer, say: {REFUSAL}.\n\nRecords:\n{context}\n\nQuestion: {question}\nAnswer:"


def judge_prompt(question: str, gold: str, answer: str) -> str:
    return f"Grade the answer by the records it should rest on. Say one word: CORRECT if they support it, WRONG if it says what they don't support, REFUSED if it declines to answer.\n\nQuestion: {question}\n\nRecords:\n{gold}\n\nAnswer: {answer}\nVerdict:"


def _asked(ask: Callable[[str], str], prompt: Callable[..., str], attempts: int):
    """A column function: the reply to the prompt made of its columns; a call that fails is tried again."""

    def reply(*values: str) -> str:
        for left in reversed(range(attempts)):
            try:
                return ask(prompt(*values))
            except (OSError, RuntimeError):
                if not left:
                    raise

    @F.pandas_udf("string")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([reply(*(v or "" for v in row)) for row in zip(*columns)], dtype=object)

    return of


def graded(rows: DataFrame, ask: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """rows (arm, question_id, question, context, gold_text, recall) with answer, reply and again: the answer from the context, and the judge's word on it, asked for twice.

    `ask` runs where the rows are; partitions are calls at once. A null context is an empty one.
    """
    answered = rows.withColumn("answer", _asked(ask, answer_prompt, attempts)("question", "context"))
    word = _asked(ask, judge_prompt, attempts)("question", "gold_text", "answer")
    again = _asked(ask, judge_prompt, attempts)("question", "gold_text", "answer")
    return answered.withColumns({"reply": word, "again": again})


def judged(rows: DataFrame, control: DataFrame, ask: Callable[[str], str], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Verdicts by arm (evaluate.verdicts), and the gate (evaluate.control_gate) of a planted control.

    control: (question_id, question, gold_text, random_text). Answers from the gold records must be
    right more often than those from random ones; else the judge says yes to anything.
    """
    planted = control.select("question_id", "question", "gold_text", F.explode(F.array(F.struct(F.lit("gold").alias("arm"), F.col("gold_text").alias("context")), F.struct(F.lit("random").alias("arm"), F.col("random_text").alias("context")))).alias("c")).select("question_id", "question", "gold_text", "c.arm", "c.context")
    said = graded(planted, ask, attempts).select(F.col("arm").alias("context"), (evaluate.verdict("reply") == "CORRECT").alias("correct"))
    return evaluate.verdicts(graded(rows, ask, attempts)), evaluate.control_gate(said)
