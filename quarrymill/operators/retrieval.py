"""Ranking of matches, context for a prompt, citations and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.config import NO_ANSWER, SETTINGS
from quarrymill.functions.text import is_blank, strip
from quarrymill.functions.vectors import top_k

META = ("professor_name", "professor_title", "section_type", "url", "text")


def retrieve(questions: DataFrame, index: DataFrame, k: int = SETTINGS.top_k, *, question_id: str = "question_id", vector: str = "vector", key: str = "vector_id", values: str = "values") -> DataFrame:
    """(question_id, rank, key, score, and every other column of the index): the k nearest entries.

    The search itself moves keys and scores only; the metadata is joined to the few matches at the end.
    """
    near = top_k(questions, index, k, question_id, vector, key, values).withColumnRenamed("id", "_id")
    rest = [c for c in index.columns if c not in (key, values)]
    return near.join(index.select(F.col(key).alias("_id"), *rest), "_id").select(question_id, "rank", F.col("_id").alias(key), "score", *rest)


def ranked(results: DataFrame, group: str, score: str, *ties: str) -> DataFrame:
    """``results`` with ``rank`` from 1 by falling score; null and NaN scores come last."""
    clean = F.when(F.isnan(score), None).otherwise(F.col(score))
    return results.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(clean.desc_nulls_last(), *ties)))


def context_block(rank, name, title, section, text):
    """``[n] name (title) — section`` and the text; what is missing is empty, the parentheses stay."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), e(name), F.lit(" ("), e(title), F.lit(") — "), e(section), F.lit("\n"), e(text))


def contexts(matches: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """(group, context): the blocks of each group in rank order, an empty line between.

    Groups are bounded by the number of matches kept per question.
    """
    block = context_block(F.col(rank), F.col("professor_name"), F.col("professor_title"), F.col("section_type"), F.col("text"))
    return matches.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("_b")).select(group, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"))


def prompt(context, question):
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n"))


def citations(matches: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """One row per match, all of them: number, name, title, section, url, score and the score as shown."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return matches.select(group, F.col(rank).alias("number"), e("professor_name").alias("name"), e("professor_title").alias("title"), e("section_type").alias("section"), e("url").alias("url"), "score", F.format_number("score", 2).alias("score_text"))


def answers(questions: DataFrame, matches: DataFrame, generate, question_id: str = "question_id", text: str = "text") -> DataFrame:
    """(question_id, answer, context): ``generate`` (prompt column to answer column) runs for questions with a match only.

    A question without a match has the fixed answer and a null context; one whose generated answer is blank
    has the fixed answer and its context.
    """
    ctx = contexts(matches, question_id)
    q = questions.select(question_id, F.col(text).alias("_q")).join(ctx, question_id, "left")
    made = q.where(F.col("context").isNotNull()).withColumn("_a", strip(generate(prompt(F.col("context"), F.col("_q")))))
    some = made.select(question_id, F.when(is_blank(F.col("_a")), NO_ANSWER).otherwise(F.col("_a")).alias("answer"), "context")
    none = q.where(F.col("context").isNull()).select(question_id, F.lit(NO_ANSWER).alias("answer"), "context")
    return some.unionByName(none)


def askable(questions: DataFrame, text: str, least: int = SETTINGS.question_length[0], most: int = SETTINGS.question_length[1]) -> DataFrame:
    """Questions of an allowed length."""
    return questions.where(F.length(text).between(least, most))
