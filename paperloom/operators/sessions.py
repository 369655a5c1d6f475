"""History, search over it, and citations of stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

HISTORY = 5


def distinct_answers(answers: DataFrame) -> DataFrame:
    """One row per answer_id: the one received last."""
    columns = [c for c in answers.columns if c != "answer_id"]
    row = F.max_by(F.struct(*columns), F.struct("received_at", "created_at")).alias("r")
    return answers.where("answer_id IS NOT NULL").groupBy("answer_id").agg(row).select("answer_id", "r.*")


def latest_history(answers: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(session_id, place, answer_id, question): the newest answers of each session, newest first, ties by larger id.

    Spark keeps only the first ``keep`` rows of each session per task before the shuffle (a window group limit), so
    a session with very many answers costs no large group.  Rows without session are left out.
    """
    rows = distinct_answers(answers).where("session_id IS NOT NULL").select("session_id", "answer_id", "created_at", "question")
    order = Window.partitionBy("session_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("answer_id").desc())
    return rows.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= keep).select("session_id", "place", "answer_id", "question")


def search_questions(answers: DataFrame, needle: str) -> DataFrame:
    """(answer_id, question): answers whose question holds the words, whatever the case."""
    return distinct_answers(answers).where(X.contains_caseless(F.col("question"), needle)).select("answer_id", "question")


def cited_sources(answers: DataFrame) -> DataFrame:
    """(answer_id, number, source, page, chunk_id): the sources of each answer; a source without number takes its place."""
    rows = distinct_answers(answers).select("answer_id", F.posexplode("sources").alias("i", "s"))
    return rows.select("answer_id", F.coalesce(F.col("s.number"), F.col("i") + 1).cast("int").alias("number"), "s.source", "s.page", "s.chunk_id")


def search_sources(answers: DataFrame, chunks: DataFrame, needle: str) -> DataFrame:
    """(answer_id, number, chunk_id): cited sources whose name or chunk text holds the words."""
    texts = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"))
    rows = cited_sources(answers).join(texts, "chunk_id", "left")
    both = F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.where(X.contains_caseless(both, needle)).select("answer_id", "number", "chunk_id")


def citation_report(answers: DataFrame) -> DataFrame:
    """(answer_id, groups, valid_groups, dangling): citation groups of each answer, those whose numbers are all
    sources of it, and distinct numbers that are not."""
    rows = distinct_answers(answers).select("answer_id", X.citation_groups(F.col("answer")).alias("g"), F.transform(F.coalesce("sources", F.array()), lambda s, i: F.coalesce(s["number"], i + 1).cast("string")).alias("known"))
    fine = F.filter("g", lambda g: F.forall(X.group_numbers(g), lambda n: F.array_contains(F.col("known"), n)))
    used = F.array_distinct(F.flatten(F.transform("g", X.group_numbers)))
    return rows.select("answer_id", F.coalesce(F.size("g"), F.lit(0)).alias("groups"), F.coalesce(F.size(fine), F.lit(0)).alias("valid_groups"), F.coalesce(F.size(F.array_except(used, "known")), F.lit(0)).alias("dangling"))


def linked_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, linked): answers with their valid citations as links."""
    known = F.transform(F.coalesce("sources", F.array()), lambda s, i: F.coalesce(s["number"], i + 1).cast("string"))
    return distinct_answers(answers).select("answer_id", X.linked_answer(F.col("answer"), known, F.col("answer_id")).alias("linked"))
