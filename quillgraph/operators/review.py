"""A queue of questions and what was answered, as event-sourced tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_state(events: DataFrame, question: str, at: list[str], state: str) -> DataFrame:
    """``(question, state)``: ask, answer, withdraw and undo in order; the last of a question counts."""
    return events.groupBy(question).agg(F.max_by(state, F.struct(*at)).alias(state))


def queue(questions: DataFrame, answers: DataFrame, question: str, waiting: bool = True, kinds: list[str] | None = None, pressing: Column | None = None) -> DataFrame:
    """Questions that wait for an answer (or have one), by kind, the longest waiting first."""
    out = questions if kinds is None else questions.where(F.col("kind").isin(kinds))
    out = out if pressing is None else out.where(pressing)
    out = out.join(answers.select(question).distinct(), question, "left_anti" if waiting else "left_semi")
    return out.orderBy("seen_at", question)


def disputes(answers: DataFrame, rules: DataFrame, pair: list[str], acknowledged: DataFrame) -> DataFrame:
    """Pairs told to be different that rules (with an ``evidence`` struct) would merge, but for those whose same evidence was acknowledged."""
    token = F.sha2(F.to_json("evidence"), 256)
    found = rules.withColumn("token", token).join(answers.where("verdict = 'different'").select(*pair), pair, "left_semi")
    return found.join(acknowledged.select(*pair, "token"), [*pair, "token"], "left_anti").select(*pair, "token")


def settled(questions: DataFrame, covered: DataFrame, answered: DataFrame, question: str, subject: str) -> DataFrame:
    """Open questions about subjects that a run covered and that it no longer asks."""
    return questions.join(covered, subject, "left_semi").join(answered.select(question), question, "left_anti")


def deleted(feed: DataFrame, entity: str, at: list[str]) -> DataFrame:
    """``(entity, gone)``: whether the last entry of an entity deletes it."""
    return feed.groupBy(entity).agg(F.max_by(F.col("kind") == "deleted", F.struct(*at)).alias("gone"))
