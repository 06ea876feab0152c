"""Queries of the text problems 6 to 8. SQL can't express them: tests hold them against brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import pack, residue, tokens
from lodeline.session import read_table


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_ids(read_table(spark, root, "documents"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack.pack_documents(read_table(spark, root, "documents"), read_table(spark, root, "pack_budget"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    return pack.fill_report(p7_containers(spark, root))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.flagged(read_table(spark, root, "documents"))


def p8_messages(spark: SparkSession, root: str) -> DataFrame:
    """Fragments that recur widely, with the class the rules give them and how often they prove it."""
    found = residue.recurrence(residue.fragments(read_table(spark, root, "documents")))
    return found.where((F.col("documents") >= residue.MIN_DOCUMENTS) & (F.col("sources") >= residue.MIN_SOURCES))


QUERIES = {"p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_messages": p8_messages}
ORACLES: dict[str, str] = {}
