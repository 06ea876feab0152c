"""GTID tokens and sets of integer intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MYSQL = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}:\d+(-\d+)?(:\d+(-\d+)?)*$"
MARIADB = r"^\d+-\d+-\d+$"


def is_valid(gtid: Column, engine: Column) -> Column:
    """Whether every token of a comma list has its engine's form; null is not valid."""
    tokens = F.transform(F.split(gtid, ","), lambda t: F.trim(t))
    form = F.when(engine == "mariadb", F.lit(MARIADB)).otherwise(F.lit(MYSQL))
    return F.coalesce(F.forall(tokens, lambda t: F.regexp_like(t, form)), F.lit(False))


def intervals(gtid: Column, engine: Column) -> Column:
    """Array of struct(key, start, end) of a GTID set: MySQL uuid:a-b:c (key in lower case), MariaDB domain-server-sequence.

    What can't be read gives no interval. MariaDB's key is the domain.
    """
    token_list = F.filter(F.split(F.regexp_replace(gtid, r"\s+", ""), ","), lambda t: t != "")
    number = lambda text, i: F.regexp_extract(text, r"^(\d+)(?:-(\d+))?$", i)

    def mysql(t: Column) -> Column:
        parts = F.split(t, ":")
        ranges = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r: r.rlike(r"^\d+(-\d+)?$"))
        return F.transform(ranges, lambda r: F.struct(F.lower(parts[0]).alias("key"), number(r, 1).cast("bigint").alias("start"), F.when(number(r, 2) != "", number(r, 2)).otherwise(number(r, 1)).cast("bigint").alias("end")))

    def mariadb(t: Column) -> Column:
        seq = F.regexp_extract(t, r"-(\d+)$", 1).cast("bigint")
        return F.array(F.struct(F.regexp_extract(t, r"^(\d+)", 1).alias("key"), seq.alias("start"), seq.alias("end")))

    empty = F.array().cast("array<struct<key:string,start:bigint,end:bigint>>")
    read = F.when(engine == "mariadb", F.flatten(F.transform(F.filter(token_list, lambda t: t.rlike(MARIADB)), mariadb))).otherwise(F.flatten(F.transform(token_list, mysql)))
    return F.coalesce(read, empty)


def merged(spans: DataFrame, keys: list[str], width: int = 100_000) -> DataFrame:
    """Union of intervals: spans that overlap or touch become one. Columns: keys, start, end.

    Two rounds: inside blocks of the number line, then over what each block
    merged to, which is far less. A key that holds a third of all rows is spread
    over its blocks; only its runs, not its rows, meet in one task.
    """

    def round_(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = df.withColumn("_o", F.when(reach.isNull() | (F.col("start") > reach + 1), F.col("start")))
        opens = opens.withColumn("_run", F.last("_o", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return opens.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")

    rows = spans.where(F.col("start").isNotNull() & (F.col("end") >= F.col("start"))).select(*keys, "start", "end").distinct()
    inner = round_(rows.withColumn("_block", F.floor(F.col("start") / width).cast("bigint")), [*keys, "_block"]).drop("_block")
    return round_(inner, keys)


def set_text(runs: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """``key:1-5:7`` of the merged runs of each set, keys in order, joined by commas: column consumed."""
    one = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", "start", "end"))
    per_key = runs.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("start", one.alias("t")))).alias("r"))
    text = F.concat(F.col(key), F.lit(":"), F.array_join(F.transform("r", lambda x: x["t"]), ":"))
    return per_key.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), text.alias("t")))).alias("r")).select(*by, F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("consumed"))


def summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per set: count of integers, high watermark, runs, and whether there is a hole (more than one run)."""
    return runs.groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"), F.max("end").alias("high_watermark"), F.count(F.lit(1)).alias("runs")).withColumn("gap_detected", F.col("runs") > 1)


def missing(source: DataFrame, consumed: DataFrame, by: list[str]) -> DataFrame:
    """Integers of ``source`` that ``consumed`` lacks, as runs, up to the consumed high watermark of each set.

    Both are merged runs. Sets that nothing was consumed of have no watermark and
    no missing integers. The holes of the consumed set are intersected with the
    source's runs, so intervals are compared, not integers.
    """
    order = Window.partitionBy(*by).orderBy("start")
    holes = consumed.select(*by, (F.coalesce(F.lag("end").over(order), F.lit(-(1 << 62))) + 1).alias("from"), (F.col("start") - 1).alias("to")).where(F.col("from") <= F.col("to"))
    hit = source.join(holes, by).where((F.col("start") <= F.col("to")) & (F.col("end") >= F.col("from")))
    return hit.select(*by, F.greatest("start", "from").alias("start"), F.least("end", "to").alias("end"))
