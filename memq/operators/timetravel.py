"""Facts that changed their value, and what was current at each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400


def mentions(claims: DataFrame) -> DataFrame:
    return claims.where("pred is not null and obj is not null and ts is not null").select("pred", "subj", "obj", "ts", "line_no")


def changed_facts(claims: DataFrame, max_values: int = 8, max_mentions: int = 40) -> DataFrame:
    """(pred, subj, values, mentions, span): facts that replace their value: few values, not many mentions.

    Sizes are counted before anything is compared, so facts with many mentions cost no more than a count.
    """
    sums = mentions(claims).groupBy("pred", "subj", "obj").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    facts = sums.groupBy("pred", "subj").agg(F.count("*").alias("values"), F.sum("n").alias("mentions"), (F.max("b") - F.min("a")).alias("span"))
    return facts.where((F.col("values") >= 2) & (F.col("values") <= max_values) & (F.col("mentions") <= max_mentions))


def ranked_facts(facts: DataFrame, chain: DataFrame, probe: int = 40) -> DataFrame:
    """Facts with chain length and place: only the first ``probe`` are looked up; (-chain, values, -span)."""
    names = [F.col("pred").asc_nulls_first(), F.col("subj").asc_nulls_first()]
    order = Window.orderBy("values", F.col("span").desc(), *names)
    first = facts.orderBy("values", F.col("span").desc(), *names).limit(probe).withColumn("place", F.row_number().over(order))
    out = first.join(chain, ["pred", "subj"], "left").withColumn("chain", F.coalesce("chain", F.lit(0)))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("chain").desc(), "values", F.col("span").desc(), *names)))


def marks(rows: Column, cap: int = 6) -> Column:
    """Times to ask at, from an array of (ts, obj) sorted by time: a day before the first, then one per change.

    A change at a time already marked is passed over and the remembered value stays. More than
    ``cap`` changes are thinned evenly, first and last kept, halves rounded to even.
    """
    none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(None).cast("string").alias("seen"))

    def step(acc: Column, r: Column) -> Column:
        new = ~acc["seen"].eqNullSafe(r["obj"]) & ~F.array_contains(acc["out"], r["ts"])
        return F.struct(
            F.when(new, F.array_append(acc["out"], r["ts"])).otherwise(acc["out"]).alias("out"),
            F.when(new, r["obj"]).otherwise(acc["seen"]).alias("seen"),
        )

    all_ = F.aggregate(rows, none, step, lambda a: a["out"])
    thin = F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda i: F.element_at(all_, F.bround(i * (F.size(all_) - 1) / F.lit(float(cap - 1))).cast("int") + 1),
    )
    return F.concat(F.array(rows[0]["ts"] - DAY), F.when(F.size(all_) > cap, thin).otherwise(all_))


def change_marks(claims: DataFrame, facts: DataFrame, cap: int = 6) -> DataFrame:
    """(pred, subj, mark) of facts; a fact's mentions are bounded, since changed_facts() leaves out the others."""
    rows = mentions(claims).join(facts.select("pred", "subj"), ["pred", "subj"])
    grouped = rows.groupBy("pred", "subj").agg(F.array_sort(F.collect_list(F.struct("ts", "line_no", "obj"))).alias("rows"))
    return grouped.select("pred", "subj", F.explode(marks(F.col("rows"), cap)).alias("mark"))
