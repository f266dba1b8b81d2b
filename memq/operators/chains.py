"""Which later claim replaced which earlier one, and walks along those links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import keys, text
from memq.operators.skew import salted_join, small_side
from memq.session import materialize, once

#: Steps of a walk, and seconds of one chunk of a timeline.
HOPS, CHUNK = 5, 3_600


def predicate_cardinality(claims: DataFrame) -> DataFrame:
    """(pred, one, many, resolved): single-valued only if some claim says one and none says otherwise.

    A missing card counts as many. Claims without a predicate have no vote.
    """
    one = F.coalesce(F.col("card") == "one", F.lit(False))
    return (
        claims.where("pred is not null")
        .groupBy("pred")
        .agg(F.count_if(one).alias("one"), F.count_if(~one).alias("many"))
        .withColumn("resolved", F.when((F.col("many") == 0) & (F.col("one") > 0), "one").otherwise("many"))
    )


def disputes(claims: DataFrame) -> DataFrame:
    return predicate_cardinality(claims).where("one > 0 and many > 0").drop("resolved")


def run_links(rows: DataFrame, group: list[str], order: list[str], value: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """(later, earlier): the head of each run of one value, linked to the head of the run before it.

    ``order`` begins with a time in seconds. A group is cut into chunks of time, each chunk finds
    its runs on its own, and one summary row per chunk stitches them, so a hot group is spread
    over its chunks. Rows with a null group, order or value must have been removed.
    """
    first = order[0]
    chunked = rows.withColumn("__chunk", F.floor(F.col(first) / chunk))
    inside = Window.partitionBy(*group, "__chunk").orderBy(*order, key)
    heads = materialize(
        chunked.withColumn("__before", F.lag(value).over(inside))
        .where(F.col("__before").isNull() | (F.col("__before") != F.col(value)))
        .select(*group, "__chunk", *order, F.col(value).alias("__value"), F.col(key).alias("__key"), F.col("__before").isNull().alias("__opens"))
    )
    sequence = F.struct(*order, "__key")
    per_chunk = heads.groupBy(*group, "__chunk").agg(
        F.min_by("__value", sequence).alias("first"),
        F.max_by("__value", sequence).alias("final"),
        F.max_by("__key", sequence).alias("head"),
        F.count("*").alias("n"),
    )
    along = Window.partitionBy(*group).orderBy("__chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        per_chunk.withColumn("same", F.coalesce(F.lag("final").over(along) == F.col("first"), F.lit(False)))
        .withColumn("kept_head", F.when(~(F.col("same") & (F.col("n") == 1)), F.col("head")))
        .withColumn("previous", F.last("kept_head", ignorenulls=True).over(earlier))
        .select(*group, "__chunk", "same", "previous")
    )
    again = Window.partitionBy(*group, "__chunk").orderBy(*order, "__key")
    kept = heads.join(stitched, [*group, "__chunk"]).where(~(F.col("same") & F.col("__opens")))
    links = kept.withColumn("__earlier", F.coalesce(F.lag("__key").over(again), F.col("previous")))
    return links.where("__earlier is not null").select(F.col("__key").alias("later"), F.col("__earlier").alias("earlier"))


def supersedes(claims: DataFrame, normal: Column | None = None) -> DataFrame:
    """(later, earlier) by line_no, for claims of single-valued predicates with subject, object and time.

    Restating the value is no replacement; a value that comes back is.
    """
    votes = predicate_cardinality(claims).where("resolved = 'one'").select("pred", (F.col("one") + F.col("many")).alias("n"))
    few = small_side(votes.select("pred"))
    norm = keys.normal_object("obj") if normal is None else normal
    present = claims.where(F.col("pred").isNotNull() & F.col("subj").isNotNull() & F.col("ts").isNotNull() & (F.col("obj") if normal is None else norm).isNotNull())
    rows = present.select(
        "pred", text.entity("subj").alias("ekey"), "ts", F.coalesce("sid", F.lit("")).alias("sid"), F.coalesce("turn", F.lit(-1)).alias("turn"),
        norm.alias("norm"), "line_no",
    )
    rows = rows.join(few, "pred") if few is not None else salted_join(rows, votes, ["pred"], "n")
    return run_links(rows, ["ekey", "pred"], ["ts", "sid", "turn"], "norm", "line_no")


def walk(links: DataFrame, starts: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """(start, hop, node): everything reached from a start in 1 to ``hops`` steps along later -> earlier.

    Each later node has one earlier one, so a start has at most ``hops`` rows and the join of each
    hop is on unique keys. Links and levels are written, so each is computed once.
    """
    links = once(links)
    first = links if starts is None else links.join(starts.select(F.col(starts.columns[0]).alias("later")).distinct(), "later", "left_semi")
    step = links.select(F.col("later").alias("node"), F.col("earlier").alias("next"))
    level = first.select(F.col("later").alias("start"), F.lit(1).alias("hop"), F.col("earlier").alias("node"))
    out = level
    for hop in range(2, hops + 1):
        level = once(level.join(step, "node").select("start", F.lit(hop).alias("hop"), F.col("next").alias("node")))
        out = out.unionByName(level)
    return out


def paths(links: DataFrame, longest: int = 3) -> DataFrame:
    """(start, target, hops, path): the nodes of each path of 1 to ``longest`` hops."""
    links = once(links)
    step = links.select(F.col("later").alias("target"), F.col("earlier").alias("next"))
    level = links.select(F.col("later").alias("start"), F.col("earlier").alias("target"), F.array("later", "earlier").alias("path"))
    out = level.withColumn("hops", F.lit(1))
    for hops in range(2, longest + 1):
        level = level.join(step, "target").select("start", F.col("next").alias("target"), F.concat("path", F.array("next")).alias("path"))
        level = once(level)
        out = out.unionByName(level.withColumn("hops", F.lit(hops)))
    return out.select("start", "target", "hops", "path")


def pair_paths(links: DataFrame, pairs: DataFrame, longest: int = 3) -> DataFrame:
    """(start, target, hops, path) of the paths between the given pairs (start, target) only; a pair without one has no row."""
    starts = pairs.select(F.col("start").alias("later")).distinct()
    links = once(links)
    near = walk(links, starts, longest - 1).select(F.col("node").alias("later")).unionByName(starts).distinct() if longest > 1 else starts
    found = paths(links.join(near, "later", "left_semi"), longest)
    return found.join(pairs.select("start", "target").distinct(), ["start", "target"])
