"""Loops of a retrieval run over written state: search rounds until the pool is large enough, choices until enough resolve."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folders, published, written
from .ranking import LAMBDA, diversified
from .resolve import fold

FIRST_ROUND = 3  # strategies of the first search round; the others make the second


def limits(target: int) -> tuple[int, int]:
    """(records that are enough to stop searching, records asked of a source)."""
    return max(10, min(200, int(target * 1.5))), max(10, min(100, int(target * 1.2)))


def search_rounds(strategies: Sequence[str], search: Callable[[str, int], DataFrame], target: int) -> DataFrame:
    """Records (of resolve, but for seq) with round, strategy and seq, found by search(strategy, limit): the first strategies, then
    the others if too few different records came. seq follows rounds, strategies and each answer's own order (place)."""
    enough, most = limits(target)
    found: DataFrame | None = None
    for n, part in enumerate((strategies[:FIRST_ROUND], strategies[FIRST_ROUND:]), 1):
        for i, strategy in enumerate(part):
            rows = search(strategy, most).withColumns({"round": F.lit(n), "strategy": F.lit(strategy), "seq": F.lit((n * 100 + i) * 10**6) + F.col("place")}).drop("place")
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError("no search strategy")
        if not part:
            break
        found = written(found, "candidates")
        if found.count() - fold(found).count() >= enough:
            break
    return found


def fill(pool: DataFrame, target: int, resolve: Callable[[DataFrame], DataFrame], path: str, trade: float = LAMBDA) -> DataFrame:
    """(id, round, place, accepted): of pool(id, score, v) the rows tried, round after round, until target of them resolve or none is left.

    A round chooses as many rows as are missing, diverse among themselves and against those accepted, and writes what
    resolve(rows) says of them (id, accepted) as a folder of its own, published whole. A run that broke off goes on behind the
    last round that was written: rows tried are never tried again. Choice and acceptance of a round hold at most target rows."""
    spark = pool.sparkSession
    pool = written(pool.select("id", "score", "v"), "pool")
    total = pool.count()
    while True:
        tried = rounds(spark, path)
        facts = tried.agg(F.count(F.lit(1)), F.count(F.when(F.col("accepted"), 1)), F.max("round")).first()
        if facts[1] >= target or facts[0] >= total:
            return tried
        n = (facts[2] or 0) + 1
        taken = pool.join(tried.where("accepted").select("id"), "id")
        left = pool.join(tried.select("id"), "id", "left_anti")
        batch = written(diversified(left, target - facts[1], trade, taken), "batch")
        said = resolve(left.join(batch.select("id"), "id")).select("id", F.col("accepted").cast("boolean").alias("accepted"))
        made = batch.join(said, "id", "left").select("id", F.lit(n).alias("round"), "place", F.coalesce("accepted", F.lit(False)).alias("accepted"))
        published(made, f"{path}/round={n}")


ROUND = "id long, place int, accepted boolean, round int"


def rounds(spark: SparkSession, path: str) -> DataFrame:
    """The rounds that stand at a path."""
    known = folders(spark, path)
    if not known:
        return spark.createDataFrame([], ROUND).select("id", "round", "place", "accepted")
    return spark.read.schema(ROUND).option("basePath", path).parquet(*known).select("id", "round", "place", "accepted")
