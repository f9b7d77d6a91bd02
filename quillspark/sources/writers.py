"""Sinks with the semantics of keyed tables, artifacts and reports; readers of their latest versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of equal key replaced by new's: insert or replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal versions the one with the largest tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(tie))
    return df.withColumn("quill_n", F.row_number().over(order)).where("quill_n = 1").drop("quill_n")


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run's rows, replacing those it wrote before and nothing else."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def drop_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Removes one run's partition."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/run_id={run_id}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def repaired_json(c, schema: str):
    """JSON from a text that may be fenced, end early or have commas before its brackets."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    commas = F.regexp_replace(bare, r",\s*([}\]])", "$1")
    braces = F.regexp_extract(commas, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.from_json(F.when((x != "") & F.try_parse_json(x).isNotNull(), x), schema) for x in (bare, commas, braces)))


def resolution_tier(arxiv, openalex, unpaywall, core):
    """The first tier that has an address."""
    tiers = ((arxiv, "arxiv_direct"), (openalex, "openalex_direct"), (unpaywall, "unpaywall"), (core, "core"))
    made = F.when(F.lit(False), F.lit(""))
    for address, name in tiers:
        made = made.when(F.coalesce(address, F.lit("")) != "", F.lit(name))
    return made.otherwise("unresolved")


def download_status(status, content):
    """What a download's status and first bytes say."""
    return (
        F.when(status.isin(403, 404, 429), F.concat(F.lit("HTTP_"), status.cast("string"))).when(status >= 500, "HTTP_5XX").when(status != 200, F.concat(F.lit("HTTP_"), status.cast("string")))
        .when(F.length(content) == 0, "INVALID_CONTENT").when(~F.startswith(content, F.lit("%PDF")), "INVALID_CONTENT").otherwise("VALID")
    )


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Rows of every source with the source's place (from 0) as source_place."""
    made = [p.withColumn("source_place", F.lit(i)) for i, p in enumerate(parts)]
    whole = made[0]
    for p in made[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def markdown_report(title: str, sections: dict[str, DataFrame], rows: int = 20) -> str:
    """A report of the first rows of each section; frames are aggregates, cut to a fixed number of rows before they are collected."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
        lines.append("")
    return "\n".join(lines)
