"""Reading and writing the engine's files: JSON lines, JSON documents, CSV sheets, word lists, Markdown tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string>>"
COMPLETIONS = f"occupation string, stereotype string, split string, template_set string, template_id int, template_split string, prompt string, messages {MESSAGE}, completion string, sample_id int, n_new_tokens int, truncated boolean"
ANALYSIS = "occupation string, stereotype string, split string, template_id int, template_split string, sample_id int, reason string, gender string, name string, name_gender string, other_person_flag boolean"
MONITOR = "n long, usable_rate double, gendered_pronoun_rate double, first_person_rate double, gap double, n_usable long, examples array<string>, step int"
AUDIT = "pair_id long, occupation string, direction string, single_character_ok string, pronouns_refer_to_holder string, swap_correct string, chosen_fluent string, notes string, reviewer string"


def read_jsonl(spark: SparkSession, path: str, schema: str = COMPLETIONS) -> DataFrame:
    """One record a line; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a file. Mixed structs are read with the union of their fields, nulls where one lacks them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def folders_with(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that hold a match of the pattern, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().getName() for f in (found or []))


def read_models(spark: SparkSession, root: str, tags: Sequence[str] | None = None, schema: str = COMPLETIONS) -> DataFrame:
    """Completions of all models, one folder a model, in one table with model_tag.

    With tags, folders of those names only; a missing one is skipped, as is a folder without metrics.json.
    Where the schema has a reason, usable says that it is null. Completions may be one file or a folder of them.
    """
    done = [t for t in folders_with(spark, f"{root.rstrip('/')}/*/metrics.json") if tags is None or t in tags]
    rows = read_jsonl(spark, f"{root.rstrip('/')}/*/completions.jsonl", schema).withColumn("model_tag", F.regexp_extract(F.input_file_name(), "([^/]+)/completions\\.jsonl", 1))
    rows = rows.filter(F.col("model_tag").isin(*done))
    return rows.withColumn("usable", F.col("reason").isNull()) if "reason" in rows.columns else rows


def selected_tag(spark: SparkSession, root: str, given: str | None = None) -> str | None:
    """The tag that is given, or the one that summary.json says was selected."""
    if given is not None:
        return given
    if not folders_with(spark, f"{root.rstrip('/')}/summary.json"):
        return None
    row = read_json(spark, f"{root.rstrip('/')}/summary.json", "selected string").first()
    return row["selected"] if row else None


def read_words(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """name: the distinct words of a word list."""
    return spark.read.text(path).filter(~F.col("value").startswith(comment)).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).filter("name <> ''").distinct()


def read_audit(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of an audit sheet, and the lines that aren't rows."""
    rows = spark.read.schema(f"{AUDIT}, corrupt string").option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(path)
    rows = rows.select("*", F.coalesce("corrupt", F.lit("")).alias("_line"))  # a scan of the corrupt column alone isn't allowed
    bad = F.col("corrupt").isNotNull() | F.col("pair_id").isNull()
    return rows.filter(~bad).drop("corrupt", "_line"), rows.filter(bad).select("corrupt")


def rescued(bad: DataFrame) -> DataFrame:
    """Rows of an audit sheet from lines that weren't rows: quoted as a whole, or with stray semicolons at an end.

    The line is freed of both and read again; lines that still aren't rows are left out.
    """
    inner = F.regexp_replace(F.col("corrupt"), r"^[;\s]+|[;\s]+$", "")
    inner = F.when(inner.rlike('^".*"$'), F.replace(F.regexp_replace(inner, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(inner)
    row = F.from_csv(F.regexp_replace(inner, r"[;\s]+$", ""), AUDIT, {"mode": "PERMISSIVE"})
    return bad.select(row.alias("r")).select("r.*").filter("pair_id is not null")


def read_whole_audit(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All rows of an audit sheet, and whether each had to be rescued."""
    good, bad = read_audit(spark, path, header)
    return good.withColumn("rescued", F.lit(False)).unionByName(rescued(bad).withColumn("rescued", F.lit(True)))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A result of one row as one JSON document."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def training_rows(pairs: DataFrame) -> DataFrame:
    """What a trainer takes of pairs, as pairs.build makes them."""
    return pairs.select("prompt", "chosen", "rejected")


def materialised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made first if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialised_by(spark: SparkSession, path: str, by: str, wanted: Sequence[str], make) -> DataFrame:
    """The wanted parts of the table at path, one folder a value of by; make(missing) gives the rows of those that aren't there.

    Parts that are there aren't touched: only the folders of what is made are replaced.
    """
    there = {f.split("=", 1)[1] for f in folders_with(spark, f"{path.rstrip('/')}/{by}=*/*.parquet")}
    missing = [w for w in wanted if w not in there]
    if missing:
        made = make(missing).filter(F.col(by).isin(*missing))
        made.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return spark.read.parquet(path).filter(F.col(by).isin(*wanted))


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """One JSON document a row, each in the folder of its value of by."""
    rest = [c for c in df.columns if c != by]
    df.select(by, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def work_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/ratelens-work"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ratelens-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{work_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def work_table(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written and read again: what follows reads them instead of making them anew."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoints(folders: Iterable[str], wanted: Iterable[int] | None = None) -> list[tuple[int, str]]:
    """(step, folder) of checkpoint-N folders in order: the wanted steps that exist, and always the last one."""
    found = sorted((int(m[1]), f) for f in folders if (m := re.search(r"checkpoint-(\d+)/?$", f)))
    if wanted is None or not found:
        return found
    take = set(wanted) | {found[-1][0]}
    return [x for x in found if x[0] in take]


# --- text of small results, made on the driver ------------------------------------------


def fmt(x: float | None, signed: bool = False) -> str:
    return "n/a" if x is None else f"{x:+.2f}" if signed else f"{x:.2f}"


def fmt_interval(point: float | None, low: float | None, high: float | None, interpretable: bool = True) -> str:
    """+0.61 [+0.52, +0.70]; in brackets where it isn't to be interpreted."""
    text = fmt(point, True) if point is None or low is None or high is None else f"{point:+.2f} [{low:+.2f}, {high:+.2f}]"
    return text if interpretable or point is None else f"({text})"


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses one of more than so many rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a table for people")
    show = lambda v: "n/a" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])
