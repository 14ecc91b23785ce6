"""Finding session artifacts: a manifest of files with their kind, from any file system Spark reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, last_segment

# Folders, names and endings that are never read.
SKIP_FOLDERS = ["cache", "statsig", "shell-snapshots", "session-env", "ide", "paste-cache", "debug", "telemetry"]
SKIP_NAMES = [".DS_Store", "settings.json"]
SKIP_ENDINGS = ["lock", "highwatermark"]

# Kinds of files by their path below the root, the first that fits.
KINDS = [
    ("stats_cache", r"(^|/)stats-cache\.json$"),
    ("history", r"(^|/)history\.jsonl$"),
    ("session_index", r"^projects/.*?(^|/)sessions-index\.json$"),
    ("session_log", r"^projects/.*\.jsonl$"),
    ("tool_result", r"^projects/.*tool-results/(.*/)?toolu_[^/]*\.txt$"),
    (None, r"^projects/"),
    ("task", r"^tasks/.*\.json$"),
    (None, r"^tasks/"),
    ("todo", r"^todos/.*\.json$"),
    (None, r"^todos/"),
    ("facet", r"^usage-data/facets/.*\.json$"),
    ("plan", r"^plans/.*\.md$"),
    (None, r"^plans/"),
    ("chat_session", r"(^|/)chats/(.*/)?session-[^/]*\.json$"),
    ("desktop_index", r"(^|/)claude-code-sessions/(.*/)?local_[^/]*\.json$"),
    ("rollout", r"(^|/)sessions/(.*/)?rollout-[^/]*\.jsonl$"),
]
ORDER = ["session_index", "desktop_index", "session_log", "chat_session", "rollout", "task", "facet", "stats_cache", "plan", "history", "todo", "tool_result"]


def kind_of(relative: Column) -> Column:
    return reduce(lambda c, k: c.when(relative.rlike(k[1]), F.lit(k[0])), KINDS, F).otherwise(F.lit(None))


SCHEME = r"^[a-z]+:/+"


def below(path: str, root: str) -> Column:
    """Whether a listed path lies below ``root``, whatever file system either names."""
    base = F.concat(F.regexp_replace(F.lit(root.rstrip("/")), SCHEME, "/"), F.lit("/"))
    return F.startswith(F.regexp_replace(path, SCHEME, "/"), base)


def manifest(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """(path, relative, name, kind, mtime in ms, size) of all files of a known kind below ``root``.

    The files' contents are not read: only listing columns are selected. ``exclude`` holds
    globs over the relative path. Sorted by kind and path when shown.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), SCHEME, "/")
    plain = F.regexp_replace("path", SCHEME, "/")
    rows = files.select(
        "path", F.substr(plain, F.length(base) + 2).alias("relative"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")
    ).withColumn("name", last_segment(F.col("relative")))
    folders = "|".join(SKIP_FOLDERS)
    rows = rows.filter(~F.col("relative").rlike(rf"(^|/)({folders})/") & ~F.col("name").isin(SKIP_NAMES) & ~F.col("name").rlike(rf"\.({'|'.join(SKIP_ENDINGS)})$"))
    for pattern in exclude:
        rows = rows.filter(~F.col("relative").rlike(glob_regex(pattern)))
    return rows.withColumn("kind", kind_of(F.col("relative"))).filter("kind IS NOT NULL")


def ordered(files: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    return files.orderBy(rank, "path")


def counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def manifests(spark: SparkSession, sources: list, exclude: list[str] = ()) -> DataFrame:
    """One manifest of the files of all ``config.Source`` entries, with the source's name and kind; a file that two roots hold belongs to the first."""
    parts = [manifest(spark, s.path, exclude).withColumns({"source_name": F.lit(s.name), "source_kind": F.lit(s.kind.lower()), "rank": F.lit(i)}) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("path").orderBy("rank")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def raw_preview(lines: DataFrame, most: int = 100, shown: int = 50) -> DataFrame:
    """(file, ord, type, role, preview) of raw lines: at most ``most`` characters of the text or of the first block, else its type in brackets.

    A line that is not JSON has type 'error', no role and its first ``shown`` characters.
    """
    v = F.try_parse_json("value")
    get = lambda path: F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.message.content", "variant"))
    block = F.when(get("$.message.content[0].type") == "text", F.coalesce(F.left(get("$.message.content[0].text"), F.lit(most)), F.lit(""))).otherwise(F.concat(F.lit("["), get("$.message.content[0].type"), F.lit("]")))
    preview = F.when(kind == "STRING", F.left(get("$.message.content"), F.lit(most))).when(kind.startswith("ARRAY"), block)
    role = F.coalesce(F.nullif(get("$.message.role"), F.lit("")), get("$.role"), F.lit(""))
    good = v.isNotNull()
    return lines.select(
        "file", "ord",
        F.when(good, F.coalesce(F.nullif(get("$.type"), F.lit("")), F.lit("unknown"))).otherwise("error").alias("type"),
        F.when(good, role).otherwise("").alias("role"),
        F.when(good, F.coalesce(preview, F.lit(""))).otherwise(F.left("value", F.lit(shown))).alias("preview"),
    )
