"""Readers and writers: archives, JSONL, chat files, logs, benchmark documents, CSV."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators.ranks import with_rank
from veritally.sources import jsonl
from veritally.sources.archive import read_member
from veritally.storage import written

RAW = "id string, locale string, partition string, scenario string, intent string, utt string, annot_utt string, worker_id string"
EXAMPLE = "id string, split string, scenario string, intent string, text string, slots array<struct<type:string,value:string>>"
CHAT = "messages array<struct<role:string,content:string>>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,reasoning_tokens:bigint,reported:boolean,estimated:boolean,estimate_method:string>"
PREDICTION = f"id string, config_hash string, text string, usage {USAGE}, latency_s double, wall_s double, finish_reason string, retries bigint, model_returned string, status_code int, ratelimit_headers map<string,string>, error string, error_kind string, retriable boolean, finished_at timestamp"
LOCK = "lock_version int, system string, subset string, subset_hash string, config_hash string, components map<string,string>, reason string, locked_at timestamp, git_commit string, git_dirty boolean"
#: Partition names and the splits they are.
SPLITS = ("train", "dev", "test")


def archive_locale(spark: SparkSession, archive: str, locale: str) -> DataFrame:
    """The rows of member ``*/data/{locale}.jsonl`` of a tar or tar.gz, which executors read in place; blank lines don't count."""
    lines = read_member(spark, archive, f"/data/{locale}.jsonl").where(F.trim("value") != "")
    return lines.select(F.from_json("value", RAW).alias("_r")).select("_r.*").where("id IS NOT NULL")


def to_examples(raw: DataFrame) -> DataFrame:
    """Raw rows as examples; an unknown partition is an error; the text is the plain request, the slots come from the markup."""
    from veritally.functions.text import parse_markup

    known = F.assert_true(F.col("partition").isin(*SPLITS), "unknown partition")
    checked = raw.where(known.isNull()).withColumn("_p", parse_markup(F.col("annot_utt")))
    sound = checked.where(F.assert_true(~F.col("_p.malformed"), "malformed markup").isNull())
    return sound.select("id", F.col("partition").alias("split"), "scenario", "intent", F.col("utt").alias("text"), F.col("_p.slots").alias("slots"))


def verify_sha256(path: str, expected: str) -> None:
    """An error if the file has another digest. An existing file is used as it is."""
    sha = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            sha.update(block)
    if sha.hexdigest() != expected:
        raise ValueError(f"{path} has SHA-256 {sha.hexdigest()}, not {expected}")


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE).json(path)


def write_chat(records: DataFrame, path: str) -> None:
    """One line per record with its messages; the ids go beside them under ``ids``, file by file and line by line, each with its record's digest."""
    line = F.to_json(F.struct("messages"))
    laid = written(records.select(line.alias("record"), F.col("id").cast("string").alias("id")), "chat")
    laid.select("record").write.text(f"{path}/records")
    laid.select(F.to_json(F.struct("id", F.sha2("record", 256).alias("sha256")))).write.text(f"{path}/ids")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 within a file, blank ones too, however the files are split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_in"))
    return with_rank(lines, [F.col("_start"), F.col("_in")], ["file"], "line").select("file", "line", "value")


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record): non-blank lines with their variant, null for bad JSON."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select("file", "line", F.try_parse_json("value").alias("record"))


def read_chat_with_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, record) of what `write_chat` wrote; a record without its id, or an id of another record, is an error."""
    digest = lambda c: F.sha2(c, 256)
    places = lambda df: df.select(F.regexp_extract("file", r"part-(\d+)", 1).alias("part"), "line", *df.columns[2:])
    records = places(numbered_lines(spark, f"{path}/records"))
    ids = places(numbered_lines(spark, f"{path}/ids")).withColumnRenamed("value", "beside")
    both = records.join(ids, ["part", "line"], "full_outer").withColumn("i", F.from_json("beside", "id string, sha256 string"))
    tied = F.assert_true(F.coalesce(digest(F.col("value")) == F.col("i.sha256"), F.lit(False)), "records and ids differ")
    return both.where(tied.isNull()).select("i.id", F.try_parse_json("value").alias("record"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log; empty if there is none yet."""
    return jsonl.read_rows(spark, path, PREDICTION).drop("file", "line")


def append_log(rows: DataFrame, path: str, commit: str | None = None) -> None:
    """All of the rows or none; under a ``commit`` name once, however often it is tried."""
    jsonl.append_rows(rows, path, commit)


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    return jsonl.read_rows(spark, path, LOCK).drop("file", "line")


def append_locks(rows: DataFrame, path: str, commit: str | None = None) -> None:
    """History only grows. `provenance.write_locks` refuses what must not be locked."""
    jsonl.append_rows(rows, path, commit)


def read_config(path: str) -> dict:
    """YAML if the library is present and the name says so, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, as often: for checks that a stored document isn't stale."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages): of a ``.txt`` each line is a user message; of a ``.jsonl`` each has ``messages`` or ``text``. A bad line is an error that names it."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    one = lambda c: F.array(F.struct(F.lit("user").alias("role"), c.alias("content")))
    if not path.endswith(".jsonl"):
        return lines.select("line", one(F.trim("value")).alias("messages"))
    v = F.try_parse_json("value")
    kind = "array<struct<role:string,content:string>>"
    messages = F.coalesce(F.try_variant_get(v, "$.messages", kind), F.when(F.try_variant_get(v, "$.text", "string").isNotNull(), one(F.try_variant_get(v, "$.text", "string"))))
    bad = F.concat(F.lit("no messages or text in line "), F.col("line").cast("string"))
    return lines.select("line", F.coalesce(messages, F.raise_error(bad).cast(kind)).alias("messages"))


def levels_of(document: Column) -> Column:
    """array<struct<concurrency, requests_per_s, p50, p95>> of a throughput document: a list of levels, or an object of them by name, under several spellings; latencies in seconds; booleans aren't numbers."""
    v = F.try_parse_json(document)
    found = F.coalesce(F.try_variant_get(v, "$.levels", "array<variant>"), F.map_values(F.try_variant_get(v, "$.levels", "map<string,variant>")), F.when(F.schema_of_variant(v).startswith("ARRAY<"), F.try_variant_get(v, "$", "array<variant>")))

    def number(m, *paths):
        take = lambda p: F.when(F.schema_of_variant(F.try_variant_get(m, p, "variant")) != "BOOLEAN", F.try_variant_get(m, p, "double"))
        return F.coalesce(*map(take, paths))

    return F.transform(
        found,
        lambda m: F.struct(
            number(m, "$.concurrency", "$.clients", "$.users").cast("int").alias("concurrency"), number(m, "$.requests_per_s", "$.req_per_s", "$.throughput").alias("requests_per_s"),
            number(m, "$.latency_s.p50", "$.p50_s", "$.p50").alias("p50"), number(m, "$.latency_s.p95", "$.p95_s", "$.p95").alias("p95"),
        ),
    )


def choose_by_token(names: list[str], token: str) -> tuple[list[str], list[str]]:
    """File names that hold the token as a word, and the others."""
    import re

    word = re.compile(rf"(?<![A-Za-z0-9]){re.escape(token)}(?![A-Za-z0-9])", re.IGNORECASE)
    chosen = [n for n in names if word.search(Path(n).stem)]
    return chosen, [n for n in names if n not in chosen]


def plain(value):
    """For JSON: numbers that aren't finite become null, anywhere."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not abs(value) < float("inf"):
        return None
    return value


def write_document(value, path: str) -> None:
    """A small JSON document, by way of a temporary name."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(plain(value), f, ensure_ascii=False, allow_nan=False, indent=1)
    os.replace(tmp, path)


def write_csv_once(df: DataFrame, path: str, force: bool = False) -> None:
    """One CSV file of a small result; refuses to overwrite unless forced."""
    df.coalesce(1).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table; reports are small, so the rows are collected, with a bound that is an error to pass."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table holds at most {limit} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def splice(document: str, name: str, text: str) -> str:
    """``document`` with what stands between the marks of a section replaced."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    before, found, rest = document.partition(begin)
    inner, closed, after = rest.partition(end)
    if not found or not closed:
        raise ValueError(f"the document has no section {name}")
    return f"{before}{begin}\n{text}\n{end}{after}"
