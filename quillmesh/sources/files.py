"""Sources and sinks: markdown folders, front matter, JSONL datasets, sessions, reports, snapshots."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..session import file_system

SEARCH_SCHEMA = "id string, query string, answerable boolean, expected_notes array<string>, expected_spans array<struct<note_path:string,start:int,end:int,text:string>>, language string, difficulty string, tags array<string>, source string, created_at string, expected_answer_summary string, category string"
LINKS_SCHEMA = "id string, source_note string, anchor string, expected_links array<string>, anchor_range struct<start:int,end:int>, context string, language string, tags array<string>, created_at string"
FRONT = "id string, title string, type string, created string, modified string, tags array<string>, aliases array<string>, front_matter map<string,string>, body string"
LANGUAGES, DIFFICULTIES = ("ko", "en", "ja", "zh", "es", "fr", "de"), ("easy", "mid", "hard")


def read_markdown(spark: SparkSession, root: str, skip: tuple[str, ...] = ("node_modules",)) -> DataFrame:
    """path, basename, content and mtime of the .md files under root; dot folders and `skip` are left out. A root that does not
    exist, or has none, gives no rows."""
    fs, at = file_system(spark, root)
    if not fs.exists(at):
        return spark.createDataFrame([], "path string, basename string, content string, mtime timestamp")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    inner = F.substring("path", F.length(F.regexp_extract("path", "^(.*" + root.rstrip("/").replace("file://", "") + "/)", 1)) + 1, F.lit(1 << 20))
    for name in skip:
        df = df.filter(~F.contains(F.concat(F.lit("/"), inner), F.lit(f"/{name}/")))
    return df.filter(~F.rlike(F.concat(F.lit("/"), inner), F.lit(r"/\."))).select("path", T.basename("path").alias("basename"), F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("mtime"))


def _value(raw: str):
    raw = raw.strip()
    if raw.startswith("[") and raw.endswith("]"):
        return [v.strip().strip("\"'") for v in raw[1:-1].split(",") if v.strip()]
    return raw.strip("\"'")


def parse_front_matter(text: str) -> dict:
    """The flat subset of YAML that notes use: scalars, inline lists and dash lists; anything else stays a string."""
    lines = (text or "").split("\n")
    got: dict = {}
    body = text or ""
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end:
            body, key = "\n".join(lines[end + 1 :]).lstrip("\n"), None
            for line in lines[1:end]:
                if line.strip().startswith("- ") and key is not None:
                    got[key] = [*(got[key] if isinstance(got[key], list) else []), _value(line.strip()[2:])]
                elif ":" in line and not line.startswith((" ", "\t", "#")):
                    key, _, raw = line.partition(":")
                    key = key.strip()
                    got[key] = _value(raw)
    many = lambda v: v if isinstance(v, list) else ([v] if v else None)
    one = lambda k: got.get(k) if isinstance(got.get(k), str) and got.get(k) else None
    return {
        **{k: one(k) for k in ("id", "title", "type", "created", "modified")},
        "tags": got.get("tags") if isinstance(got.get("tags"), list) else None,
        "aliases": many(got.get("aliases", got.get("alias"))),
        "front_matter": {k: ", ".join(v) if isinstance(v, list) else v for k, v in got.items()},
        "body": body,
    }


def with_front_matter(files: DataFrame) -> DataFrame:
    """files with the columns of FRONT parsed from content."""

    @F.pandas_udf(FRONT)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_front_matter(t) for t in texts], columns=[f.split(" ")[0] for f in ("id string", "title string", "type string", "created string", "modified string", "tags x", "aliases x", "front_matter x", "body x")])

    return files.withColumn("_f", parse("content")).select(*files.columns, "_f.*")


def notes(files: DataFrame) -> DataFrame:
    """Notes for the graph and index operators: id falls back to the basename, title to the basename."""
    f = with_front_matter(files)
    return f.select("path", F.coalesce("id", "basename").alias("id"), F.coalesce("title", "basename").alias("title"), "basename", "aliases", F.col("body").alias("content"), "type", "tags", "created", "modified", "mtime", T.content_hash("content").alias("content_hash"))


def note_info(files: DataFrame) -> DataFrame:
    """path, title by pattern, inline aliases and distinct H1 to H3 headers of two code points or more."""
    title = F.regexp_extract("content", r"(?m)^title:\s*[\"']?(.+?)[\"']?\s*$", 1)
    inline = F.regexp_extract("content", r"(?m)^aliases:\s*\[(.*?)\]", 1)
    heads = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), lambda x: F.trim(x)), lambda h: F.length(h) >= 2))
    return files.select("path", F.when(title != "", title).otherwise(T.basename("path")).alias("title"), F.filter(F.transform(F.split(inline, ","), lambda a: F.regexp_replace(F.trim(a), "^[\"']|[\"']$", "")), lambda a: F.length(a) > 0).alias("aliases"), heads.alias("headers"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSONL dataset with `problem`, null where a row is right; blank lines and # lines are skipped.

    Lenient: wrong rows stay, with their line and problem, for a quarantine. Strict: the first one fails the read.
    """
    return jsonl_rows(spark.read.text(path), schema, strict)


def jsonl_rows(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """read_jsonl of lines in column value, of a table or a stream."""
    some = lines.filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    row = F.from_json("value", schema + ", _corrupt string", {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return some.select("value", row.alias("r")).select("r.*", F.col("value").alias("line"))


def search_problem():
    ok = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    spans = F.coalesce(F.forall("expected_spans", lambda s: (s["start"] >= 0) & (s["end"] >= s["start"])), F.lit(True))
    return (
        F.when(F.col("_corrupt").isNotNull(), "json")
        .when(~ok("id"), "id")
        .when(~ok("query"), "query")
        .when(F.col("answerable").isNull(), "answerable")
        .when(F.col("expected_notes").isNull(), "expected_notes")
        .when(F.col("language").isNotNull() & ~F.col("language").isin(*LANGUAGES), "language")
        .when(F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(*DIFFICULTIES), "difficulty")
        .when(~spans, "expected_spans")
    )


def links_problem():
    ok = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return (
        F.when(F.col("_corrupt").isNotNull(), "json")
        .when(~ok("id"), "id")
        .when(~ok("source_note"), "source_note")
        .when(~ok("anchor"), "anchor")
        .when(F.coalesce(F.size("expected_links"), F.lit(0)) < 1, "expected_links")
        .when(F.col("anchor_range").isNotNull() & (F.col("anchor_range.end") <= F.col("anchor_range.start")), "anchor_range")
    )


def load_dataset(spark: SparkSession, path: str, kind: str = "search", strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Right rows, wrong rows (line, problem), and one row of counts with the success rate."""
    rows = read_jsonl(spark, path, SEARCH_SCHEMA if kind == "search" else LINKS_SCHEMA, strict).withColumn("problem", search_problem() if kind == "search" else links_problem())
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("problem").isNull()).alias("right"))
    return rows.filter("problem is null").drop("problem", "_corrupt", "line"), rows.filter("problem is not null").select("line", "problem"), counts.withColumn("success_rate", F.when(F.col("total") > 0, F.col("right") / F.greatest("total", F.lit(1))).otherwise(1.0))


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """id, created_at, updated_at, tags, messages and month of session files YYYY-MM/*.json."""
    schema = "id string, createdAt string, updatedAt string, tags array<string>, messages array<struct<role:string,content:string>>"
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    return df.select("id", F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), "tags", "messages", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2})/[^/]*$", 1).alias("month"))


#: The fields that a snapshot of an evaluation holds.
SNAPSHOT_FIELDS = ("version", "created_at", "run_id", "dataset_hash", "notes_hash", "notes_hash_mode", "environment", "config", "metrics")


def read_snapshot(spark: SparkSession, path: str, version: str = "1.0", required: tuple[str, ...] = ()) -> DataFrame:
    """A snapshot's one row; one of another version, or that lacks a required field (a dotted path; see SNAPSHOT_FIELDS), fails
    when it is read, and says what is wrong."""
    df = spark.read.option("multiLine", "true").json(path)
    known = set(_paths(df.schema))
    missing = F.lit(", ".join(f for f in required if f not in known))
    right = F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("snapshot version "), F.coalesce(F.col("version").cast("string"), F.lit("unknown")))))
    return df.withColumn("version", F.when(missing == "", right).otherwise(F.raise_error(F.concat(F.lit("snapshot lacks "), missing))))


def _paths(schema, before: str = "") -> list[str]:
    """Dotted paths of all fields."""
    out = []
    for f in schema.fields:
        out.append(before + f.name)
        if hasattr(f.dataType, "fields"):
            out += _paths(f.dataType, f"{before}{f.name}.")
    return out


def write_report(summary: DataFrame, per_item: DataFrame, errors: DataFrame, out: str) -> None:
    """summary, per_item and errors as JSON lines under `out`, and the one-row summary as a Markdown table."""
    for name, df in (("summary", summary), ("per_item", per_item), ("errors", errors)):
        df.write.mode("overwrite").json(f"{out}/{name}")
    rows = F.array(*[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), F.lit(" |")) for c in summary.columns])
    text = F.concat(F.lit("# Evaluation\n\n| metric | value |\n|-|-|\n"), F.array_join(rows, "\n"))
    summary.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/summary_md")


def write_snapshot(spark: SparkSession, out: str, fields: dict, version: str = "1.0") -> None:
    """A snapshot's fields as one JSON row; read_snapshot reads it."""
    row = {"version": version, **fields}
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("overwrite").json(out)


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers under root, oldest first: CURRENT-<number>-<folder>."""
    fs, at = file_system(spark, root)
    if not fs.exists(at):
        return []
    return sorted(n for f in fs.listStatus(at) if re.fullmatch(r"CURRENT-\d{12}-v-[0-9a-f]{32}", n := f.getPath().getName()))


def write_state(state: DataFrame, root: str) -> None:
    """A table as the current state under root.

    It is written to a folder of its own; then a pointer with the next number names that folder. Readers take the pointer of
    the highest number, and making one is a single step of any store, so at every moment the old or the new state is
    whole and readable, whatever crashes. A reader may still hold the state before: it and its pointer stay until one more
    has been written.
    """
    spark, name = state.sparkSession, f"v-{uuid.uuid4().hex}"
    state.write.parquet(f"{root}/{name}")
    old = _pointers(spark, root)
    number = int(old[-1].split("-")[1]) + 1 if old else 1
    fs, at = file_system(spark, f"{root}/CURRENT-{number:012d}-{name}")
    fs.create(at, False).close()
    for pointer in old[:-1]:
        fs.delete(file_system(spark, f"{root}/{pointer}")[1], False)
        fs.delete(file_system(spark, f"{root}/{pointer.split('-', 2)[2]}")[1], True)


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The current state under root; None where there is none, or where the pointer names a folder that is gone or no table.
    Any other failure is the caller's."""
    pointers = _pointers(spark, root)
    if not pointers:
        return None
    try:
        return spark.read.parquet(f"{root}/{pointers[-1].split('-', 2)[2]}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunks with their embeddings at unit length."""
    chunks.withColumn("embedding", V.l2_normalize("embedding").cast("array<float>")).write.mode("append").parquet(path)


def _inner(root: str):
    """A file's path below root."""
    return F.substring("path", F.length(F.regexp_extract("path", "^(.*" + root.rstrip("/").replace("file://", "") + "/)", 1)) + 1, F.lit(1 << 20))


def glob_files(spark: SparkSession, root: str, pattern: str, limit: int | None = 100, depth: int = 10) -> DataFrame:
    """The first `limit` files by path that match, at most `depth` folders down: path, length, mtime.

    A pattern without / is one of names in any folder; otherwise ** stands for any folders, * and ? stay within a name.
    """
    whole = pattern if "/" in pattern else f"**/{pattern}"
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", whole)
    put = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    want = "^" + "".join(put.get(p) or "".join("\\" + c if c in r"\.[]{}()+-^$|" else c for c in p) for p in parts) + "$"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("mtime"), _inner(root).alias("_i"))
    kept = df.filter(F.rlike("_i", F.lit(want)) & (F.size(F.split("_i", "/")) <= depth + 1)).drop("_i").orderBy("path")
    return kept if limit is None else kept.limit(limit)


def list_files(spark: SparkSession, root: str, pattern: str = "*.md", limit: int = 100, by: str | None = None, descending: bool = False) -> DataFrame:
    """path, title, size and mtime of the first `limit` matching files, then sorted by title, size or mtime: the limit comes
    first."""
    files = glob_files(spark, root, pattern, limit).select("path", T.basename("path").alias("title"), F.col("length").alias("size"), "mtime")
    return files if by is None else files.orderBy(F.desc(by) if descending else F.asc(by), "path")


def validate_sample(spark: SparkSession, path: str, kind: str = "search", valid: int = 10) -> DataFrame:
    """The rows of a dataset up to its `valid`-th right one, in file order: line and problem (null: right)."""
    rows = read_jsonl(spark, path, SEARCH_SCHEMA if kind == "search" else LINKS_SCHEMA).withColumn("problem", search_problem() if kind == "search" else links_problem())
    placed = rows.select("line", "problem", F.monotonically_increasing_id().alias("_at"))
    last = placed.filter("problem is null").orderBy("_at").limit(valid).agg(F.max("_at").alias("_last"), F.count("*").alias("_n"))
    return placed.join(F.broadcast(last)).filter((F.col("_n") < valid) | (F.col("_at") <= F.col("_last"))).orderBy("_at").select("line", "problem")


def dataset_stream(spark: SparkSession, path: str, kind: str = "search") -> DataFrame:
    """A stream of a folder's dataset rows with `problem`, a few files at a time."""
    rows = jsonl_rows(spark.readStream.option("maxFilesPerTrigger", 8).text(path), SEARCH_SCHEMA if kind == "search" else LINKS_SCHEMA)
    return rows.withColumn("problem", search_problem() if kind == "search" else links_problem())


#: Folders and endings that don't count for the hash of a corpus; its own state folder is an argument.
HASH_SKIP, HASH_ENDINGS = (".git", "eval", "node_modules", ".DS_Store"), (".tmp", ".swp")


def read_for_hash(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path, content_hash and mtime of the files whose hash a corpus hash folds."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("_i", F.concat(F.lit("/"), _inner(root)))
    for name in (*HASH_SKIP, *skip):
        df = df.filter(~F.contains(F.concat("_i", F.lit("/")), F.lit(f"/{name}/")))
    for end in HASH_ENDINGS:
        df = df.filter(~F.endswith("_i", F.lit(end)))
    return df.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("mtime"))
