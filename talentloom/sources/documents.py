"""Documents in and profiles out: reading, checks, dedupe, replace, cascade."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import store

IDENTITY = ("file_hash", "document_type", "owner_id")


def read_documents(spark: SparkSession, path: str, document_type: str) -> DataFrame:
    """Files below ``path`` as rows: original_filename, mime_type, file_size, content, file_hash, document_type, created_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ends = {extension: mime for mime, extension in config.MIME_EXTENSION.items()}
    mime = T.lookup(F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1))), ends)
    return files.select(
        F.sha2(F.col("path").cast("binary"), 256).alias("document_id"), F.lit(None).cast("string").alias("owner_id"), F.lit(document_type).alias("document_type"),
        name.alias("original_filename"), F.coalesce(mime, F.lit("application/octet-stream")).alias("mime_type"), F.col("length").alias("file_size"), "content",
        F.sha2("content", 256).alias("file_hash"), F.lit("UPLOADED").alias("status"), F.col("modificationTime").alias("created_at"),
    )


def read_job_payloads(payloads: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): pasted ``{"text": ...}`` offers become plain-text files; blank ones are rejected."""
    parsed = payloads.withColumn("_t", F.from_json(column, "text string")["text"])
    fine = T.strip(F.coalesce("_t", F.lit(""))) != ""
    content = F.col("_t").cast("binary")
    docs = parsed.filter(fine).select(
        *[c for c in payloads.columns if c != column], F.lit("JOB_OFFER").alias("document_type"), F.lit(config.PASTED_NAME).alias("original_filename"),
        F.lit("text/plain").alias("mime_type"), F.octet_length(content).cast("long").alias("file_size"), content.alias("content"), F.sha2(content, 256).alias("file_hash"),
    )
    return docs, parsed.filter(~fine).drop("_t")


def reject_reason(docs: DataFrame) -> DataFrame:
    """Add reject_reason: the first rule that an upload breaks, null if none."""
    known = F.col("mime_type").isin(*config.MIME_EXTENSION)
    fits = F.lit(False)
    for mime, extension in config.MIME_EXTENSION.items():
        fits = fits | ((F.col("mime_type") == mime) & F.lower("original_filename").endswith(extension))
    reason = (
        F.when(F.col("file_size") < config.MIN_BYTES, "empty file").when(F.col("file_size") > config.MAX_BYTES, "file too large")
        .when(~known, "unsupported type").when(~fits, "extension does not match type")
    )
    return docs.withColumn("reject_reason", reason)


def validate_uploads(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason)."""
    judged = reject_reason(docs)
    return judged.filter("reject_reason is null").drop("reject_reason"), judged.filter("reject_reason is not null")


def dedupe_uploads(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with stored_id, is_new, needs_processing.

    The same (hash, type, owner), null owner equal to null owner, reuses the
    stored document, or else the first of the batch.
    """
    keyed = lambda df, mark: df.select(*[F.col(k).alias(f"_{mark}{i}") for i, k in enumerate(IDENTITY)], "*")
    same = lambda mark: [F.col(k).eqNullSafe(F.col(f"_{mark}{i}")) for i, k in enumerate(IDENTITY)]
    names = lambda mark: [f"_{mark}{i}" for i in range(len(IDENTITY))]
    old = keyed(existing, "o").groupBy(*names("o")).agg(F.min(F.struct("document_id", "status")).alias("_old"))
    first = keyed(new, "f").groupBy(*names("f")).agg(F.min("document_id").alias("_first"))
    told = new.join(old, same("o"), "left").join(first, same("f"), "left")
    is_new = F.col("_old").isNull() & (F.col("document_id") == F.col("_first"))
    waiting = F.col("_old.status").isin("UPLOADED", "FAILED")
    return told.select(
        *new.columns, F.coalesce("_old.document_id", "_first").alias("stored_id"), is_new.alias("is_new"),
        F.when(F.col("_old").isNull(), is_new).otherwise(waiting).alias("needs_processing"),
    )


def parse_plain_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with raw_text and status, blocks(document_id, block_idx, text)).

    Bytes that are not UTF-8 and blank texts fail. Blocks are the trimmed,
    non-empty parts between blank lines.
    """
    text = F.col("content").cast("string")
    fine = F.is_valid_utf8(text) & (T.strip(text) != "")
    parsed = docs.withColumns({"raw_text": F.when(F.coalesce(fine, F.lit(False)), text), "status": F.when(F.coalesce(fine, F.lit(False)), "PROCESSED").otherwise("FAILED")})
    parts = F.filter(F.transform(F.split("raw_text", "\n\n", -1), T.strip), lambda x: x != "")
    blocks = T.numbered(parsed.filter("raw_text is not null"), parts, "block_idx", "text", "document_id")
    return parsed, blocks


def replaced(existing: DataFrame, new: DataFrame, key: str = "document_id", of: DataFrame | None = None) -> DataFrame:
    """``existing`` with the rows of every reprocessed key replaced by ``new``.

    ``of``: the reprocessed keys, if some may have no rows any more.
    """
    keys = (new if of is None else of).select(key).distinct()
    return existing.join(keys, key, "left_anti").unionByName(new)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the one that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting uses this machine's temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="talentloom-")


def write_profiles(tables: dict[str, DataFrame], processed: DataFrame, path: str) -> int:
    """Replace the rows of the ``processed`` documents (document_id) by those of ``tables`` (name -> rows), in all of them or in none.

    The tables stand in the store at ``path``; only what is new is written. Rows and ids
    may be read from that store. Returns the store's version.
    """
    keys = {name: ("document_id",) for name in tables}
    return store.commit(processed.sparkSession, path, keys, tables, {name: processed for name in tables})


def read_profiles(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table that write_profiles stored (None if there is none yet)."""
    return store.read(spark, path, name)


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (entity_type, entity_id, model, version): that of ``new`` if it has one (its newest by created_at), else the existing one."""
    keys = ["entity_type", "entity_id", "model", "version"]
    both = existing.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.desc("created_at"))
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_n")


#: Keys of the stored tables that do not go by document.
TABLE_KEYS = {
    "analyses": ("analysis_id",), "evaluations": ("analysis_id",), "recommendations": ("analysis_id",), "plans": ("analysis_id",), "changes": ("plan_id",),
    "embeddings": ("entity_type", "entity_id"),
}
PROFILES = ("CANDIDATE_PROFILE", "JOB_PROFILE")


def gone_keys(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The keys of all rows of ``tables`` that hang on the documents in ``ids`` (document_id), by table.

    Tables with document_id lose its rows; analyses go from either side, and
    with them evaluations, recommendations, plans and changes; embeddings go by
    entity. What belongs to the other side of an analysis stays.
    """
    gone = ids.select("document_id").distinct()
    analyses = tables.get("analyses")
    dead = plans = None
    if analyses is not None:
        hit = lambda c: analyses.join(gone.select(F.col("document_id").alias(c)), c, "left_semi").select("analysis_id")
        dead = hit("candidate_document_id").unionByName(hit("job_document_id")).distinct()
        if "plans" in tables:
            plans = tables["plans"].join(dead, "analysis_id", "left_semi").select("plan_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "embeddings":
            out[name] = gone.select(F.explode(F.array(*[F.lit(x) for x in PROFILES])).alias("entity_type"), F.col("document_id").alias("entity_id"))
        elif "analysis_id" in df.columns and dead is not None:
            out[name] = dead
        elif "plan_id" in df.columns and plans is not None:
            out[name] = plans
        elif "document_id" in df.columns:
            out[name] = gone
    return out


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ``ids`` (document_id) and what hangs on them."""
    gone = gone_keys(tables, ids)
    return {name: df.join(gone[name], gone[name].columns, "left_anti").select(*df.columns) if name in gone else df for name, df in tables.items()}


def delete_stored_documents(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """The same in the store at ``path``: one commit of keys; no row is rewritten."""
    names = dict.fromkeys(r.name for r in store.log(spark, path))
    tables = {name: found for name in names if (found := store.read(spark, path, name)) is not None}
    gone = gone_keys(tables, ids)
    return store.commit(spark, path, {name: tuple(df.columns) for name, df in gone.items()}, {}, gone)


def delete_tailoring_plans(plans: DataFrame, changes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and changes without those in ``ids`` (plan_id)."""
    gone = ids.select("plan_id").distinct()
    return plans.join(gone, "plan_id", "left_anti"), changes.join(gone, "plan_id", "left_anti")


def rename_pasted_jobs(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pasted offers take their title (255 characters at most) as file name."""
    named = docs.join(profiles.select("document_id", F.col("title").alias("_t")), "document_id", "left")
    title = F.substring(T.blank_to_null(F.col("_t")), 1, 255)
    name = F.when((F.col("original_filename") == config.PASTED_NAME) & title.isNotNull(), title).otherwise(F.col("original_filename"))
    return named.withColumn("original_filename", name).drop("_t").select(*docs.columns)


def save_analyses(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an analysis_id that is saved again are replaced; other analyses of the same pair stay."""
    return replaced(existing, new, "analysis_id")
