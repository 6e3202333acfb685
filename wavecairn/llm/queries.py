"""The ten queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecairn.llm import ann, arrow_stream, filter_audit, langid, licenses, linededup, mixing, packing, secrets, setsketch, simhash, topk, turns
from wavecairn.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, seed=42, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many were dropped as equal or near, and the MD5 of the text that is left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, classes=linededup.PRODUCTION)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("text_md5"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = langid.identify(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return arrow_stream.read_documents(arrow_stream.write_stream(_table(spark, sf_dir, "documents"), folder, end_id=1))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the path is source/lang/doc_id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licenses.scan_licenses(files).withColumnRenamed("id", "doc_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), words=5, percent=85)


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations")
    return turns.digests(talks, *turns.repair(turns.damage(talks)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_ann, op3_line_dedup, op4_secrets, op5_language, op6_token_stream, op7_top_k, op8_packing, op9_mixing, op10_licenses, op11_minhash, op12_turns, op13_filter_audit)}
ORACLES: dict[str, str] = {"op7_top_k": topk.ORACLE_SQL, "op10_licenses": licenses.oracle_sql("SELECT doc_id AS id, concat_ws('/', source, lang, doc_id) AS path, text FROM documents"), "op13_filter_audit": filter_audit.ORACLE_SQL}
