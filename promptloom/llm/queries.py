"""Queries of this subpackage's operators over the tables of TESTDATA.md."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.oracles import oracle_sql  # noqa: F401
from promptloom.llm.packing import pack_documents
from promptloom.llm.pairs import defective_pairs
from promptloom.llm.pii import redact_texts
from promptloom.llm.sampling import ProportionalSample, resolve_values
from promptloom.llm.subjects import assign_subjects, fit_subject_model
from promptloom.llm.terms import mark_terms, term_counts
from promptloom.llm.tokens import encode_corpus, token_counts
from promptloom.llm.truncation import field_limits, fit_cut_model, score_cuts
from promptloom.sources import materialise, once, read_table

FIELDS = ["category", "urgency", "domain"]


def _sampler(spark: SparkSession, sf_dir: str) -> ProportionalSample:
    targets = read_table(spark, sf_dir, "sample_targets")
    listed = {f: [r[0] for r in targets.select(f).dropna().distinct().orderBy(f).collect()] for f in FIELDS}
    runs = read_table(spark, sf_dir, "ticket_run").select(
        F.col("run_id").alias("record_id"), F.col("classification.category").alias("category"), F.col("classification.urgency").alias("urgency")
    )
    routed = read_table(spark, sf_dir, "routing").select(F.col("query_id").alias("record_id"), "domain")
    runs = resolve_values(once(runs, "record_id"), {f: listed[f] for f in FIELDS[:2]}).withColumn("domain", F.lit(None).cast("string"))
    routed = resolve_values(once(routed, "record_id"), {"domain": listed["domain"]})
    routed = routed.withColumns({f: F.lit(None).cast("string") for f in FIELDS[:2]})
    # Read three times below (counts, bucket counts, draw), so resolved once.
    return ProportionalSample(materialise(runs.unionByName(routed), "p1-records"), targets, FIELDS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).report().filter("shortfall > 0").select("target_id")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).sample()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).report()


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "ticket_run").select("run_id", "ticket.cleaned_text", "classification.description")
    # Without a key of the caller's, placeholders link texts within one run of the query only.
    key = os.environb.get(b"PROMPTLOOM_PII_KEY") or secrets.token_bytes(32)
    return redact_texts(runs, ["cleaned_text", "description"], key)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_types").alias("types")) for f in ("cleaned_text", "description")]
    found = _redacted(spark, sf_dir).dropna(subset=["run_id"]).select("run_id", F.inline(F.array(*fields)))
    return found.select("run_id", "field_name", F.explode("types").alias("pii_type")).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(_redacted(spark, sf_dir), "run_id")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = once(read_table(spark, sf_dir, "ticket_run", "run_id", "keywords"), "run_id")
    return mark_terms(term_counts(runs, "keywords"), fewer_than=3, more_than_percent=8)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).filter("mark IS NOT NULL").select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("term", "occurrences", "records", "mark")


def _answer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, row_id, field, backend, text of every value that could be cut."""
    parts = []
    for table, row_id, fields in (("task_results", "result_id", ("answer", "reasoning")), ("answers", "answer_id", ("answer", "reasoning")), ("routing", "query_id", ("reasoning",))):
        texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
        df = read_table(spark, sf_dir, table, row_id, "backend", *fields)
        parts.append(df.select(F.lit(table).alias("source"), F.col(row_id).alias("row_id"), "backend", F.inline(texts)).filter("text IS NOT NULL"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cuts(spark: SparkSession, sf_dir: str, cut_only: bool) -> tuple[DataFrame, float]:
    values = _answer_values(spark, sf_dir)
    limits = field_limits(values)
    model = fit_cut_model(values, limits)
    return score_cuts(values, model, limits, cut_only), model.threshold


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts delivered again are scored again, which is cheaper than an exchange of all texts; the few hits count once.
    hits, _ = _cuts(spark, sf_dir, True)
    return hits.select(F.col("source").alias("table_name"), "row_id", F.col("field").alias("field_name")).dropna().distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, threshold = _cuts(spark, sf_dir, False)
    each = once(scored.select("source", "row_id", "field", "backend", (F.col("score") >= threshold).cast("long").alias("cut")), "source", "row_id", "field")
    return each.groupBy(F.col("source").alias("table_name"), F.col("field").alias("field_name"), "backend").agg(
        F.count("*").alias("n_values"), F.sum("cut").alias("n_cut"), (F.sum("cut") / F.count("*")).alias("cut_share")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read_table(spark, sf_dir, "task_results", "result_id", "query", "answer", "error").filter("error IS NULL")
    runs = read_table(spark, sf_dir, "ticket_run", "run_id", "ticket", "classification", "solution").filter("solution IS NOT NULL")
    return defective_pairs(
        tasks.select(
            F.lit("task_results").alias("table_name"), F.col("result_id").alias("row_id"), F.col("query").alias("prompt"),
            F.array("answer").alias("parts"), F.lit(None).cast("string").alias("context"),
        ).unionByName(
            runs.select(
                F.lit("ticket_run").alias("table_name"), F.col("run_id").alias("row_id"), F.col("classification.description").alias("prompt"),
                F.col("solution.solution_steps").alias("parts"), F.col("ticket.cleaned_text").alias("context"),
            )
        )
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return pack_documents(sizes, "doc_id", "tokens", read_table(spark, sf_dir, "containers"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind, how many documents lie in containers, and how many containers or documents break a rule."""
    packed = materialise(p7_packed(spark, sf_dir), "p7")
    containers = packed.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("held"), F.max("filled").alias("filled"))
    bad = (F.col("held") > F.col("capacity_tokens")) | (F.col("held") != F.col("filled"))
    each = containers.groupBy("container_kind").agg(F.count_if(bad).alias("overfull"))
    whole = packed.groupBy("container_kind", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    torn = (F.col("last") != F.col("pieces") - 1) | (F.col("pieces") != F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1)))
    documents = whole.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(torn).alias("torn"))
    return documents.join(each, "container_kind")


def _subjects(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in read_table(spark, sf_dir, "subject_areas", "subject").dropna().distinct().orderBy("subject").collect()]


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return assign_subjects(documents, read_table(spark, sf_dir, "labels", "doc_id", "subject"), "doc_id", "text", _subjects(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, and how much of them, each subject has."""
    of = _assigned(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
    return of.select("subject", "documents", F.round("weight", 6).alias("weight"))


def p8_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics with their top terms and the subjects they were mapped to, for inspection."""
    documents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "subject")
    model = fit_subject_model(documents, labels, _subjects(spark, sf_dir))
    schema = "topic int, subject string, support double, weight double, terms array<string>"
    return spark.createDataFrame(model.top_terms() if model else [], schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
