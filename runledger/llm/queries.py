"""The registered queries of this package and, where SQL can express them, their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_vector_shards(spark, sf_dir):
    from runledger.llm.shards import vector_shards

    return vector_shards(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )


@query
def op3_anchor_pii(spark, sf_dir):
    from runledger.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query
def op4_suffix_repetition(spark, sf_dir):
    from runledger.llm.quality import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents"))


@query
def op8_water_filling(spark, sf_dir):
    from runledger.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def _mix_sql():
    from runledger.llm.mixing import MIX_SQL

    return MIX_SQL


ORACLES["op8_water_filling"] = _mix_sql()


@query
def op10_pattern_packing(spark, sf_dir):
    from runledger.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query
def op7_stable_projections(spark, sf_dir):
    from runledger.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_prefix_jaccard(spark, sf_dir):
    from runledger.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op9_pitman_yor(spark, sf_dir):
    from runledger.llm.language import pitman_yor_scores

    return pitman_yor_scores(table(spark, sf_dir, "documents"))


@query
def op5_host_wrappers(spark, sf_dir):
    from runledger.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op2_tool_links(spark, sf_dir):
    from runledger.llm.toolcalls import TOOLS, calls_of, linked_calls

    return linked_calls(*calls_of(table(spark, sf_dir, "conversations")), TOOLS)


def _link_sql():
    from runledger.llm.toolcalls import LINK_SQL

    return LINK_SQL


ORACLES["op2_tool_links"] = _link_sql()


@query
def op13_ppm_language(spark, sf_dir):
    from runledger.llm.ppm import predicted_languages

    return predicted_languages(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    from runledger.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql():
    from runledger.llm.audit import AUDIT_SQL

    return AUDIT_SQL


ORACLES["op11_filter_audit"] = _audit_sql()


@query
def op12_angular_negatives(spark, sf_dir):
    from runledger.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def _negatives_sql():
    from runledger.llm.negatives import NEGATIVES_SQL

    return NEGATIVES_SQL


ORACLES["op12_angular_negatives"] = _negatives_sql()
