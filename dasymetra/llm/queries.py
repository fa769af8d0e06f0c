"""Queries p3, p6, p7 and p8: the text operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from dasymetra.llm import bpe, encoding, mixing, residue
from dasymetra.plans.common import cut_lineage, table

TOKENIZER = "byte_bpe_50k"


#: The name fields in which garbled text is looked for: table, key, name, and what tells one delivery from another.
NAME_FIELDS = (("merged", "row_id", "nm_municipio", "ano_eleicao"), ("dictionary", "dict_id", "candidate_name", "ano_eleicao"), ("muni_crosswalk", "code_ibge", "nome", None))


def _repaired(spark, sf_dir):
    names = None
    for tab, key, name, delivery in NAME_FIELDS:
        of = F.lit(None).cast("string") if delivery is None else F.col(delivery).cast("string")
        rows = table(spark, sf_dir, tab).select(F.lit(tab).alias("tab_name"), F.col(key).cast("string").alias("rec_key"), F.col(name).alias("name"), of.alias("delivery"))
        names = rows if names is None else names.unionByName(rows)
    return encoding.repair(names, "tab_name", "rec_key", "name", "delivery")


def p3_found(spark, sf_dir):
    return _repaired(spark, sf_dir).select(F.col("place").alias("tab_name"), "rec_key")


def p3_repaired(spark, sf_dir):
    """The affected records with the original name where it can be had."""
    return _repaired(spark, sf_dir).select(F.col("place").alias("tab_name"), "rec_key", F.col("text").alias("garbled"), "restored", "chain", F.round("posterior", 4).alias("posterior"))


def p3_report(spark, sf_dir):
    return _repaired(spark, sf_dir).groupBy(F.col("place").alias("tab_name"), "chain").agg(F.count(F.lit(1)).alias("n_records"), F.count("restored").alias("n_restored"))


def p6_ids(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.load_vocabulary(TOKENIZER), keep=["doc_id"])


def p6_token_counts(spark, sf_dir):
    """Tokens and characters by language, the figures that a budget of tokens is planned with."""
    counted = bpe.encode(table(spark, sf_dir, "documents"), bpe.load_vocabulary(TOKENIZER), keep=["lang", "n_chars"], count_only=True)
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


def _sizes(spark, sf_dir):
    counted = bpe.encode(table(spark, sf_dir, "documents"), bpe.load_vocabulary(TOKENIZER), keep=["doc_id", "source"], count_only=True)
    return cut_lineage(counted.withColumnRenamed("doc_id", "id"))


def p7_mixture(spark, sf_dir):
    out = mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return out.withColumnRenamed("id", "doc_id")


def p7_shares(spark, sf_dir):
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(sizes, targets, mixing.mix(sizes, targets))


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return residue.find(docs, residue.fit(docs), keep=["doc_id", "source"])


def p8_found(spark, sf_dir):
    return _judged(spark, sf_dir).filter(F.size("residue") > 0).select("doc_id")


def p8_clean(spark, sf_dir):
    """The documents that stay."""
    return _judged(spark, sf_dir).filter(F.size("residue") == 0).select("doc_id")


def p8_report(spark, sf_dir):
    """Documents with residue by source and kind, and the mean share of their text that it covers."""
    hit = _judged(spark, sf_dir).filter(F.size("residue") > 0)
    return hit.groupBy("source", F.array_join("residue", "+").alias("kind")).agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("residue_share"), 4).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p3_found, p3_repaired, p3_report, p6_ids, p6_token_counts, p7_mixture, p7_shares, p8_found, p8_clean, p8_report)}
ORACLES: dict[str, str] = {}
