"""The queries on text over their whole tables."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.encoding import find_garbled, restoration
from factloom.llm.lookalikes import composed, look_form, names_that_look
from factloom.llm.packing import pack
from factloom.llm.residue import find_residue, judged
from factloom.llm.tokens import decoded, encode_corpus, token_count
from factloom.session import scratch, table

#: So many capacities are packed in one pass over the sizes; more of them take more passes.
CAPACITIES = 256


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns table_name, row_id, pos, text: each element of the two affected fields."""
    evidence, research = table(spark, sf_dir, "hbo_production_evidence"), table(spark, sf_dir, "wbd_hbo_max_web_research")
    return evidence.select(
        F.lit("hbo_production_evidence").alias("table_name"), "row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "text")
    ).unionByName(
        research.select(F.lit("wbd_hbo_max_web_research").alias("table_name"), "row_id", F.lit(0).alias("pos"), F.col("contentType").alias("text"))
    )


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected elements with the chain that garbled them and their original text, null where it is lost."""
    return find_garbled(spark, _snippets(spark, sf_dir), "text", ["table_name", "row_id", "pos"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("table_name", "row_id", "pos")


def p1_restoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many corruptions of clean held-out elements are found, and come back sign by sign, by kind of evidence."""
    return restoration(spark, _snippets(spark, sf_dir).select("text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns key, name: all names of each series."""
    sources, metadata = table(spark, sf_dir, "sources"), table(spark, sf_dir, "series_metadata")
    return (
        sources.select(F.col("tmdbId").alias("key"), F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
        .unionByName(metadata.select(F.col("tmdbId").alias("key"), F.explode(F.array("title", "originalTitle")).alias("name")))
    )


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns table_name, row_id, pos, key, text: each place where a series is named."""
    official = table(spark, sf_dir, "official_series_data")
    cases = table(spark, sf_dir, "hbo_max_qualification_cases")
    evidence = table(spark, sf_dir, "hbo_production_evidence")
    key = F.col("tmdbId").alias("key")
    one = (F.lit(0).alias("pos"), key)
    return (
        official.select(F.lit("official_series_data").alias("table_name"), "row_id", *one, F.col("title").alias("text"))
        .unionByName(cases.select(F.lit("hbo_max_qualification_cases").alias("table_name"), "row_id", key, F.posexplode("aliases").alias("pos", "text")))
        .unionByName(evidence.select(F.lit("hbo_production_evidence").alias("table_name"), "row_id", *one, F.col("requestedTitle").alias("text")))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names_that_look(spark, _titles(spark, sf_dir), _names(spark, sf_dir))
    return found.select("table_name", "row_id", "pos")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title in its one form with what it looks like, for comparisons, and what was wrong; those without tmdbId too."""
    looked = _titles(spark, sf_dir).withColumn("look", look_form(spark, F.col("text")))
    return looked.select("table_name", "row_id", "pos", "key", "text", "look.form", F.col("look.key").alias("look_key"), "look.confusion")


def p3_names_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names, clean by definition, whose form isn't their composed form; there should be none."""
    names = _names(spark, sf_dir).where("name is not null").distinct().withColumn("look", look_form(spark, F.col("name")))
    return names.where(~F.col("look.form").eqNullSafe(composed(F.col("name")))).select("key", "name", "look.form")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids don't decode to their text again; there should be none."""
    ids = encode_corpus(table(spark, sf_dir, "documents").withColumn("kept", F.struct("doc_id", "text")), "kept", "text")
    return ids.select("kept.doc_id", "kept.text", decoded(F.col("ids")).alias("back")).where(
        "back != coalesce(text, '')"
    ).select("doc_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text != ''").select("doc_id", token_count(F.col("text")).alias("tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each text in its container, for every capacity; capacities are taken ``CAPACITIES`` at a time."""
    settings = table(spark, sf_dir, "pack_capacities").orderBy("capacity_id").toLocalIterator()
    packed = None
    while packed is None or some:
        some = {r["capacity_id"]: r["capacity_tokens"] for r in islice(settings, CAPACITIES)}
        if some or packed is None:
            part = pack(spark, _sizes(spark, sf_dir), some, scratch(spark, "p7"))
            packed = part if packed is None else packed.unionByName(part)
    return packed.select(
        "capacity_id", F.col("container").alias("container_id"), F.col("id").alias("doc_id"), "piece",
        F.col("start").alias("start_token"), F.col("size").alias("n_tokens"),
    )


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each capacity and the share of them that is used, in percent."""
    full = p7_containers(spark, sf_dir).groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    by = full.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return by.join(table(spark, sf_dir, "pack_capacities"), "capacity_id").select(
        "capacity_id", "containers", "tokens", F.bround(100 * F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 2).alias("fill_pct")
    )


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overfull containers, texts split though they fit, and texts not packed whole; there should be none."""
    packed, capacities = p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_capacities")
    overfull = (
        packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(capacities, "capacity_id")
        .where("n > capacity_tokens").select("capacity_id", F.lit("overfull").alias("fault"), F.col("container_id").alias("what"))
    )
    texts = packed.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(capacities, "capacity_id")
    split = texts.where("pieces > 1 and n <= capacity_tokens").select("capacity_id", F.lit("split").alias("fault"), F.col("doc_id").cast("string").alias("what"))
    wanted = _sizes(spark, sf_dir).select("doc_id", F.col("tokens").alias("n"), F.lit(1).alias("side"))
    lost = (
        capacities.select("capacity_id", F.lit(1).alias("side")).join(wanted, "side").drop("side")
        .join(texts.select("capacity_id", "doc_id", "n"), ["capacity_id", "doc_id", "n"], "left_anti")
        .select("capacity_id", F.lit("not whole").alias("fault"), F.col("doc_id").cast("string").alias("what"))
    )
    return overfull.unionByName(split).unionByName(lost)


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the kind of residue: slot, filler or message."""
    return find_residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_residue(spark, sf_dir).select("doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue, null and empty ones included."""
    told = judged(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "n_chars"], "text")
    return told.where("residue is null").drop("residue")


def p8_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are kept and found, or neither; there should be none."""
    sides = p8_kept(spark, sf_dir).select("doc_id", F.lit(1).alias("n")).unionByName(p8_found(spark, sf_dir).select("doc_id", F.lit(1).alias("n")))
    counted = sides.unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("n"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return counted.where("n != 0").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p3_found": p3_found, "p3_forms": p3_forms, "p3_names_changed": p3_names_changed, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_faults": p7_faults, "p8_found": p8_found, "p8_residue": p8_residue, "p8_kept": p8_kept, "p8_unassigned": p8_unassigned, "p1_restoration": p1_restoration}

#: What SQL can say of these: results that must be empty.
ORACLES = {
    "p3_names_changed": "SELECT tmdbId AS key, title AS name, title AS form FROM series_metadata WHERE false",
    "p6_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p7_faults": "SELECT capacity_id, '' AS fault, '' AS what FROM pack_capacities WHERE false",
    "p8_unassigned": "SELECT doc_id FROM documents WHERE false",
}
