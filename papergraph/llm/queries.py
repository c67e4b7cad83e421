"""The registered queries opN_<name> of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papergraph.llm.chat import format_turns, read_back
from papergraph.llm.common import table
from papergraph.llm.decontaminate import contaminated
from papergraph.llm.html_text import extract_text
from papergraph.llm.langid import fit_languages, identify_languages
from papergraph.llm.lexical import RANKED_SEARCH_SQL, ranked_search
from papergraph.llm.mixing import mix_sources
from papergraph.llm.ngram_join import NGRAM_COMPONENTS_SQL, ngram_components
from papergraph.llm.quality import fit_quality, score_quality
from papergraph.llm.repeats import remove_repeats
from papergraph.llm.rules import RULES_SQL, judge
from papergraph.llm.sharding import BYTE_SHARDS_SQL, byte_shards
from papergraph.llm.topk import TOP_K_SQL, exact_top_k
from papergraph.llm.whitening import whiten


def remainder(n: int):
    """crc32 of the id as text, mod n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def op1_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), max_epochs=None, evenness=0.5)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_position", "mix_weight", "mix_budget", "mix_tokens")


def op2_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(own)))


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op6_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(4) == 2)
    model = fit_quality(docs.where("NOT held_out"), table(spark, sf_dir, "labels").where(remainder(4) != 2))
    return score_quality(docs, model, keep=["doc_id", "held_out"])


def op9_sharding(spark, sf_dir):
    return byte_shards(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(3) == 1)
    model = fit_languages(docs.where("NOT held_out"), "text", "lang", "doc_id")
    return identify_languages(docs, model, keep=["doc_id", "held_out"]).drop("rejected")


def op11_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op12_lexical_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_html": op5_html,
    "op6_repeats": op6_repeats,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op2_ngram_join": NGRAM_COMPONENTS_SQL,
    "op7_exact_top_k": TOP_K_SQL,
    "op9_sharding": BYTE_SHARDS_SQL,
    "op11_quality_rules": RULES_SQL,
    "op12_lexical_search": RANKED_SEARCH_SQL,
}
