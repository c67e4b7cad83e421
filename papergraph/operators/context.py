"""Evidence for questions and gaps, prompt tables, and tables of parsed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.functions.text import confidence_score
from papergraph.operators.retrieval import gram_index, keyword_retrieval, lowered_text

# The sections of a response, in order, with the columns that they fill.
SECTIONS = {"hypothesis": "HYPOTHESIS", "rationale": "BIOLOGICAL RATIONALE", "supporting_evidence": "SUPPORTING EVIDENCE", "suggested_experiment": "SUGGESTED EXPERIMENT", "confidence": "CONFIDENCE", "novelty": "NOVELTY"}


def record_context(hits: DataFrame, records: DataFrame, chars: int = 400) -> DataFrame:
    """question_id and context: the records of the hits (question_id, rank, doc_id) as text, in their order."""
    line = F.concat(F.lit("PMID:"), F.col("doc_id").cast("string"), F.lit(" | "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, chars), F.lit("…"))
    rows = hits.join(records.select("doc_id", "title", "abstract"), "doc_id").select("question_id", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n\n").alias("context"))


def grounded_prompts(questions: DataFrame, context: DataFrame, history: DataFrame) -> DataFrame:
    """question_id and prompt: instruction, records, the conversation so far (history: conv_id, history) and the question.

    questions: question_id, conv_id, question. Without records the context says so.
    """
    rows = questions.join(context, "question_id", "left").join(history, "conv_id", "left")
    past = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("CONVERSATION HISTORY:\n"), "history", F.lit("\n\n"))).otherwise("")
    prompt = F.concat(F.lit("Answer from the records below alone and cite their ids.\n\nRETRIEVED PAPERS:\n"), F.coalesce("context", F.lit("No papers retrieved.")), F.lit("\n\n"), past, F.lit("USER QUESTION: "), "question")
    return rows.select("question_id", prompt.alias("prompt"))


def evidence_context(gaps: DataFrame, records: DataFrame, k: int = 5, chars: int = 300) -> DataFrame:
    """gap_id and context of gaps (gap_id, concept_a, concept_b, evidence) from records (ord, doc_id, title, abstract).

    Records come in three tiers, by ord in each: the gap's evidence (k at most), then k matches of a word of concept A,
    then of concept B. A record that an earlier tier has counts in the k of its own, but is not said again.
    """
    rows = records.select("ord", "doc_id", "title", "abstract")
    index = gram_index(records.select("ord", lowered_text().alias("text")))
    known = gaps.select("gap_id", F.explode("evidence").alias("doc_id")).distinct().join(rows.select("doc_id", "ord"), "doc_id").select("gap_id", F.lit(0).alias("tier"), "ord", "doc_id")
    for tier, concept in enumerate(("concept_a", "concept_b"), 1):
        asked = gaps.where(F.col(concept) != "").select(F.col("gap_id").alias("question_id"), F.col(concept).alias("question"))
        found = keyword_retrieval(asked, rows, k, 3, None, index).join(rows.select("doc_id", "ord"), "doc_id")
        known = known.unionByName(found.select(F.col("question_id").alias("gap_id"), F.lit(tier).alias("tier"), "ord", "doc_id"))
    first = Window.partitionBy("gap_id", "tier").orderBy("ord")
    once = Window.partitionBy("gap_id", "doc_id").orderBy("tier")
    picked = known.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).withColumn("again", F.row_number().over(once)).where("again = 1")
    label = F.element_at(F.array(F.lit("gap evidence"), F.lit("concept A"), F.lit("concept B")), F.col("tier") + 1)
    snippet = F.trim(F.replace(F.substring(F.coalesce("abstract", F.lit("")), 1, chars), F.lit("\n"), F.lit(" ")))
    part = F.concat(F.lit("[PMID:"), F.col("doc_id").cast("string"), F.lit(" | "), label, F.lit("]\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nEvidence: "), snippet, F.lit("…"))
    said = picked.join(rows.select("doc_id", "title", "abstract"), "doc_id").select("gap_id", F.struct("tier", "ord", part.alias("part")).alias("x"))
    said = said.groupBy("gap_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["part"], "\n\n").alias("context"))  # 3 k parts at most
    none = F.concat(F.lit("No direct evidence found for '"), F.coalesce("concept_a", F.lit("")), F.lit("' / '"), F.coalesce("concept_b", F.lit("")), F.lit("'."))
    return gaps.join(said, "gap_id", "left").select("gap_id", F.coalesce("context", none).alias("context"))


def gap_prompts(gaps: DataFrame, context: DataFrame, chars: int = 3000) -> DataFrame:
    """gap_id and prompt: what is asked of a gap, its context cut to so many characters, and the sections of the answer."""
    sections = "\n".join(f"{i}. {title}" for i, title in enumerate(SECTIONS.values(), 1))
    prompt = F.concat(F.lit("State a research hypothesis on \""), "concept_a", F.lit("\" and \""), "concept_b", F.lit("\".\n\nEVIDENCE:\n"), F.substring("context", 1, chars), F.lit(f"\n\nAnswer in these sections:\n{sections}"))
    return gaps.join(context, "gap_id").select("gap_id", prompt.alias("prompt"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """gap_id, the six sections, and cited (ids) of responses (gap_id, response) with numbered sections.

    Confidence is High, Medium (also for `moderate`) or Low. Rows without a hypothesis are left out. Ids are cited as
    PMID and five to eight digits in the supporting evidence; each comes once.
    """
    def section(i, title):
        end = rf"(?={i + 1}\.|\z)" if i < len(SECTIONS) else r"\z"
        return F.regexp_replace(F.regexp_extract("response", rf"(?isU){i}\.\s*{title}[:\s]+(.*?){end}", 1), r"(?U)^\s+|\s+$", "")

    rows = responses.select("gap_id", *[section(i, title).alias(c) for i, (c, title) in enumerate(SECTIONS.items(), 1)]).where("hypothesis <> ''")
    low = F.lower("confidence")
    word = F.when(low.contains("high"), "High").when(low.contains("medium") | low.contains("moderate"), "Medium").otherwise("Low")
    cited = F.array_distinct(F.regexp_extract_all("supporting_evidence", F.lit(r"(?i)PMID[:\s]*(\d{5,8})"), F.lit(1)))
    return rows.withColumn("confidence", word).withColumn("cited", cited)


def hypotheses(gaps: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of parsed responses with their gap's concepts, confidence as a score, and the cited ids, in order, with the evidence that is not among them, best first."""
    rows = gaps.select("gap_id", "concept_a", "concept_b", F.col("evidence").cast("array<string>").alias("known")).join(parsed, "gap_id")
    union = F.array_union("cited", F.coalesce("known", F.array().cast("array<string>")))
    sections = [c for c in SECTIONS if c != "confidence"]
    return rows.select("gap_id", "concept_a", "concept_b", *sections, confidence_score("confidence").alias("confidence_score"), union.alias("evidence")).orderBy(F.desc("confidence_score"), "gap_id")


def without_cached(gaps: DataFrame, cached: DataFrame) -> DataFrame:
    """Gaps for which no cached row has the same concepts, whatever their case."""
    known = cached.select(F.lower("concept_a").alias("_a"), F.lower("concept_b").alias("_b")).distinct()
    return gaps.join(known, (F.lower("concept_a") == F.col("_a")) & (F.lower("concept_b") == F.col("_b")), "left_anti")
