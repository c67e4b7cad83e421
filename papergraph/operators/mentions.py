"""Entities by typed patterns, their relations inside sentences, and names of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergraph.functions.text import sentences

# Words that look like symbols, patterns with their types in order, type pairs with their relation, names of types.
STOP_WORDS = """A AN AS AT BE BY DO GO IF IN IS IT NO OF ON OR SO TO UP US WE
AND ARE BUT CAN DID FOR HAD HAS HER HIM HIS HOW ITS LET MAY NOT NOW OUR OUT OWN SAY SHE THE TWO USE VIA WAS WHO WHY YET
ALSO BEEN BOTH CAME DOES EACH EVEN FROM GAVE HAVE HERE INTO JUST LIKE MADE MANY MORE MOST MUCH MUST OVER SAME SUCH THAN THAT THEM THEN
THEY THIS THUS UPON USED VERY WERE WITH YEAR AFTER AMONG BEING COULD FOUND GIVEN GROUP HEART HUMAN LEVEL LOWER MAJOR MIGHT NOTED OFTEN OTHER
SHOWN SINCE STUDY THESE THREE TOTAL UNDER USING WEEKS WHICH WHILE YEARS ABOVE ABOUT
USA UK EU UN FDA NIH CDC EPA DNA RNA PCR MRI CT UV IR""".split()
PATTERNS = [
    (r"\b([A-Z]{2,6}\d*)\b", "GENE_OR_GENOME"),
    (r"\b([A-Z]{1,4}\d+[A-Z]?)\b", "GENE_OR_GENOME"),
    (r"(?i)\b((?:IL|TNF|IFN|TGF|VEGF|EGF|FGF|IGF|CSF|HGF|PDGF|NGF|BMP|WNT)[-–][\w]+)\b", "GENE_OR_GENOME"),
    (r"(?i)\b(\w{3,}(?:oma|itis|emia|pathy|osis|plasia|trophy|oma|ectomy|otomy))\b", "DISEASE"),
    (r"\b((?:[A-Z][a-z]+[-\s]){0,2}(?:cancer|carcinoma|sarcoma|lymphoma|leukemia|melanoma|glioma|syndrome|disorder|disease|tumor|tumour))\b", "DISEASE"),
    (r"(?i)\b(\w{4,}(?:mab|nib|zumab|tinib|ciclib|mycin|cillin|cycline|statin|sartan|prazole|vir|ide|ine|ol))\b", "CHEMICAL"),
    (r"(?i)\b(\w{3,}(?:cyte|blast|phage|phil|sphere)s?)\b", "CELL"),
    (r"(?i)\b(apoptosis|autophagy|necrosis|ferroptosis|pyroptosis|angiogenesis|metastasis|proliferation|differentiation|senescence|inflammation|fibrosis|neurodegeneration)\b", "BIOLOGICAL_PROCESS"),
]
RELATIONS = {
    ("GENE_OR_GENOME", "DISEASE"): "associated_with",
    ("DISEASE", "GENE_OR_GENOME"): "associated_with",
    ("GENE_OR_GENOME", "CHEMICAL"): "interacts_with",
    ("CHEMICAL", "GENE_OR_GENOME"): "interacts_with",
    ("CHEMICAL", "DISEASE"): "treats",
    ("DISEASE", "CHEMICAL"): "treated_by",
    ("GENE_OR_GENOME", "BIOLOGICAL_PROCESS"): "regulates",
    ("BIOLOGICAL_PROCESS", "GENE_OR_GENOME"): "regulated_by",
    ("CELL", "DISEASE"): "implicated_in",
    ("GENE_OR_GENOME", "CELL"): "expressed_in",
}
TYPES = {
    "DISEASE": "DISEASE CANCER",
    "GENE_OR_GENOME": "GENE_OR_GENE_PRODUCT GENE_OR_GENOME",
    "CHEMICAL": "SIMPLE_CHEMICAL CHEMICAL DRUG",
    "BIOLOGICAL_PROCESS": "BIOLOGICAL_PROCESS",
    "CELL": "CELL CELL_TYPE CELL_LINE",
    "ORGANISM": "ORGANISM TAXON",
    "LABORATORY_PROCEDURE": "LABORATORY_PROCEDURE PROCEDURE DIAGNOSTIC_PROCEDURE",
}
NEW_PAIRS = 6


def entity_type(label: Column) -> Column:
    """The type that a label stands for; other labels stay."""
    out = label
    for kind, labels in TYPES.items():
        out = F.when(F.upper(label).isin(labels.split()), kind).otherwise(out)
    return out


def extract_entities(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, ord, entity_text, entity_type and sentence: the first mention of each (lower-cased text, type) of a document.

    ord numbers a document's mentions by sentence, pattern and place. Texts of fewer than three characters and stop
    words are left out. Null documents and texts give nothing.
    """
    said = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(sentences(text)).alias("s", "sentence"))

    def matches(p, pattern, kind):
        found = F.regexp_extract_all("sentence", F.lit("(?U)" + pattern), F.lit(1))
        return F.transform(found, lambda m, i: F.struct(F.lit(p).alias("p"), i.alias("i"), F.trim(m).alias("entity_text"), F.lit(kind).alias("entity_type")))

    found = F.flatten(F.array(*[matches(p, pattern, kind) for p, (pattern, kind) in enumerate(PATTERNS)]))
    rows = said.select("doc_id", "s", "sentence", F.explode(found).alias("m")).select("doc_id", "s", "sentence", "m.*")
    rows = rows.where((F.length("entity_text") >= 3) & ~F.upper("entity_text").isin(STOP_WORDS))
    first = Window.partitionBy("doc_id", F.lower("entity_text"), "entity_type").orderBy("s", "p", "i")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    order = Window.partitionBy("doc_id").orderBy("s", "p", "i")
    return rows.select("doc_id", F.row_number().over(order).alias("ord"), "entity_text", "entity_type", "sentence")


def relation_of(source: Column, target: Column) -> Column:
    out = F.lit("co_occurs_with")
    for (a, b), relation in RELATIONS.items():
        out = F.when((source == a) & (target == b), relation).otherwise(out)
    return out


def extract_relations(docs: DataFrame, entities: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, source_entity, target_entity, relationship_type and sentence of pairs of entities that one sentence holds.

    Of a text with several types the last one counts, at the first one's place. An entity is in a sentence if its
    lower-cased text is part of it. Each unordered pair comes once for a document, and a sentence adds at most
    NEW_PAIRS new ones, in order of the entities.
    """
    low = Window.partitionBy("doc_id", F.lower("entity_text"))
    merged = entities.select("doc_id", "entity_text", "entity_type", "ord", F.min("ord").over(low).alias("at"), F.max("ord").over(low).alias("last")).where("ord = last")
    listed = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "entity_text", "entity_type"))).alias("entities"))  # those of one text
    said = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), sentences(text).alias("sentences"))

    def pairs_of(sentence, s):
        present = F.filter("entities", lambda e: F.contains(F.lower(sentence), F.lower(e["entity_text"])))
        return F.flatten(F.transform(present, lambda a, i: F.transform(F.slice(present, i + 2, F.size(present)), lambda b: F.struct(a.alias("a"), b.alias("b"), s.alias("s")))))

    def key(p):
        a, b = F.lower(p["a"]["entity_text"]), F.lower(p["b"]["entity_text"])
        return F.concat(F.least(a, b), F.lit("\u0001"), F.greatest(a, b))

    def add(so_far, pairs):
        new = F.filter(pairs, lambda p: ~F.exists(so_far, lambda o: key(o) == key(p)))
        return F.concat(so_far, F.slice(new, 1, NEW_PAIRS))

    rows = said.join(listed, "doc_id").withColumn("found", F.transform("sentences", pairs_of))
    kind = "array<struct<a:struct<at:int,entity_text:string,entity_type:string>,b:struct<at:int,entity_text:string,entity_type:string>,s:int>>"
    rows = rows.select("doc_id", "sentences", F.explode(F.aggregate("found", F.array().cast(kind), add)).alias("p"))
    return rows.select(
        "doc_id", F.col("p.a.entity_text").alias("source_entity"), F.col("p.b.entity_text").alias("target_entity"),
        relation_of(F.col("p.a.entity_type"), F.col("p.b.entity_type")).alias("relationship_type"), F.get("sentences", F.col("p.s")).alias("sentence"),
    )


def extract_corpus(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of all documents; relations have confidence 0.7."""
    entities = extract_entities(docs, doc, text)
    return entities, extract_relations(docs, entities, doc, text).withColumn("confidence", F.lit(0.7))
