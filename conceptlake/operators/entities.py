"""Keyword entities, fusion by precedence, pattern and co-occurrence relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptlake.operators import lexicon as L

# Relation types and their phrases, in order of precedence.
PHRASES = {
    "DEFINES_CONCEPT": [" defines ", " is defined as ", " refers to ", " means "],
    "IS_A": [" is a ", " is an ", " is type of ", " is kind of "],
    "HAS_PART": [" has ", " contains ", " includes ", " consists of "],
    "USED_FOR": [" is used for ", " is used to ", " enables ", " allows "],
    "IMPLEMENTS_METHOD": [" implements ", " uses ", " employs ", " utilizes "],
    "HAS_ATTRIBUTE": [" has attribute ", " has property ", " is characterized by "],
    "EXAMPLE_OF": [" is example of ", " illustrates ", " demonstrates "],
    "REQUIRES_INPUT": [" requires ", " needs ", " depends on "],
    "STEP_IN_PROCESS": [" follows ", " precedes ", " comes after ", " comes before "],
    "COMPARES_WITH": [" compared to ", " versus ", " as opposed to ", " in contrast to "],
}
# Keywords and their abbreviations, for all texts and by domain.
COMMON_KEYWORDS = {
    "machine learning": "ML", "neural network": "NN", "deep learning": "DL", "artificial intelligence": "AI", "natural language processing": "NLP",
    "computer vision": "CV", "reinforcement learning": "RL", "supervised learning": "SL", "unsupervised learning": "UL", "transformer": "TR",
    "attention mechanism": "AM", "convolutional neural network": "CNN", "recurrent neural network": "RNN", "long short-term memory": "LSTM",
    "gated recurrent unit": "GRU", "generative adversarial network": "GAN", "transfer learning": "TL", "fine-tuning": "FT", "backpropagation": "BP",
    "gradient descent": "GD", "retrieval-augmented generation": "RAG", "knowledge graph": "KG", "vector database": "VDB",
    "embedding": "EMB", "hybrid search": "HS", "deduplication": "DD", "large language model": "LLM", "neo4j": "NEO", "chromadb": "CHROMA",
}
DOMAIN_KEYWORDS = {
    "AI": {
        "prompt engineering": "PE", "chain of thought": "COT", "few-shot learning": "FSL", "zero-shot learning": "ZSL", "multimodal": "MM",
        "text-to-image": "T2I", "diffusion model": "DM", "stable diffusion": "SD", "dall-e": "DALLE", "midjourney": "MJ", "gpt": "GPT",
        "bert": "BERT", "t5": "T5", "llama": "LLAMA", "claude": "CLAUDE",
    },
    "Programming": {
        "python": "PY", "javascript": "JS", "typescript": "TS", "java": "JAVA", "c++": "CPP", "rust": "RUST", "go": "GO", "docker": "DOCKER",
        "kubernetes": "K8S", "microservices": "MS", "api": "API", "rest": "REST", "graphql": "GQL", "database": "DB", "sql": "SQL",
        "nosql": "NOSQL", "git": "GIT", "ci/cd": "CICD", "devops": "DEVOPS",
    },
}
# Terms of prompt engineering and their abbreviations.
PROMPT_KEYWORDS = {
    "prompt engineering": "PE", "chain of thought": "COT", "few-shot learning": "FSL", "zero-shot learning": "ZSL", "in-context learning": "ICL",
    "retrieval augmented generation": "RAG", "prompt template": "PT", "system prompt": "SP", "user prompt": "UP", "assistant prompt": "AP",
    "prompt chaining": "PC", "prompt tuning": "PTU", "prompt optimization": "PO", "prompt injection": "PI", "prompt leaking": "PL",
    "prompt hacking": "PH", "jailbreaking": "JB", "role prompting": "RP", "persona prompting": "PP", "instruction prompting": "IP",
    "task-specific prompting": "TSP", "self-consistency": "SC", "tree of thought": "TOT", "reasoning": "RE", "step-by-step": "SBS",
    "fine-tuning": "FT", "parameter efficient fine-tuning": "PEFT", "low-rank adaptation": "LORA", "knowledge graph": "KG",
    "vector database": "VDB", "embedding": "EMB", "token": "TOK", "tokenization": "TKZ", "temperature": "TEMP", "top-p sampling": "TPS",
    "top-k sampling": "TKS", "beam search": "BS", "greedy decoding": "GD", "hallucination": "HAL", "context window": "CW",
    "attention mechanism": "AM", "transformer": "TR", "large language model": "LLM", "generative ai": "GAI",
    "natural language processing": "NLP", "natural language understanding": "NLU", "natural language generation": "NLG",
    "semantic search": "SS", "similarity search": "SIS", "cosine similarity": "CS", "vector embedding": "VE", "text embedding": "TE",
    "document embedding": "DE", "sentence embedding": "SE", "word embedding": "WE", "contextual embedding": "CE",
    "knowledge distillation": "KD", "knowledge extraction": "KE", "knowledge representation": "KR", "knowledge base": "KB", "ontology": "ONT",
    "taxonomy": "TAX", "semantic network": "SN", "semantic web": "SW", "semantic triple": "ST", "entity extraction": "EE",
    "named entity recognition": "NER", "relation extraction": "RE", "information extraction": "IE", "information retrieval": "IR",
    "question answering": "QA", "chatbot": "CB", "conversational ai": "CAI", "dialogue system": "DS", "dialogue management": "DM",
    "dialogue state tracking": "DST", "dialogue policy": "DP", "dialogue generation": "DG", "dialogue understanding": "DU",
    "dialogue context": "DC", "dialogue history": "DH", "dialogue turn": "DT", "dialogue act": "DA", "dialogue intent": "DI",
    "dialogue knowledge": "DK", "dialogue feedback": "DF", "dialogue optimization": "DO", "dialogue learning": "DL", "dialogue domain": "DD",
}
#: Keywords up to which each is sought in the whole text, which is faster then (24 MB of text on one core: 0.05 s a
#: keyword, against 5 to 12 s for any lexicon by ``lexicon.match``).
FEW = 128
#: The least counts: metadata overrides, then model, prompt lexicon, keyword.
PRECEDENCE = {"metadata": 0, "llm": 1, "prompt": 2, "keyword": 3}


def concept_id(name: Column) -> Column:
    """The same id for a name in any document."""
    return F.concat(F.lit("concept-"), F.left(F.sha2(F.lower(F.trim(name)), 256), F.lit(16)))


def keyword_entities(docs: DataFrame, keywords: list[str] | DataFrame, source: str = "keyword", word_boundary: bool = False) -> DataFrame:
    """doc_id, keyword, concept_id, source, pos of each keyword in the lower-case text (substring test, or whole words).

    ``keywords`` is a list or a table with a column ``keyword`` of any size.
    """
    if isinstance(keywords, DataFrame) or word_boundary or len(keywords) > FEW:
        words = keywords if isinstance(keywords, DataFrame) else docs.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
        found = L.match(docs, words.select("keyword").distinct(), word_boundary)
    else:
        low = docs.select("doc_id", F.lower("text").alias("low"))
        found = low.select("doc_id", "low", F.explode(F.array_compact(F.array(*(F.when(F.col("low").contains(k), F.lit(k)) for k in keywords)))).alias("keyword"))
        found = found.select("doc_id", "keyword", F.expr("locate(keyword, low)").alias("pos"))
    return found.select("doc_id", "keyword", concept_id(F.col("keyword")).alias("concept_id"), F.lit(source).alias("source"), "pos")


def lexicon(domain: str | None = None, prompts: bool = False) -> list[tuple[str, str, str, str, str, str]]:
    """keyword, abbreviation, display name, label, domain, source: the keywords for all texts and the domain's, or those of prompt engineering.

    A keyword that is in both tables has the domain's abbreviation.
    """
    if prompts:
        return [(k, a, k.title(), "PromptEngineeringConcept", "prompt", "prompt") for k, a in PROMPT_KEYWORDS.items()]
    return [(k, a, k.title(), "Concept", domain or "common", "keyword") for k, a in (COMMON_KEYWORDS | DOMAIN_KEYWORDS.get(domain, {})).items()]


def lexicon_entities(docs: DataFrame, rows: list[tuple[str, str, str, str, str, str]], word_boundary: bool = False) -> DataFrame:
    """doc_id, keyword, name, abbreviation, label, domain, concept_id, source, pos of each keyword of a lexicon in the text."""
    found = keyword_entities(docs, [k for k, *_ in rows], word_boundary=word_boundary).drop("source")
    about = F.create_map(*[x for k, a, name, label, domain, source in rows for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(a).alias("abbreviation"), F.lit(label).alias("label"), F.lit(domain).alias("domain"), F.lit(source).alias("source")))])
    return found.withColumn("about", about[F.col("keyword")]).select("doc_id", "keyword", "about.*", "concept_id", "pos")


def metadata_entities(docs: DataFrame, column: str = "concepts") -> DataFrame:
    """doc_id, name from a comma-separated column."""
    return docs.select("doc_id", F.explode(F.split(column, ",")).alias("name")).select("doc_id", F.trim("name").alias("name"), F.lit("metadata").alias("source")).where("name <> ''")


def fuse(mentions: list[DataFrame]) -> DataFrame:
    """One entity for each document and lower-case name: that of the source with precedence."""
    rank = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])
    rows = reduce(DataFrame.unionByName, [m.select("doc_id", "name", "source") for m in mentions])
    best = rows.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "source"), F.struct(F.coalesce(rank[F.col("source")], F.lit(9)), F.col("name"))).alias("b"))
    return best.select("doc_id", F.col("b.name").alias("name"), F.col("b.source").alias("source"), concept_id(F.col("b.name")).alias("concept_id"))


def pattern_relations(docs: DataFrame, mentions: DataFrame, strength: float = 0.8) -> DataFrame:
    """doc_id, src, dst, type: ordered pairs of a document's names whose text has "src phrase dst"; the first phrase decides.

    The names come to their text once. One pattern finds the places of all phrases, with as many characters on either side
    as the longest name has; only there are names compared, so the work follows the text's phrases and not its pairs.
    """
    said = [(rank, kind, p) for rank, (kind, p) in enumerate((kind, p) for kind, ps in PHRASES.items() for p in ps)]
    names = mentions.where("length(name) > 0").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    rows = docs.select("doc_id", F.lower("text").alias("low")).join(names, "doc_id")
    rows = rows.select("doc_id", "low", "names", F.array_max(F.transform("names", F.length)).alias("wide"))
    longest = max(len(p) for _, _, p in said)
    any_phrase = "(?= (?:" + "|".join(sorted(p[1:] for _, _, p in said)) + "))"
    # the text begins behind as many signs that no name holds
    padded = F.concat(F.repeat(F.lit("\0"), F.col("wide")), F.col("low"))
    find = lambda i: F.regexp_extract_all(padded, F.concat(F.lit(f"(?s){any_phrase}(?<=(.{{"), "wide", F.lit(f"}}))(?=(.{{1,"), F.col("wide") + longest, F.lit("}))")), F.lit(i))
    rows = rows.select("doc_id", "names", F.arrays_zip(find(1).alias("left"), find(2).alias("right")).alias("hits"))
    rows = rows.select("doc_id", "names", F.explode(F.array_distinct("hits")).alias("hit")).select("doc_id", "names", "hit.*")
    rows = rows.withColumn("src", F.explode(F.filter("names", lambda a: F.endswith("left", F.lower(a)))))
    phrases = F.array(*(F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("type"), F.lit(p).alias("p")) for rank, kind, p in said))
    rows = rows.withColumn("said", F.explode(F.filter(phrases, lambda x: F.startswith("right", x["p"]))))
    rows = rows.withColumn("dst", F.explode(F.filter("names", lambda b: (b != F.col("src")) & F.startswith("right", F.concat(F.col("said.p"), F.lower(b))))))
    first = rows.groupBy("doc_id", "src", "dst").agg(F.min(F.struct("said.rank", "said.type")).alias("said"))
    return first.select("doc_id", "src", "dst", "said.type", F.lit(strength).alias("strength"), F.lit("pattern_based").alias("method"))


def cooccurrence(mentions: DataFrame, group: str = "doc_id", item: str = "name", strength: float = 0.3) -> DataFrame:
    """group, src < dst: pairs that occur together; strength and the basic method."""
    m = mentions.select(group, item).distinct()
    pairs = m.alias("a").join(m.alias("b"), F.expr(f"a.{group} = b.{group} and a.{item} < b.{item}"))
    return pairs.select(f"a.{group}", F.col(f"a.{item}").alias("src"), F.col(f"b.{item}").alias("dst"), F.lit("RELATED_TO").alias("type"), F.lit(strength).alias("strength"), F.lit("basic").alias("method"))


def fuse_relations(strong: DataFrame, fallback: DataFrame) -> DataFrame:
    """Co-occurrence only for documents without other relations; one row for each (src, dst, type) by method, then strength.

    Of equal ones the one with the smallest ``seq`` counts, if both tables have that column (the order of extraction).
    """
    rows = strong.unionByName(fallback.join(strong.select("doc_id").distinct(), "doc_id", "left_anti"))
    rank = F.when(F.col("method") == "llm_based", 3).when(F.col("method") == "pattern_based", 2).otherwise(1)
    order = F.struct(rank, "strength", *([-F.col("seq")] if "seq" in rows.columns else []), "method")
    best = rows.groupBy("doc_id", "src", "dst", "type").agg(F.max_by(F.struct("strength", "method"), order).alias("b"))
    return best.select("doc_id", "src", "dst", "type", "b.strength", "b.method")


def map_relations(relations: DataFrame, entities: DataFrame, strength: float = 0.6) -> DataFrame:
    """Relations by name to ids; unknown names and self loops go, missing strengths are set."""
    ids = entities.select("name", "concept_id").distinct()
    out = relations.join(ids.withColumnsRenamed({"name": "source", "concept_id": "src"}), "source").join(ids.withColumnsRenamed({"name": "target", "concept_id": "dst"}), "target")
    return out.where("src <> dst").withColumn("strength", F.coalesce("strength", F.lit(strength)))


def concepts_per_document(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """documents, concepts, average: documents (those without a concept too), their distinct concepts in all, and a document's on average."""
    found = mentions.select("doc_id", "name").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    per = docs.select("doc_id").join(found, "doc_id", "left")
    return per.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("concepts"), F.avg(F.coalesce("n", F.lit(0))).alias("average"))


def concept_stats(mentions: DataFrame, top: int = 20) -> DataFrame:
    """name, n of the most frequent concepts."""
    return mentions.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
