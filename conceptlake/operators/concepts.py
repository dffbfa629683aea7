"""Rule concepts: phrases, plural forms, validity, weights, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, general and those that a domain adds.
STOPWORDS = """
the and a an in on at to for with by about like through over before after between under during without of is are was were be
been being have has had do does did can could will would shall should may might must part this that these those it they them
their he she him her his hers its theirs we us our ours you your yours i me my mine
""".split()
DOMAIN_STOPWORDS = {
    "tech": """
use using used user users system systems data information process processes method methods function functions value values
example examples result results figure figures table tables section sections chapter chapters page pages see shown show shows
showing note notes describe describes described describing description represent represents represented representing representation
""".split(),
    "academic": """
paper papers study studies research researcher researchers analysis analyze analyzed analyzing experiment experiments experimental
theory theories theoretical hypothesis hypotheses method methods methodology methodologies approach approaches framework frameworks
model models modeling modelling simulation simulations algorithm algorithms implementation implementations evaluation evaluations
evaluate evaluated evaluating performance performances result results conclusion conclusions future work
""".split(),
}
# Patterns of technical terms (without the word boundaries around each) and those that a domain adds. The group is the term.
PATTERNS = [
    r"[A-Z][a-z]+ (Learning|Network|Model|Algorithm|System|Framework|Technique|Approach)",
    r"(Deep|Machine|Reinforcement|Supervised|Unsupervised|Self-supervised|Federated) Learning",
    r"(Artificial Intelligence|AI|Machine Learning|ML|Deep Learning|DL)",
    r"(Neural Network(?:s)?|NN)",
    r"(Decision Tree(?:s)?|Random Forest(?:s)?|Support Vector Machine(?:s)?|SVM|Gradient Boosting)",
    r"(Natural Language Processing|NLP|Computer Vision|CV)",
    r"(Large Language Model(?:s)?|LLM(?:s)?|Generative AI|GenAI)",
    r"(Transformer(?: Model)?|Attention Mechanism|Self-Attention)",
    r"(Embedding(?:s)?|Tokenization|Vector Database(?:s)?)",
    r"(Industry 4\.0|Industry 5\.0|Internet of Things|IoT)",
    r"(Big Data|Data Mining|Data Science|Data Analysis)",
    r"(Cloud Computing|Edge Computing|Fog Computing)",
    r"(Blockchain|Cryptocurrency|Smart Contract(?:s)?)",
    r"(Quantum Computing|Quantum Supremacy)",
    r"(Cybersecurity|Network Security|Information Security)",
    r"(Virtual Reality|VR|Augmented Reality|AR|Mixed Reality|MR)",
    r"(Robotic Process Automation|RPA)",
    r"(TensorFlow|PyTorch|Keras|Scikit-learn)",
    r"(Apache Spark|Apache Hadoop)",
    r"(Docker|Kubernetes)",
]
DOMAIN_PATTERNS = {
    "academic": [r"(Literature Review|Systematic Review)", r"(Case Study|Empirical Study)", r"(Statistical Analysis|Hypothesis Testing)"],
    "finance": [r"(Algorithmic Trading|High-Frequency Trading)", r"(Risk Management|Credit Scoring)", r"(FinTech|Regulatory Technology|RegTech)"],
}
# Plurals in -ses and words in -es that those rules leave alone.
KEPT_SES = "analyses bases crises diagnoses ellipses hypotheses oases paralyses parentheses synopses syntheses theses series species".split()
KEPT_ES = "series species clothes mathematics physics news goes does".split()

#: Boundaries of words of letters, digits and underscores of any script, spelled out: \b differs by engine and version.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Java's repeated groups recurse, once a word, and a run of some thousand words overflows the stack, which ends the executor;
# possessive ones loop. A word that goes on in another script ends the run before it, as AFTER would by going back.
CAPITALISED = rf"([A-Z][a-zA-Z]*+(?:\s++[A-Z][a-zA-Z]*+{AFTER})++)"
HYPHENATED = rf"([a-zA-Z0-9]++(?:-[a-zA-Z0-9]++{AFTER})++)"
ACRONYM = r"([A-Z]{2,})"
RUN = r"([a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z][a-zA-Z0-9]*){0,3})"


def stopwords(domain: str = "general") -> list[str]:
    return list(dict.fromkeys(STOPWORDS + DOMAIN_STOPWORDS.get(domain, [])))


def _all(text: Column, pattern: str, any_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?i)" if any_case else "") + BEFORE + pattern + AFTER), F.lit(1))


def singular(phrase: Column) -> Column:
    """Ordered suffix rules on the last word; a word that no rule meets, or a rule would leave too short, stays."""
    w = F.element_at(F.split(phrase, " "), -1)
    cut = lambda n: F.left(w, F.length(w) - n)
    low, size = F.lower(w), F.length(w)
    y = F.when(F.substring(w, -3, 1) == "I", "Y").otherwise("y")
    plain = low.endswith("s") & ~low.endswith("ss") & ~low.endswith("us") & ~w.contains("'") & (size > 2)
    out = (
        F.when(size < 3, w)
        .when(low.rlike("[^aeiou]ies$"), F.concat(cut(3), y))
        .when(low.endswith("sses"), cut(2))
        .when(low.endswith("ses") & ~low.isin(KEPT_SES), cut(1))
        .when(low.rlike("(x|sh|ch|o)es$") & ~low.isin(KEPT_ES) & (size > 3), cut(2))
        .when(plain, cut(1))
        .otherwise(w)
    )
    return F.concat(F.left(phrase, F.length(phrase) - size), out)


def is_valid(concept: Column, least: int = 2, most: int = 5, domain: str = "general", stop: list[str] | None = None) -> Column:
    """Number of words, no stop word, no number, 3 characters, letters or digits at both ends, few odd characters."""
    stopped = stopwords(domain) if stop is None else stop

    def checked(words: Column) -> Column:
        odd = concept.rlike(r"[^\p{L}\p{N} '-]") & (F.length(F.regexp_replace(concept, r"[\p{L}\p{N} '-]", "")) > F.size(words) - 1)
        return F.size(words).between(least, most) & ~F.exists(words, lambda w: F.lower(w).isin(stopped)) & ~odd

    shape = (F.length(concept) >= 3) & concept.rlike(r"(?s)^[\p{L}\p{N}].*[\p{L}\p{N}]$") & ~concept.rlike(r"^\p{N}+$")
    return F.transform(F.array(F.split(F.trim(concept), r"\s+")), checked)[0] & shape


def acronyms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, ACRONYM)))


def hyphen_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, HYPHENATED)))


def phrases(text: Column, domain: str = "general") -> Column:
    """Terms of the patterns, capitalised runs, hyphenated terms, acronyms and runs of up to four words.

    The patterns are tried one by one only on texts that one of them is in.
    """
    patterns = PATTERNS + DOMAIN_PATTERNS.get(domain, [])
    named = F.concat(*(_all(text, p, True) for p in patterns))
    some = text.rlike("(?i)" + BEFORE + "(?:" + "|".join(patterns) + ")" + AFTER)
    found = F.when(some, named).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, *(_all(text, p) for p in (CAPITALISED, HYPHENATED, ACRONYM, RUN))))


def rule_concepts(docs: DataFrame, domain: str = "general", most: int | None = 20) -> DataFrame:
    """doc_id, concepts: valid phrases in lower case and singular (else as they stand), sorted; the first ``most``, or all.

    A null text has none. Each step is a column of its own, so that no expression is evaluated twice a phrase.
    """
    rows = docs.select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("x"))
    rows = rows.select("doc_id", phrases(F.col("x"), domain).alias("p"))
    rows = rows.select("doc_id", F.transform("p", lambda p: F.struct(p.alias("whole"), singular(p).alias("one"))).alias("p"))
    valid = lambda x: is_valid(x, domain=domain)
    kept = F.transform("p", lambda p: F.when(valid(p["one"]), F.lower(p["one"])).when(valid(p["whole"]), F.lower(p["whole"])))
    concepts = F.array_sort(F.array_distinct(F.array_compact(kept)))
    return rows.select("doc_id", (F.slice(concepts, 1, most) if most else concepts).alias("concepts"))


def weight(text: Column, concept: Column) -> Column:
    """0.5, more for repetition, 0.1 more for an early or absent first place; at most 1."""
    low, c = F.lower(text), F.lower(concept)
    freq = (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / F.length(c)
    w = F.when(freq > 1, F.least(F.lit(1.0), 0.5 + 0.05 * freq)).otherwise(0.5)
    at = F.position(c, low) - 1
    return F.least(F.lit(1.0), w + F.when(at < F.length(text) * 0.2, 0.1).otherwise(0.0))


def merge_chunks(concepts: DataFrame) -> DataFrame:
    """(doc_id, chunk, name, type, description, related) to one row a name: first name and type, descriptions that add something, related and chunks united."""
    rows = concepts.groupBy("doc_id", F.lower("name").alias("key")).agg(F.array_sort(F.collect_list(F.struct("chunk", "name", "type", "description"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("related_concepts"), F.sort_array(F.collect_set("chunk")).alias("chunks"))
    text = F.expr("aggregate(r, '', (a, x) -> if(a = '', coalesce(x.description, ''), if(contains(a, coalesce(x.description, '')), a, concat(a, '; ', x.description))))")
    return rows.select("doc_id", F.expr("r[0].name").alias("name"), F.expr("r[0].type").alias("type"), text.alias("description"), "related_concepts", "chunks")


def merge_longest(concepts: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """As merge_chunks, with the longest description, and the relations (doc_id, source, target, type, strength) that go out of each name, if given."""
    out = concepts.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by("name", "chunk").alias("name"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("related_concepts"))
    if relations is None:
        return out.drop("key")
    going = relations.groupBy("doc_id", F.lower("source").alias("key")).agg(F.array_sort(F.collect_set(F.struct("target", "type", "strength"))).alias("relationships"))
    out = out.join(going, ["doc_id", "key"], "left").drop("key")
    return out.withColumn("relationships", F.coalesce("relationships", F.array().cast(going.schema["relationships"].dataType)))
