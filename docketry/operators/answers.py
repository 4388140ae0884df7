"""What a model is told and what a reader is shown: source blocks, message lists, source cards.

Sources of a question come ranked (at most a pool of them), so the pieces of one prompt are a bounded group; the texts themselves are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words around sources, warnings and questions, by language; turns of history; parts of a question; bands of a score; kinds that are always strong.
CONTEXT = {"sq": "KONTEKSTI LIGJOR (përdor vetëm këtë):", "en": "LEGAL CONTEXT (use only this):"}
QUESTION = {"sq": "PYETJA", "en": "QUESTION"}
LAST_LINE = {"sq": "Përgjigju në shqip duke ndjekur rregullat e mësipërme.", "en": "Answer in English while following the rules above."}
NO_SOURCE = "(Asnjë burim i marrë.)"
PRIMARY, SUPPORT, PLAIN = "BURIMI KRYESOR (përgjigjja duhet të bazohet kryesisht mbi këtë)", "BURIMI MBËSHTETËS", "BURIMI"
WARNINGS = "PARALAJMËRIME PËR SHFUQIZIM:"
HISTORY, PARTS = 6, 6
BANDS = ((0.5, "strong"), (0.3, "moderate"), (0.18, "topical"))
CERTAIN_KINDS = ("status_verdict", "abolisher", "abolished")

_EDGES = r"^\s+|\s+$"


def _in_order(order: str, piece: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"]), between)


def citation_key(law: Column, article: Column) -> Column:
    law = F.coalesce(F.nullif(law, F.lit("")), F.lit("?"))
    return F.when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("[Neni "), article, F.lit(", Ligji "), law, F.lit("]"))).otherwise(F.concat(F.lit("[Ligji "), law, F.lit("]")))


def source_blocks(sources: DataFrame, primary: DataFrame | None = None, by: str = "qid") -> DataFrame:
    """by, blocks: each source (by, rank, id, law, article, title, content) as a labelled block, in order of rank. primary(by, id) names a
    question's primary source; where that is among the sources, it and the others are labelled so."""
    rows = sources.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
    if primary is not None:
        first = rows.join(primary.select(by, F.col("id").alias("main")), by).where("id = main").groupBy(by).agg(F.min("n").alias("main"))
        rows = rows.join(first, by, "left")
    else:
        rows = rows.withColumn("main", F.lit(None).cast("int"))
    head = F.concat(citation_key(F.col("law"), F.col("article")), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" — "), "title")).otherwise(""))
    label = F.when(F.col("n") == F.col("main"), F.lit(PRIMARY)).when(F.col("main").isNotNull(), F.concat(F.lit(SUPPORT + " "), "n")).otherwise(F.concat(F.lit(PLAIN + " "), "n"))
    block = F.concat(F.lit("--- "), label, F.lit(": "), head, F.lit(" ---\n"), F.regexp_replace(F.coalesce("content", F.lit("")), _EDGES, ""))
    return rows.groupBy(by).agg(_in_order("n", block, "\n\n").alias("blocks"))


def user_message(questions: DataFrame, blocks: DataFrame, warnings: DataFrame | None = None, by: str = "qid") -> DataFrame:
    """by, content: context, warnings (by, pos, warning; in order) and question(by, question, language) as one message."""
    rows = questions.join(blocks, by, "left")
    if warnings is not None:
        told = warnings.groupBy(by).agg(_in_order("pos", F.concat(F.lit("- "), "warning"), "\n").alias("told"))
        rows = rows.join(told, by, "left")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("string"))
    word = lambda words: F.when(F.col("language") == "en", words["en"]).otherwise(words["sq"])
    context = F.concat(F.coalesce("blocks", F.lit(NO_SOURCE)), F.coalesce(F.concat(F.lit(f"\n\n{WARNINGS}\n"), "told"), F.lit("")))
    return rows.select(by, F.concat(word(CONTEXT), F.lit("\n\n"), context, F.lit("\n\n"), word(QUESTION), F.lit(": "), "question", F.lit("\n\n"), word(LAST_LINE)).alias("content"))


def history(turns: DataFrame, by: str = "qid", most: int = HISTORY) -> DataFrame:
    """by, at, role, content: the last turns (by, turn, role, content) of each, whole, numbered from 1."""
    latest = Window.partitionBy(by).orderBy(F.desc("turn"), F.desc("role"), F.desc("content"))
    kept = turns.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= most)
    return kept.select(by, F.row_number().over(Window.partitionBy(by).orderBy(F.desc("back"))).alias("at"), "role", "content")


def messages(system: str, turns: DataFrame, user: DataFrame, by: str = "qid") -> DataFrame:
    """by, at, role, content: the rules, the history, and the question with its context, in order."""
    past = history(turns, by).join(user.select(by), by, "left_semi")
    first = user.select(by, F.lit(0).alias("at"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    last = user.select(by, F.lit(HISTORY + 1).alias("at"), F.lit("user").alias("role"), "content")
    return first.unionByName(past).unionByName(last)


def band(score: Column, kind: Column) -> Column:
    out = F.when(kind.isin(*CERTAIN_KINDS), "strong")
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("weak")


def source_cards(sources: DataFrame, registry: DataFrame, catalog: DataFrame, cited: DataFrame | None = None, primary: DataFrame | None = None, by: str = "qid") -> DataFrame:
    """A card a source (by, id, law, title, kind, score, rerank; whatever else it has stays): band of the rerank score (else of the
    score), primary, cited, what abolished its law and how, and what the catalogue says. registry has relations (abolished, abolishing,
    relation full or not), catalog a row a law (law, law_title, published, url); cited and primary have (by, id)."""
    status = registry.groupBy(F.col("abolished").alias("law")).agg(F.array_join(F.array_sort(F.collect_set("abolishing")), ",").alias("abolished_by"), F.when(F.bool_or(F.col("relation") == "full"), "fully").otherwise("partially").alias("abolishment_type"))
    rows = sources.join(status, "law", "left").join(catalog, "law", "left")
    for name, of in (("is_cited", cited), ("is_primary", primary)):
        if of is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            rows = rows.join(of.select(by, "id").distinct().withColumn(name, F.lit(True)), [by, "id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    score = F.coalesce("score", F.lit(0.0))
    return rows.withColumns({"law": F.coalesce(F.nullif("law", F.lit("")), F.lit("?")), "score": score, "band": band(F.coalesce("rerank", score), F.coalesce("kind", F.lit("article"))), "is_abolished": F.col("abolished_by").isNotNull(), "abolished_by": F.coalesce("abolished_by", F.lit(""))})


def clarify_message(query: Column, language: Column, all_below: Column, parts: Column) -> Column:
    """What is asked of the model that asks back: the language, the parts of a long question of which none was found, the whole question."""
    lines = F.transform(F.slice(parts, 1, PARTS), lambda p, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), p))
    told = F.when(all_below & (F.size(parts) > 0), F.concat(F.array(F.lit("The query is long and was analyzed in these parts (none matched Kosovo legislation):")), lines)).otherwise(F.array().cast("array<string>"))
    first = F.concat(F.lit("Reply language: "), F.when(language == "en", "English").otherwise("Albanian"), F.lit("."))
    return F.array_join(F.concat(F.array(first), told, F.array(F.concat(F.lit("User query:\n"), F.regexp_replace(query, _EDGES, "")))), "\n")
