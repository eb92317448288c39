"""From a text's coordinates to ontology terms and links: extraction, context, term and links by one model, step by step over tables.

Every step makes a prompt for each row, asks each distinct prompt once (through the prompt cache, if there is one) and reads the answers into columns, so a
step is a table as any other and the model sees as few prompts as there are. ``tested`` ends the chain as a benchmark does: the first text of a
test in which its coordinate is found tells whether all of the test's links hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import prompt_cache, splitter, vectors
from paperloom.plans.chains import Model, completed
from paperloom.plans.scoring import Embedder, HashEmbedder, embedded
from paperloom.sources import folders

EXTRACT = "List the genomic coordinates of the publication, one a line."
CONTEXT = "Give the sentences of the publication that are about the coordinate."
TERM = "Choose the ontology term that fits the coordinate and its context best, and answer with its JSON only."
LINK = "Is the coordinate, with its context and term, linked to the value of the key? Answer with YES or NO, the kind of relation and the reason, a line each."


class RuleModel:
    """Answers the four prompts by rules: patterns, the lines that hold the coordinate, the nearest term, and whether the context names the value."""

    def complete(self, prompt: str) -> str:
        task, _, rest = prompt.partition("\n")
        if task == EXTRACT:
            return "Coordinates:\n" + "\n".join(f"- {m}" for m in dict.fromkeys(x for p in T.COORDINATES for x in re.findall(p, rest.partition(": ")[2])))
        fields = dict(p.split(": ", 1) for p in rest.split("\x1e") if ": " in p)
        if task == CONTEXT:
            return " ".join(line for line in fields["PUBLICATION"].split("\n") if fields["COORDINATE"] in line)
        if task == TERM:
            return fields["TERMS"].partition("\x1f")[0]
        held = fields["VALUE"].lower() in fields["CONTEXT"].lower()
        return f"{'YES' if held else 'NO'}\nnamed\nthe context {'names' if held else 'does not name'} it"


def _kept(df: DataFrame, label: str) -> DataFrame:
    """The table as written to a shared folder: what a model has said isn't asked again by the steps that follow."""
    path = folders.fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prompt(task: str, **fields: Column | str) -> Column:
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for name, c in fields.items()]
    return F.concat(F.lit(f"{task}\n"), F.concat_ws("\x1e", *parts))


def asked(df: DataFrame, prompt: Column, make: Callable[[], Model], cache: str | None = None) -> DataFrame:
    """Adds ``answer``. Long prompts meet their answers by a hash."""
    rows = df.withColumn("_p", F.sha2(prompt, 256))
    prompts = df.select(prompt.alias("prompt")).distinct()
    answers = prompt_cache.answered(prompts, cache, lambda p: completed(p, make=make), make.__name__) if cache else completed(prompts, make=make)
    return rows.join(answers.select(F.sha2("prompt", 256).alias("_p"), "answer"), "_p", "left").drop("_p")


def coordinates(texts: DataFrame, make: Callable[[], Model] = RuleModel, cache: str | None = None) -> DataFrame:
    """``texts`` with a row for each distinct coordinate that the model finds and the text has: ``coordinate``."""
    told = asked(texts, _prompt(EXTRACT, PUBLICATION="text"), make, cache)
    return told.withColumn("coordinate", F.explode(T.parse_lines(F.col("answer"), F.col("text")))).drop("answer")


def contexts(found: DataFrame, make: Callable[[], Model] = RuleModel, cache: str | None = None) -> DataFrame:
    """Adds ``context`` to (text, coordinate)."""
    return asked(found, _prompt(CONTEXT, PUBLICATION="text", COORDINATE="coordinate"), make, cache).withColumnRenamed("answer", "context")


def lowest(terms: DataFrame, near: int) -> DataFrame:
    """vec_id, id, text of the ``near`` lowest numbers of each text; a null text is as the empty one. Tasks keep no more than these of a text before they meet."""
    known = terms.select(F.xxhash64("id").alias("vec_id"), "id", "text")
    order = F.row_number().over(Window.partitionBy(F.coalesce("text", F.lit(""))).orderBy("vec_id", "id"))
    return known.withColumn("_n", order).where(F.col("_n") <= near).drop("_n")


def termed(found: DataFrame, terms: DataFrame, make: Callable[[], Model] = RuleModel, embed: Callable[[], Embedder] = HashEmbedder, near: int = 5, cache: str | None = None) -> DataFrame:
    """Adds ``term``, the model's choice among the ``near`` terms (id, text) nearest to the context, as JSON.

    Terms of equal text are equally near, and ties go to the lower number; so of each text only the ``near`` lowest can be among the nearest, and
    no others are embedded and compared, however many share it."""
    texts = found.select(F.col("context").alias("text")).distinct().withColumn("query_id", F.xxhash64("text"))
    known = _kept(lowest(terms, near), "chain-known")
    queries = _kept(embedded(texts, embed).select("query_id", "embedding"), "chain-queries")  # counted and read: embedded once
    hits = vectors.nearest(embedded(known.select("vec_id", "text"), embed), queries, near)
    named = hits.join(known.select("vec_id", F.to_json(F.struct("id", "text")).alias("json")), "vec_id")
    lists = named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "json"))), lambda x: x["json"]), "\x1f").alias("_terms"))
    rows = found.withColumn("query_id", F.xxhash64("context")).join(lists, "query_id", "left").drop("query_id")
    return asked(rows, _prompt(TERM, CONTEXT="context", COORDINATE="coordinate", TERMS="_terms"), make, cache).withColumnRenamed("answer", "term").drop("_terms")


def links(found: DataFrame, query: str, make: Callable[[], Model] = RuleModel, cache: str | None = None) -> DataFrame:
    """A row for each entry of the map ``query``: key, value, link (whether the model says YES), relation, reason."""
    each = found.select("*", F.explode(query).alias("key", "value"))
    told = asked(each, _prompt(LINK, COORDINATE="coordinate", TERM="term", KEY="key", VALUE="value", CONTEXT="context"), make, cache)
    answer = T.parse_yes_no(F.col("answer"))
    return told.withColumn("_a", answer).select(*each.columns, F.coalesce("_a.found", F.lit(False)).alias("link"), F.col("_a.value").alias("relation"), F.col("_a.reason").alias("reason"))


def tested(
    tests: DataFrame, texts: DataFrame, terms: DataFrame, make: Callable[[], Model] = RuleModel, embed: Callable[[], Embedder] = HashEmbedder, size: int = 1_000_000, overlap: int = 50, cache: str | None = None
) -> DataFrame:
    """test_id, found, linked of each test (test_id, pmids, coordinate, query: a map): whether one of its texts, split to ``size``, has its coordinate, and whether, for
    the first such text in the order of the list, all links of the query hold (null if there is none, true for an empty query).

    ``texts``: pmid, text. Coordinates are extracted once for each text, however many tests name it; only texts that
    have a test's coordinate go on to the further steps.
    """
    wanted = tests.select("test_id", F.posexplode("pmids").alias("nth", "pmid"), F.col("coordinate").alias("_wanted"), "query")
    named = texts.join(wanted.select("pmid").distinct(), "pmid", "left_semi")
    parts = splitter.pieces(named.select("pmid", "text"), size, overlap)
    met = wanted.join(coordinates(parts, make, cache), "pmid").where(F.col("coordinate") == F.col("_wanted"))
    first = F.row_number().over(Window.partitionBy("test_id").orderBy("nth", "piece"))  # a test names few texts
    held = _kept(met.withColumn("_n", first).where("_n = 1").select("test_id", "text", "coordinate", "query"), "chain-coordinates")
    placed = _kept(contexts(held, make, cache).drop("text"), "chain-contexts")
    told = links(_kept(termed(placed, terms, make, embed, cache=cache), "chain-terms"), "query", make, cache)
    every = told.groupBy("test_id").agg(F.bool_and("link").alias("_all"))
    got = held.select("test_id", F.lit(True).alias("_found")).join(every, "test_id", "left")
    out = tests.select("test_id").join(got, "test_id", "left")
    return out.select("test_id", F.coalesce("_found", F.lit(False)).alias("found"), F.when(F.col("_found"), F.coalesce("_all", F.lit(True))).alias("linked"))
