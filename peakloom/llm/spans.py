"""Substring deduplication by sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed; runs are counted over all documents, and a
sentence is removed when a run that covers it is not the first of its kind (by doc_id, then place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import join_on_key, row_key, table
from peakloom.plans.durable import stored

#: Sentences in a run. Two would also match common short ones: see the README for figures.
SPAN = 3
#: Every run with a word counts.
LEAST_WORDS = 1
#: A sentence with the marks or line ends behind it; the pieces tile the text.
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
_BLANKS = r"[ \t\r\n]+"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _runs(docs: DataFrame, span: int, least_words: int) -> DataFrame:
    """(doc_id, __h, i, place, h1, h2): the run of sentences from i on, with two hashes of it.

    A document with fewer sentences than ``span`` is one run. ``place`` orders runs by doc_id and i;
    a null id comes before all others, by the hash of its text.
    """
    key = lambda s: F.trim(F.regexp_replace(F.lower(s), _BLANKS, " "))
    sentences = docs.select(*row_key(), F.transform(pieces(F.col("text")), key).alias("s")).where(F.size("s") > 0)
    n = F.size("s")

    def run(i):
        part = F.slice(F.col("s"), i + 1, F.lit(span))
        words = F.aggregate(part, F.lit(0), lambda a, x: a + F.when(x == "", 0).otherwise(F.size(F.split(x, " "))))
        joined = F.array_join(part, "\u0001")
        return F.struct(i.alias("i"), words.alias("words"), F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(1), joined).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))), run)
    rows = sentences.select("doc_id", "__h", F.explode(each).alias("r")).where(F.col("r.words") >= least_words)
    nobody = F.col("__h").cast("decimal(20,0)") - F.lit(str(3 << 63)).cast("decimal(20,0)")
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), nobody).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("r.i")
    return rows.select("doc_id", "__h", "r.i", place.cast("decimal(38,0)").alias("place"), "r.h1", "r.h2")


def repeated_runs(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, __h, starts): where runs start that are not the first of their kind."""
    runs = _runs(docs, span, least_words)
    kinds = runs.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    again = stored(kinds.where(F.col("first") < F.col("last")).select("h1", "h2", "first"))
    later = runs.join(again, ["h1", "h2"]).where(F.col("place") != F.col("first"))
    # at most the sentences of one document
    return later.groupBy("doc_id", "__h").agg(F.collect_set("i").alias("starts"))


def remove_repeats(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``kept`` (text without the removed sentences), ``n_sentences`` and
    ``n_removed``.

    A null text has no sentences and stays null in ``kept``. Rows with the same doc_id and place are
    the same occurrence, so repeated rows do not remove each other, nor do different texts under one id
    at the same place. Null ids come first; two different texts without an id are two documents.
    Columns of the new names are replaced.
    """
    docs = docs.drop("kept", "n_sentences", "n_removed")
    found = stored(repeated_runs(docs, span, least_words))
    joined = join_on_key(docs.withColumn("__h", row_key()[1]), found, "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + span - 1))))
    out = joined.withColumn("__s", pieces(F.col("text")))
    out = out.withColumn("__gone", F.when(F.col("starts").isNotNull(), F.array_sort(F.filter(covered, lambda i: i < F.size("__s")))))
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("__s"), F.col("__gone")))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], kept.alias("kept"), F.size("__s").cast("long").alias("n_sentences"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _without(parts: Column, gone: Column) -> Column:
    """The parts whose positions are not in ``gone`` (sorted), joined: the stretches between."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts)))
    stretch = lambda lo, hi: F.when(hi - lo > 1, F.array_join(F.slice(parts, lo + 2, hi - lo - 1), "")).otherwise(F.lit(""))
    pairs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), stretch)
    return F.array_join(pairs, "")


def op5(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH p AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') AS s FROM documents
), k AS (
  SELECT doc_id, s, len(s) AS n, [trim(regexp_replace(lower(x), '[ \\t\\r\\n]+', ' ', 'g'), ' ') for x in s] AS c FROM p
), r AS (
  SELECT doc_id, i, array_to_string(list_slice(c, i + 1, i + {SPAN}), chr(1)) AS run,
         list_sum([CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END for x in list_slice(c, i + 1, i + {SPAN})]) AS words
  FROM (SELECT doc_id, c, unnest(range(0, greatest(n - {SPAN}, 0) + 1)) AS i FROM k WHERE n > 0)
), f AS (
  SELECT run, min((doc_id, i)) AS first FROM r WHERE words >= {LEAST_WORDS} GROUP BY run
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS j FROM r JOIN f USING (run) WHERE (doc_id, i) <> first
), e AS (
  SELECT doc_id, unnest(s) AS x, unnest(range(0, n)) AS j FROM k
), m AS (
  SELECT e.doc_id, count(*) AS n_sentences, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN x ELSE '' END, '' ORDER BY e.j) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""
