"""Ranking: postings, prefix and phrase clauses, BM25, reciprocal-rank fusion.

Tables: items (item_id, scope, title, body). Queries are lists of prefixes, at most 6 queries of at most a few dozen prefixes,
validated on the driver. Without an index, each item's matches are counted inside its row, so nothing is exploded or shuffled
but the candidates; with one, only the postings of matching terms are read (plans/retrieval.py). Candidates are ranked on ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import terms
from quernstone.session import cut

K1, B, TITLE_WEIGHT, BODY_WEIGHT, FLOOR_IDF = 1.2, 0.75, 4.0, 1.0, 1e-6
CANDIDATES, RRF_K = 20, 60
#: The least common multiple of 61..80: weights over it are whole numbers, so the fused order is exact.
RRF_LCM = 205_543_280_508_215_814_964_800


def document_frequency(items: DataFrame) -> DataFrame:
    """(term, df): a term is given once a row, so only one shuffle of partial counts is left."""
    own = F.array_union(F.array_distinct(terms(F.col("title"))), terms(F.col("body")))
    return items.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words: the runs of the sorted words. Each step's array is bound once, as a lambda's variable."""
    bound = lambda made, use: F.get(F.transform(F.array(made), use), F.lit(0))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    return bound(F.sort_array(words), lambda s: bound(begins(s), lambda b: runs(s, b)))


def postings(items: DataFrame) -> DataFrame:
    """(term, item_id, field, tf). A row's words are counted inside it; only where an id has several rows, which a look at the ids
    alone tells, counts are added up across rows."""
    words = items.select("item_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), terms(F.col("title")).alias("words")), F.struct(F.lit("body").alias("field"), terms(F.col("body")).alias("words")))).alias("x"))
    found = words.select("item_id", "x.field", F.explode(counted(F.col("x.words"))).alias("p")).select("p.term", "item_id", "field", "p.tf")
    if items.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return found
    return found.groupBy("term", "item_id", "field").agg(F.sum("tf").alias("tf"))


def positions(items: DataFrame) -> DataFrame:
    """(item_id, pos, term) of bodies."""
    return items.select("item_id", F.posexplode(terms(F.col("body"))).alias("pos", "term"))


def lengths(items: DataFrame) -> DataFrame:
    """(item_id, scope, n): terms of title and body."""
    return items.select("item_id", "scope", (F.size(terms(F.col("title"))) + F.size(terms(F.col("body")))).alias("n"))


def clause_table(spark: SparkSession, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(query_ix, clause_ix, prefix) of compiled queries; bounded by the request's limits."""
    rows = ", ".join(f"({i}, {j}, '" + p.replace("\\", "\\\\").replace("'", "\\'") + "')" for i, q in enumerate(queries) for j, p in enumerate(q))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(query_ix, clause_ix, prefix)")


def phrase_match(items: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """(item_id, hits): places where the terms follow one another, overlapping ones too, found inside each row."""
    joined = F.concat(F.lit(" "), F.array_join(terms(F.col("body")), " "), F.lit(" "))
    hits = F.regexp_count(joined, F.lit("(?= " + " ".join(phrase) + " )"))  # terms have letters and digits only
    return items.select("item_id", hits.cast("long").alias("hits")).where("hits > 0")


def clause_hits(found: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query_ix, clause_ix, item_id, f): weighted counts of the terms that begin with a clause's prefix."""
    matched = found.join(F.broadcast(clauses), F.col("term").startswith(F.col("prefix")))
    weight = F.when(F.col("field") == "title", TITLE_WEIGHT).otherwise(BODY_WEIGHT)
    return matched.groupBy("query_ix", "clause_ix", "item_id").agg(F.sum(F.col("tf") * weight).alias("f"))


def matches(items: DataFrame, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(item_id, scope, n, f): an item's number of terms, and for each query and prefix the weighted count of its terms that begin so.
    Stored, so that texts are read once for statistics and scores."""
    word = r"[\p{L}\p{N}\p{Co}]"
    title, body = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body"))
    count = lambda pattern: (F.regexp_count(title, F.lit(pattern)), F.regexp_count(body, F.lit(pattern)))
    begins = lambda p: rf"(?<!{word})" + "".join("\\" + c if not c.isalnum() else c for c in p)
    weighted = lambda p: (lambda t, b: t * TITLE_WEIGHT + b * BODY_WEIGHT)(*count(begins(p)))
    n = sum(count(word + "+"), F.lit(0))
    return cut(items.select("item_id", "scope", n.cast("long").alias("n"), F.array(*(F.array(*(weighted(p) for p in q)) for q in queries)).alias("f")), "matches")


def clause_counts(found: DataFrame, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(query_ix, clause_ix, df, total): items and weighted terms of each prefix that has any."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("query_ix"), F.lit(j).alias("clause_ix"), F.col("f")[i][j].alias("f")) for i, q in enumerate(queries) for j in range(len(q)))))
    return found.select(each.alias("x")).select("x.*").where("f > 0").groupBy("query_ix", "clause_ix").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("total"))


def all_met(found: DataFrame, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(query_ix, item_id): items that have every prefix of a query."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("query_ix"), F.forall(F.col("f")[i], lambda x: x > 0).alias("met")) for i in range(len(queries)))))
    return found.select("item_id", each.alias("x")).where("x.met").select("x.query_ix", "item_id")


def bm25(found: DataFrame, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(query_ix, item_id, scope, score) of the items in matches() that have all prefixes of a query; lower scores are better.

    Statistics are those of all items, whatever scope is asked for: one row, joined by broadcast."""
    places = [(i, j) for i, q in enumerate(queries) for j in range(len(q))]
    stats = found.agg(F.count(F.lit(1)).alias("total"), F.avg("n").alias("avg_n"), *(F.count_if(F.col("f")[i][j] > 0).alias(f"df_{i}_{j}") for i, j in places))
    idf = lambda df: (lambda x: F.when(x <= 0, FLOOR_IDF).otherwise(x))(F.log((F.col("total") - df + 0.5) / (df + 0.5)))
    part = lambda i, j: -idf(F.col(f"df_{i}_{j}")) * (F.col("f")[i][j] * (K1 + 1)) / (F.col("f")[i][j] + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    scores = [F.when(F.forall(F.col("f")[i], lambda x: x > 0), sum((part(i, j) for j in range(len(q))), F.lit(0.0))) for i, q in enumerate(queries)]
    each = F.posexplode(F.array(*scores)).alias("query_ix", "score")
    return found.crossJoin(F.broadcast(stats)).select("item_id", "scope", each).where("score IS NOT NULL").select("query_ix", "item_id", "scope", "score")


def bm25_indexed(clauses: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """As bm25(), from an index: found holds the postings of matching terms, sizes all items' lengths."""
    hits = clause_hits(found, clauses)
    stats = sizes.agg(F.count(F.lit(1)).alias("total"), F.avg("n").alias("avg_n"))
    frequency = hits.groupBy("query_ix", "clause_ix").agg(F.count(F.lit(1)).alias("df"))
    needed = clauses.groupBy("query_ix").agg(F.count(F.lit(1)).alias("needed"))
    rated = hits.join(F.broadcast(frequency), ["query_ix", "clause_ix"]).crossJoin(F.broadcast(stats)).join(sizes, "item_id")  # stats is one row, frequency one a clause
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, FLOOR_IDF).otherwise(idf)
    part = -idf * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    grouped = rated.withColumn("part", part).groupBy("query_ix", "item_id").agg(F.first("scope").alias("scope"), F.count(F.lit(1)).alias("met"), F.array_sort(F.collect_list(F.struct("clause_ix", "part"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"])
    return grouped.join(F.broadcast(needed), "query_ix").where("met = needed").select("query_ix", "item_id", "scope", total.alias("score"))


def top_candidates(scored: DataFrame, scopes: Sequence[str] | None = None, n: int = CANDIDATES) -> DataFrame:
    """(query_ix, item_id, scope, score, rank): the best n of each query; scopes are applied before the limit."""
    if scopes is not None:
        scored = scored.where(F.col("scope").isin(*scopes))
    rank = F.row_number().over(W.partitionBy("query_ix").orderBy("score", "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def fuse(ranked: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, weight, first_rank, best_rank, final_rank): sums of 1 / (60 + rank), as exact whole numbers over RRF_LCM."""
    table = F.create_map(*(x for r in range(1, CANDIDATES + 1) for x in (F.lit(r), F.lit(str(RRF_LCM // (RRF_K + r))).cast("decimal(38,0)"))))
    fused = ranked.groupBy("item_id").agg(F.sum(table[F.col("rank")]).cast("decimal(38,0)").alias("weight"), F.min(F.when(F.col("query_ix") == 0, F.col("rank"))).alias("first_rank"), F.min("rank").alias("best_rank"))
    fused = fused.withColumn("first_rank", F.coalesce("first_rank", F.lit(CANDIDATES + 1)))
    order = [F.desc("weight"), "first_rank", "best_rank", "item_id"]
    top = fused.orderBy(*order).limit(n)  # a report of at most 20 rows
    return top.withColumn("final_rank", F.row_number().over(W.orderBy(*order)))
