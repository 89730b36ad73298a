"""Queries over ``embeddings`` and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import vectors
from colloquy.operators import retrieval
from colloquy.plans import read

K = 8


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("item_vec"), "label")


def _queries(items: DataFrame) -> DataFrame:
    """The stated query set: every hundredth vector."""
    return items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global nearest, then those of the query's own label: the filter comes after the limit."""
    items = _items(spark, sf_dir)
    found = retrieval.nearest(_queries(items), items, k=K)
    of = items.select("item_id", "label")
    own = of.select(F.col("item_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(of, "item_id").join(own, "query_id").select("query_id", "item_id", "distance", "rank", (F.col("label") == F.col("query_label")).alias("same_label"))


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    found = retrieval.nearest(_queries(items), items, k=K)
    scored = found.withColumn("score", F.round(retrieval.hybrid_score(F.pmod("item_id", F.lit(10)) / 10, F.col("distance")), 9))
    return retrieval.top_k(scored.select("query_id", "item_id", "score"), 5, F.col("score").desc(), F.col("item_id"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items for each query, by their places in two full rankings: Euclidean distance and dot product of whole vectors."""
    items = _items(spark, sf_dir)
    return retrieval.fused_rankings(_queries(items), items)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise means by label, and of all rows as label -1."""
    items = _items(spark, sf_dir).select("label", F.col("item_vec").alias("vec"))
    every = retrieval.mean_vectors(items.withColumn("label", F.lit(-1)), "label")
    both = retrieval.mean_vectors(items, "label").unionByName(every)
    return both.select("label", "n", F.posexplode("mean").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select(F.col("item_id").alias("id"), "label", F.col("item_vec").alias("vec"))
    return retrieval.medoids(items, group="label", k=3).select("label", "id", F.round("mean_distance", 6).alias("mean_distance"), "rank")


def vec_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its label's first one: in a straight line, on the sphere, and by a difference."""
    items = _items(spark, sf_dir)
    first = items.groupBy("label").agg(F.min_by("item_vec", "item_id").alias("first"))
    a, b = F.col("item_vec"), F.col("first")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    joined = items.join(first, "label")
    return joined.select(
        "item_id", total(vectors.lerp(a, b, 0.3)).alias("lerp_sum"), total(vectors.add_difference(a, b, a, 0.5)).alias("diff_sum"),
        total(vectors.intensity(b, a, 2.0)).alias("style_sum"), F.round(vectors.cosine(a, b), 6).alias("cosine"),
    )


def anti_repeat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select(F.col("item_id").alias("id"), "label", F.col("item_vec").alias("vec"))
    found = retrieval.anti_repeat(items, group="label", order="id", threshold=0.5)
    return found.select("id", "label", F.round("most", 6).alias("most"), "repetitive")


def reference_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    refs = items.groupBy("label").agg(F.min_by("item_vec", "item_id").alias("vec")).select(F.col("label").alias("class"), "vec")
    found = retrieval.reference_class(items.select(F.col("item_id").alias("id"), F.col("item_vec").alias("vec")), refs, threshold=0.5)
    return found.select("id", "class", F.round("most", 6).alias("most"))


QUERIES = {f.__name__: f for f in (knn_topk, hybrid_rank, rrf_fusion, centroids, medoids, vec_merge, anti_repeat_window, reference_class)}

_E = "e AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT item_id AS query_id, v AS qv, label AS ql FROM e WHERE item_id % 100 = 0)"
_NEAR = "d AS (SELECT query_id, item_id, label, ql, round(sqrt(list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance FROM e, q), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_COS = f"{_DOT} / (sqrt({_DOT.format(a='{a}', b='{a}')}) * sqrt({_DOT.format(a='{b}', b='{b}')}))"

ORACLE_SQL = {
    "knn_topk": f"WITH {_E}, {_NEAR} SELECT query_id, item_id, distance, rank, label = ql AS same_label FROM near WHERE rank <= 8",
    "hybrid_rank": f"""WITH {_E}, {_NEAR}, s AS (SELECT query_id, item_id, round(0.35 * ((item_id % 10) / 10) + 0.65 * greatest(0.0, 1.0 - distance), 9) AS score FROM near WHERE rank <= 8),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5""",
    "rrf_fusion": f"""WITH {_E}, {_NEAR}, c AS (SELECT query_id, item_id, round({_DOT.format(a='v', b='qv')}, 9) AS c FROM e, q),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS rank FROM c),
        u AS (SELECT query_id, item_id, rank FROM near UNION ALL SELECT query_id, item_id, rank FROM p)
        SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM u GROUP BY 1, 2""",
    "centroids": """WITH x AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), b AS (SELECT label, pos, x FROM x UNION ALL SELECT -1, pos, x FROM x)
        SELECT label, count(*) AS n, pos, round(avg(x), 6) AS x FROM b GROUP BY label, pos""",
    "medoids": f"""WITH {_E}, d AS (SELECT a.label, a.item_id AS id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a JOIN e b ON a.label = b.label),
        m AS (SELECT label, id, round(avg(d), 9) AS m FROM d GROUP BY 1, 2), k AS (SELECT label, id, round(m, 6) AS mean_distance, row_number() OVER (PARTITION BY label ORDER BY m, id) AS rank FROM m) SELECT * FROM k WHERE rank <= 3""",
    "vec_merge": f"""WITH {_E}, f AS (SELECT label, arg_min(v, item_id) AS f FROM e GROUP BY 1)
        SELECT item_id, round(0.7 * list_sum(v) + 0.3 * list_sum(f), 6) AS lerp_sum, round(list_sum(v) + 0.5 * list_sum(f) - 0.5 * list_sum(v), 6) AS diff_sum,
        round(list_sum(f) + 2 * (list_sum(v) - list_sum(f)), 6) AS style_sum, round({_COS.format(a='v', b='f')}, 6) AS cosine FROM e JOIN f USING (label)""",
    "anti_repeat_window": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY item_id) AS n FROM e),
        p AS (SELECT a.item_id AS id, a.label, round(max({_COS.format(a='a.v', b='b.v')}), 9) AS m FROM o a LEFT JOIN o b ON a.label = b.label AND b.n BETWEEN a.n - 8 AND a.n - 1 GROUP BY 1, 2)
        SELECT id, label, round(m, 6) AS most, coalesce(m >= 0.5, false) AS repetitive FROM p""",
    "reference_class": f"""WITH {_E}, r AS (SELECT label AS class, arg_min(v, item_id) AS f FROM e GROUP BY 1), c AS (SELECT item_id AS id, class, round({_COS.format(a='v', b='f')}, 9) AS c FROM e, r),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, class DESC) AS n FROM c) SELECT id, CASE WHEN c >= 0.5 THEN class END AS class, round(c, 6) AS most FROM k WHERE n = 1""",
}
