"""Duplicate windows, Jaccard pairs and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from ..sources import projection as P
from .registry import query, rounded

PAIRS = r"""WITH s AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '\s+') IF x <> ''] AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) AS g FROM s WHERE len(w) >= 3),
r AS (SELECT min(doc_id) AS id, g FROM g GROUP BY g), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM r),
c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM c WHERE k / (na + nb - k) >= 0.7 UNION ALL SELECT id, doc_id, 1.0 FROM g JOIN r USING (g) WHERE doc_id <> id"""


@query(f"""WITH {P.LINES}, k AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''),
r AS (SELECT doc_id, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS run FROM k)
SELECT array_to_string(run, chr(10)) AS text, count(*) AS n, count(DISTINCT doc_id) AS files FROM r WHERE len(run) = 4 GROUP BY 1 HAVING count(*) > 1""")
def duplicate_windows(spark, sf_dir):
    return S.duplicate_windows(P.lines(spark, sf_dir), 4)


@query(PAIRS)
def jaccard_pairs(spark, sf_dir):
    return rounded(S.jaccard_pairs(P.table(spark, sf_dir, "documents")), "jaccard")


@query(r"""WITH s AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '\s+') IF x <> ''] AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) AS g FROM s WHERE len(w) >= 3)
SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS representative FROM g""")
def jaccard_classes(spark, sf_dir):
    return S.jaccard_classes(P.table(spark, sf_dir, "documents"))


@query()
def minhash_lsh_pairs(spark, sf_dir):
    return rounded(S.minhash_pairs(P.table(spark, sf_dir, "documents")), "jaccard")


COSINE = """n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
k AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) / (q.l * x.l) AS score FROM n q, n x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM k)"""


def _sides(spark, sf_dir):
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 20 = 0"), e


@query(f"WITH {COSINE} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM t WHERE rank <= 10")
def knn_exact(spark, sf_dir):
    return rounded(S.nearest_exact(*_sides(spark, sf_dir), 10), "score")


@query(f"WITH {COSINE} SELECT query_id, round(1 - score, 6) AS distance FROM t WHERE rank = 5")
def knn_anomaly(spark, sf_dir):
    near = S.nearest_exact(*_sides(spark, sf_dir), 5).where("rank = 5")
    return rounded(near.select("query_id", (1 - F.col("score")).alias("distance")), "distance")


@query()
def knn_quantized(spark, sf_dir):
    return rounded(S.nearest_quantized(*_sides(spark, sf_dir), 10, 64), "score")
