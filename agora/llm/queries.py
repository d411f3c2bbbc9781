"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agora.llm.bpe import op3_bpe_encode_decode
from agora.llm.embedding_dedup import op10_embedding_dedup
from agora.llm.mixing import op8_mix
from agora.llm.nearest import op9_nearest
from agora.llm.ngram_join import op1_ngram_join
from agora.llm.quality import op7_quality
from agora.llm.secret_scan import op6_secret_scan
from agora.llm.sharding import op5_shard
from agora.llm.token_counts import op4_token_counts
from agora.llm.toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_bpe_encode_decode, op4_token_counts, op5_shard, op6_secret_scan, op7_quality, op8_mix, op9_nearest, op10_embedding_dedup)}


#: Words, distinct shingles, pairs that share one, links, and what each document reaches.
NGRAM_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS z, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, z FROM p JOIN n nx ON nx.doc_id = x JOIN n nz ON nz.doc_id = z WHERE 100 * o >= 80 * (nx.n + nz.n - o)),
r AS (SELECT doc_id AS x, doc_id AS z FROM documents UNION SELECT r.x, e.z FROM r JOIN e ON e.x = r.z)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(z) AS component_id FROM r GROUP BY ALL) c USING (doc_id)"""

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS z FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS z FROM embeddings UNION SELECT r.x, e.z FROM r JOIN e ON e.x = r.z),
c AS (SELECT x AS vec_id, min(z) AS component_id FROM r GROUP BY ALL)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


def oracle_sql() -> dict[str, str]:
    """SQL can't say the others: classifiers, tokenizers, hashes of Spark's own, tests of randomness, an approximate search."""
    return {"op1_ngram_join": NGRAM_JOIN, "op10_embedding_dedup": EMBEDDING_DEDUP}
