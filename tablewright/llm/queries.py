"""Queries of the training-data operators, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.bm25 import op4_block_max_search
from tablewright.llm.decontaminate import op1_greedy_tiling_decontamination
from tablewright.llm.langid import op6_string_kernel_language
from tablewright.llm.packing import op3_best_fit_packing
from tablewright.llm.quality import op5_kneser_ney_quality
from tablewright.llm.repeats import op10_suffix_array_dedup
from tablewright.llm.secrets import op2_cnn_secret_scan
from tablewright.llm.sharding import op7_proportional_sharding
from tablewright.llm.simhash import op9_simhash_near_dedup
from tablewright.llm.token_files import op8_token_files

_OPERATORS = (
    op1_greedy_tiling_decontamination,
    op2_cnn_secret_scan,
    op3_best_fit_packing,
    op4_block_max_search,
    op5_kneser_ney_quality,
    op6_string_kernel_language,
    op7_proportional_sharding,
    op8_token_files,
    op9_simhash_near_dedup,
    op10_suffix_array_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
#: Those that SQL can express. The others use a tokenizer, a hash that DuckDB lacks, or a model; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op4_block_max_search": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf q JOIN tf t USING (word) JOIN df USING (word) JOIN len ON len.doc_id = t.doc_id CROSS JOIN st WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s
QUALIFY rank <= 10""",
    "op10_suffix_array_dedup": """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
c AS MATERIALIZED (SELECT doc_id, n_bytes, c, substr(h, 256 * c + 1, 256 + 398) AS h FROM (SELECT *, unnest(range(0, (n_bytes - 200) // 128 + 1)) AS c FROM n WHERE n_bytes >= 200)),
w AS MATERIALIZED (SELECT doc_id, c, j, hash(substr(h, 2 * j + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(128, n_bytes - 199 - 128 * c))) AS j FROM c)),
close AS MATERIALIZED (SELECT doc_id, 128 * c + j AS i, substr(h, 2 * j + 1, 400) AS s FROM w JOIN c USING (doc_id, c) WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
hit AS (SELECT doc_id, i FROM close QUALIFY count(*) OVER (PARTITION BY s) > 1),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, k),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT n.doc_id, coalesce(max(b), 0), n_bytes FROM n LEFT JOIN spans USING (doc_id) GROUP BY n.doc_id, n_bytes),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256 FROM pieces JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id) GROUP BY n.doc_id, n_bytes, kept_sha256""",
}
