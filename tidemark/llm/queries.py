"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import overlaps
from tidemark.llm.language_id import identify
from tidemark.llm.mixing import mix
from tidemark.llm.debruijn_dedup import substring_dedup
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality
from tidemark.llm.simhash_dedup import op10_simhash
from tidemark.llm.simhash_sql import SIMHASH_SQL
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.target_resampling import resample
from tidemark.llm.token_alignment import align
from tidemark.llm.token_shards import token_shards
from tidemark.llm.topk_search import top_k
from tidemark.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: overlaps(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_topk_search": lambda s, d: top_k(table(s, d, "embeddings")),
        "op3_quality": lambda s, d: quality(table(s, d, "documents"), table(s, d, "labels")),
        "op4_toxicity": lambda s, d: toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op5_mixing": lambda s, d: mix(table(s, d, "documents")),
        "op6_language_id": lambda s, d: identify(table(s, d, "documents")),
        "op7_token_shards": lambda s, d: token_shards(table(s, d, "documents")),
        "op8_suffix_dedup": lambda s, d: suffix_dedup(table(s, d, "documents")),
        "op9_substring_dedup": lambda s, d: substring_dedup(table(s, d, "documents")),
        "op10_simhash": lambda s, d: op10_simhash(table(s, d, "documents")),
        "op11_target_resampling": lambda s, d: resample(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_token_alignment": lambda s, d: align(table(s, d, "documents")),
        "op13_best_fit_packing": lambda s, d: pack(table(s, d, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": TOPK_SQL, "op8_suffix_dedup": SUFFIX_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op10_simhash": SIMHASH_SQL, "op11_target_resampling": RESAMPLING_SQL}


#: Strings of 100 bytes by value; one that starts after its first place removes its bytes. Runs of removed bytes are islands.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id NULLS FIRST) AS doc, doc_id,
                  encode(coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT r, doc, x, unnest(range(n - 99)) AS i FROM d WHERE n >= 100),
k AS (SELECT r, doc, i, sha256(x[i + 1:i + 100]) AS h FROM s),
f AS (SELECT h, min({'doc': doc, 'i': i}) AS first FROM k GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k.r, k.i FROM k JOIN f USING (h) WHERE {'doc': k.doc, 'i': k.i} > f.first),
q AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100, true)::INTEGER AS fresh FROM hit),
o AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM q),
gone AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM o GROUP BY r, run),
part AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM gone
         UNION ALL SELECT r, max(gone.b), d.n FROM gone JOIN d USING (r) GROUP BY r, d.n),
kept AS (SELECT r, string_agg(hex(d.x[part.a + 1:part.b]), '' ORDER BY part.a) AS x FROM part JOIN d USING (r) WHERE part.a < part.b GROUP BY r),
c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY r)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN c.r IS NULL THEN sha256(d.x) ELSE sha256(unhex(coalesce(kept.x, ''))) END AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN kept USING (r)
"""


#: Windows of 35 words by value; a window that is counted twice removes its words.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT s.r, s.i, sha256(array_to_string(list_slice(d.w, s.i, s.i + 34), ' ')) AS h FROM s JOIN d USING (r)),
again AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k.r, k.i FROM k JOIN again USING (h)),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
e AS (SELECT p.r, p.i, p.word, h.i AS last FROM p ASOF LEFT JOIN hit h ON p.r = h.r AND p.i >= h.i),
v AS (SELECT r, i, word, last IS NOT NULL AND i - last < 35 AS gone FROM e),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM v GROUP BY r)
SELECT d.doc_id, coalesce(g.n_words, 0)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

#: Every query row against every other row, by integer inner product; rows are known by number, as ids may repeat.
TOPK_SQL = """
WITH f AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c AS (SELECT r, vec_id, unnest(list_prepend(0, x)) AS v, generate_subscripts(list_prepend(0, x), 1) AS i FROM f),
s AS (SELECT q.r AS q, q.vec_id AS query_id, o.r, o.vec_id, sum(q.v * o.v)::BIGINT AS score
      FROM c q JOIN c o ON q.i = o.i AND q.r <> o.r WHERE q.vec_id % 100 = 0 GROUP BY ALL),
n AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""

#: Words by bucket, a CRC-32 from its table of 256 remainders; gains, weights, noise and ranks in the contract's own terms.
RESAMPLING_SQL = r"""
WITH RECURSIVE p AS (SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM p WHERE step < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM p WHERE step = 8),
lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
b AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: ((strpos('0123456789ABCDEF', hex(w)[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(w)[2 * i]) - 1)::BIGINT) AS x FROM v),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, c: xor(t[xor(a % 256, c) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM b, t),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM g)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s FULL JOIN g USING (bucket), n),
m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN k USING (w) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
e AS (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM h LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight) AS rank, count(*) OVER () AS able FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END::BIGINT AS rank FROM e LEFT JOIN o USING (r)
"""
