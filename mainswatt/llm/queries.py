"""Thin queries over the operators, each on its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, near_dup, packing, periodic, pii, secret_scan, sharding, spelling, suffixes, super_minhash, topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best integer inner products of every 20th vector against all others."""
    table = _table(spark, sf_dir, "embeddings")
    return topk.top_k(table, table.filter(F.col("vec_id") % 20 == 0))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that alignment with an earlier document deletes, and what is left."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    models = language.fit(docs.filter(~F.coalesce(language.held_out(), F.lit(True))))
    found = language.identify(docs, models)
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items whose template windows they hold."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, each a sequence of a binary length."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of smaller documents cover."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its more frequent spelling; words lose a letter by a stated rule."""
    words = spelling.words_of(_table(spark, sf_dir, "documents"), damage=97)
    return spelling.variants(spelling.vocabulary(words, 5, 3))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and size of the shingle set of every document: three words, similarity 0.85."""
    return super_minhash.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85, shingle=3, recall=0.99999)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and what is left without their repeats; some tails are repeated by a stated rule."""
    return periodic.digests(periodic.periodic_runs(periodic.repeat_tails(_table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pivot_topk, op2_line_dedup, op3_pii_spans, op4_language, op5_near_duplicates, op6_secrets, op7_decontamination, op8_packing, op9_sharding, op10_suffix_dedup, op11_spelling_variants, op12_superminhash, op13_periodic_runs)
    return {f.__name__: f for f in found}


_TOPK = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), asked AS (
  SELECT row_number() OVER () AS query, * FROM (SELECT DISTINCT vec_id, v FROM ok WHERE vec_id % 20 = 0)
), scored AS (
  SELECT q.query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM asked q JOIN ok c ON c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_SHARDS = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
hashed AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295)) AS text_crc32
  FROM docs, crc),
placed AS (SELECT *, CAST(CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR))), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS vslot FROM hashed),
used AS (SELECT vslot, sum(size) AS bytes, count(*) AS n FROM placed GROUP BY vslot),
ordered AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, vslot) AS turn FROM used),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS INTEGER) AS vslot, CAST(NULL AS INTEGER) AS shard, list_transform(range(16), lambda x: CAST(0 AS HUGEINT)) AS loads
  UNION ALL
  SELECT o.turn, o.vslot, CAST(list_position(d.loads, list_min(d.loads)) - 1 AS INTEGER),
    list_transform(d.loads, lambda v, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN v + o.bytes ELSE v END)
  FROM dealt d JOIN ordered o ON o.turn = d.turn + 1),
starts AS (SELECT d.vslot, d.shard, coalesce(sum(u.n) OVER (PARTITION BY d.shard ORDER BY d.vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM dealt d JOIN used u ON u.vslot = d.vslot)
SELECT p.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, s.shard,
  CAST(begin + row_number() OVER (PARTITION BY p.vslot ORDER BY doc_id, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, p.vslot, CAST(1 AS INTEGER) AS map_version
FROM placed p JOIN starts s ON s.vslot = p.vslot
"""

_REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, hex(b) AS x FROM documents),
places AS (SELECT r, doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM docs),
strings AS (SELECT r, doc_id, p, hash(array_slice(b, p + 1, p + 50)) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS d FROM strings GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.r, s.p FROM strings s JOIN firsts l ON s.h = l.h AND s.doc_id > l.d),
edge AS (SELECT r, p, p - lag(p, 1, -1000) OVER (PARTITION BY r ORDER BY p) > 50 AS new FROM hit),
run AS (SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
gone AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY r, k),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, list(struct_pack(a := a, b := b) ORDER BY a) AS spans FROM gone GROUP BY r),
kept AS (
  SELECT d.r, d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN spans IS NULL THEN x ELSE substr(x, 1, 2 * spans[1].a) || array_to_string(list_transform(range(1, len(spans) + 1), lambda i: substr(x, 2 * spans[i].b + 1, 2 * (coalesce(spans[i + 1].a, length(x) // 2) - spans[i].b))), '') END AS rest
  FROM docs d LEFT JOIN sums s ON s.r = d.r)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

_NEAR = """
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0d\\x1c-\\x20]+'), lambda w: w <> '') AS words FROM documents),
keyed AS (SELECT doc_id, array_to_string(words, ' ') AS k, words FROM docs WHERE len(words) > 0),
texts AS (SELECT k, min(doc_id) AS rep, count(*) AS n_copies, any_value(words) AS words FROM keyed GROUP BY k),
sets AS (SELECT DISTINCT rep, unnest(CASE WHEN len(words) < 5 THEN [k] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS s FROM texts),
sizes AS (SELECT rep, count(*) AS n FROM sets GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS other FROM texts UNION SELECT r.node, l.b FROM reach r JOIN sides l ON l.a = r.other),
classes AS (SELECT node AS rep, min(other) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a AS rep, count(*) AS n_links FROM sides GROUP BY a)
SELECT d.doc_id, CAST(coalesce(c.class_id, d.doc_id) AS BIGINT) AS class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(t.rep, d.doc_id) AS BIGINT) AS copy_of, CAST(coalesce(t.n_copies, 1) AS BIGINT) AS n_copies
FROM (SELECT doc_id FROM documents) d LEFT JOIN keyed k ON k.doc_id = d.doc_id LEFT JOIN texts t ON t.k = k.k LEFT JOIN classes c ON c.rep = t.rep LEFT JOIN counts n ON n.rep = t.rep
"""


_CRC = """crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) t(i))"""


def _crc32(text: str) -> str:
    """The crc32 of the UTF-8 bytes of an SQL text, where ``tab`` of ``crc`` is in scope."""
    return f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295))"


_SPELLING = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY doc_id, w),
hashed AS (SELECT w, c, {_crc32("CAST(doc_id AS VARCHAR) || ':' || w")} AS h FROM each, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM vocab, unnest(range(1, length(word) + 1)) t(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
chosen AS (SELECT f.word, f.n, f.n_near, f.form_n, min(p.near) AS form FROM forms f LEFT JOIN pairs p ON p.word = f.word AND p.near_n = f.form_n GROUP BY ALL),
walk AS (SELECT word, form AS at FROM chosen WHERE form IS NOT NULL UNION ALL SELECT w.word, c.form FROM walk w JOIN chosen c ON c.word = w.at WHERE c.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN chosen c ON c.word = w.at WHERE c.form IS NULL)
SELECT c.word, c.form, coalesce(e.root, c.word) AS root, c.n, CAST(c.n_near AS BIGINT) AS n_near, c.form_n FROM chosen c LEFT JOIN ends e ON e.word = c.word
"""


_SUPER = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0d\\x20]+'), lambda w: w <> '') AS words FROM documents),
keyed AS (SELECT r, doc_id, array_to_string(words, ' ') AS k, words FROM docs WHERE len(words) > 0),
texts AS (SELECT k, min(doc_id) AS rep, any_value(words) AS words FROM keyed GROUP BY k),
sets AS (SELECT DISTINCT rep, unnest(CASE WHEN len(words) < 3 THEN [k] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS s FROM texts),
sizes AS (SELECT rep, count(*) AS n FROM sets GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS other FROM texts UNION SELECT r.node, l.b FROM reach r JOIN sides l ON l.a = r.other),
classes AS (SELECT node AS rep, min(other) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.component, d.doc_id) AS BIGINT) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN keyed k ON k.r = d.r LEFT JOIN texts t ON t.k = k.k LEFT JOIN classes c ON c.rep = t.rep LEFT JOIN sizes s ON s.rep = t.rep
"""

_PERIODIC = f"""
WITH {_CRC},
split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0d\\x20]+'), lambda w: w <> '') AS held,
    {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
shape AS (SELECT r, doc_id, held, len(held) AS n, h // 10 AS g, h % 10 = 0 AND len(held) > 0 AS made FROM split),
tails AS (SELECT *, CASE WHEN made THEN g % n ELSE n END AS a, CASE WHEN made THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM shape),
plain AS (SELECT r, unnest(held) AS w, unnest(range(n)) AS i FROM tails),
words AS (SELECT x.r, x.i, y.w FROM plain x JOIN tails t ON t.r = x.r JOIN plain y ON y.r = x.r AND y.i = CASE WHEN x.i < t.a THEN x.i ELSE t.a + (x.i - t.a) % t.p END),
grams AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o AS k FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.k = b.k AND a.i < b.i),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pairs),
stretch AS (SELECT r, q, min(i) AS s, count(*) + 5 + q AS l FROM placed GROUP BY r, q, part HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
marks AS (SELECT r, s + q AS i, 1 AS d FROM runs UNION ALL SELECT r, s + l, -1 FROM runs),
level AS (SELECT r, i, sum(d) AS d FROM marks GROUP BY r, i),
cover AS (SELECT w.r, w.i, w.w, coalesce(sum(l.d) OVER (PARTITION BY w.r ORDER BY w.i), 0) AS depth FROM words w LEFT JOIN level l ON l.r = w.r AND l.i = w.i),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM cover WHERE depth = 0 GROUP BY r),
sums AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) AS turn FROM runs)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(sums.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM tails t LEFT JOIN sums ON sums.r = t.r LEFT JOIN best b ON b.r = t.r AND b.turn = 1 LEFT JOIN kept k ON k.r = t.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": _TOPK, "op5_near_duplicates": _NEAR, "op9_sharding": _SHARDS, "op10_suffix_dedup": _REPEATS, "op11_spelling_variants": _SPELLING, "op12_superminhash": _SUPER, "op13_periodic_runs": _PERIODIC}
