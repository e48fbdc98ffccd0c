"""Registered queries of this package: each applies one operator to its whole table.

``QUERIES`` and ``SQL`` have the same shape as those of ``atlasledger.checks``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasledger.llm import toxicity
from atlasledger.llm.centroids import clusters, described
from atlasledger.llm.decontamination import contaminated
from atlasledger.llm.language import identify, learn
from atlasledger.llm.main_text import extract
from atlasledger.llm.near_duplicates import near_duplicates
from atlasledger.llm.packing import Limits, pack_documents
from atlasledger.llm.quality_rules import quality_rules
from atlasledger.llm.spelling import variants, vocabulary
from atlasledger.llm.substrings import repeated_runs
from atlasledger.llm.token_files import read_token_files, write_token_files
from atlasledger.llm.word_table import decode, encode
from atlasledger.llm.warc import read_records, write_archives
from atlasledger.session import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = 50_257
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    """The SQL counterpart of a query; those without one are tested against plain Python."""
    SQL[name] = text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality_rules(table(spark, sf_dir, "documents"), trusted)
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = write_archives(table(spark, sf_dir, "pages"), Scratch(spark))
    return read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


sql(
    "op2_warc",
    """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f""",
)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest, folder = write_token_files(docs, Scratch(spark), TOKENIZER, 2, VOCABULARY)
    return read_token_files(manifest, folder, with_ids=False)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, 0, Limits(tokens=1024))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    with Scratch(spark) as scratch:
        model = toxicity.learn(docs, labels.where(~held_out), scratch)
    told = toxicity.score(docs, model).select("row.doc_id", "score")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return told.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op6_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeated_runs(table(spark, sf_dir, "documents"))
    return left.select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


WORDS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents
)"""
sql(
    "op6_repeated_runs",
    WORDS_SQL.format(text="coalesce(text, '')")
    + """,
runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
),
hits AS (SELECT doc_id, i FROM runs WHERE h IN (SELECT h FROM runs GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(0, 35) t(k)),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS t
  FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    with Scratch(spark) as scratch:
        model = learn(docs.where(~held_out), PIECES, scratch)
    told = identify(docs, model).select("row.doc_id", "lang_pred", "score")
    return told.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


sql(
    "op8_near_duplicates",
    WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT p.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, p.doc_id = component_id AS kept
FROM part p LEFT JOIN n ON n.doc_id = p.doc_id""",
)


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "embeddings"), Scratch(spark))
    return described(found).select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round is a pair of tables: nearest centroids, then means (floored)."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(embedding) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster, x FROM v WHERE vec_id IS NOT NULL
  ORDER BY 1 LIMIT """
        + f"{k})"
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, any_value(x) AS x, min(struct_pack(d := d, cluster := cluster)) AS near
  FROM (SELECT v.r, v.vec_id, v.x, c.cluster, {apart} AS d FROM v, c{n} c) GROUP BY r, vec_id
)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS (
  SELECT cluster, i, sum(e) AS s, count(*) AS n
  FROM (SELECT near.cluster AS cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY cluster, i
),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(any_value(m.x), any_value(c.x)) AS x FROM c{n} c LEFT JOIN (
    SELECT cluster, list((CASE WHEN s < 0 AND s % n <> 0 THEN (s - (s % n + n)) // n ELSE s // n END)::BIGINT ORDER BY i) AS x FROM m{n} GROUP BY cluster
  ) m ON m.cluster = c.cluster GROUP BY c.cluster
)"""
            )
    last = f"""
SELECT vec_id, near.cluster::INTEGER AS cluster, near.d AS distance,
       (sum(near.d) OVER (PARTITION BY near.cluster))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = near.cluster"""
    return ",\n".join(parts) + last


sql("op11_centroids", _centroids_sql())


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    words = scratch.save(vocabulary(table(spark, sf_dir, "documents"), slips=97))
    return variants(words, scratch).select("word", "form", "root", "n", "n_near", "form_n")


def _spelling_sql() -> str:
    """CRC-32 by its table, which follows from the polynomial."""
    crcs = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        crcs.append(k)
    data = "flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
    step = f"lambda c, b: xor(c >> 8, ({crcs})[(xor(c, b) & 255) + 1])"
    return f"""
WITH RECURSIVE run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
),
own AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY 1, 2),
told AS (SELECT w, n, xor(list_reduce({data}::BIGINT[], {step}, 4294967295::BIGINT), 4294967295) AS h FROM own),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN w[:(h % length(w))::INT] || w[(h % length(w) + 2)::INT:] ELSE w END AS w, n FROM told),
v AS MATERIALIZED (SELECT w AS word, sum(n)::BIGINT AS n FROM slipped WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (
  SELECT word, w[:i - 1] || '_' || w[i + 1:] AS p, w[:i - 1] || w[i + 1:] AS d FROM (SELECT word, word AS w, unnest(range(1, length(word) + 1)) AS i FROM v)
),
pair AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.p = b.p AND a.word <> b.word
  UNION SELECT word, d FROM cut JOIN v USING (word) WHERE d IN (SELECT word FROM v)
  UNION SELECT d, word FROM cut WHERE d IN (SELECT word FROM v)
),
best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(m := -v.n, b := b)) AS o FROM pair JOIN v ON v.word = b GROUP BY 1),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -o.m >= 2 * v.n THEN o.b END AS form, CASE WHEN -o.m >= 2 * v.n THEN -o.m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
),
path AS (SELECT word, word AS at_, 0 AS k FROM f UNION ALL SELECT p.word, f.form, k + 1 FROM path p JOIN f ON f.word = p.at_ WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(at_, k) FROM path p WHERE p.word = f.word) AS root, n, n_near, form_n FROM f"""


sql("op12_spelling", _spelling_sql())


@query
def op13_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), TOKENIZER)
    told = decode(ids, TOKENIZER)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return told.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
