"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signal_engine.llm import ann, centroids, chat_format, decontaminate, html_extract, langid, license_scan, ngram_join, packing, periodic_runs, secret_scan, token_io, url_filter
from signal_engine.llm.common import Scratch

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op1"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "op2"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path(PIECES))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op7"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    manifest = token_io.write_tokens(table(spark, sf_dir, "documents"), scratch, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_io.read_tokens(spark, manifest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op9"), public_tokenizers.path(WORD_BPE), end_id=1, capacity=2048)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_trees(chat_format.chain(turns), Scratch(spark, "op10"))
    back = done.select("conv", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"), k=8, rounds=OP11_ROUNDS, seed=3)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents"), Scratch(spark, "op12")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant(table(spark, sf_dir, "documents"))))


OP11_ROUNDS = 10

OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.node = doc_id GROUP BY doc_id
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '(<)(\\*)(\|\w+\|>|/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])', '\1\4\2\5\\\3\6', 'g')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + 1 + n + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""




def _op11_sql() -> str:
    """Lloyd's rounds, one after the other, in integers."""
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::HUGEINT) AS p FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), p) - 1 AS j, p AS c FROM v QUALIFY j < 8)",
    ]
    near = "SELECT vec_id, p, j, d FROM (SELECT vec_id, p, j, list_sum(list_transform(list_zip(p, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::HUGEINT AS d FROM v, c{0}) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, j) = 1"
    for r in range(OP11_ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r)})",
            f"s{r} AS (SELECT j, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT j, unnest(p) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY j) USING (j))",
        ]
    return f"""WITH {", ".join(steps)}, z AS ({near.format(OP11_ROUNDS)})
SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN c{OP11_ROUNDS} USING (j)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_neighbours": op2_neighbours, "op3_html_text": op3_html_text, "op4_language_id": op4_language_id, "op5_license_scan": op5_license_scan, "op6_ngram_join": op6_ngram_join, "op7_url_filter": op7_url_filter, "op8_token_ids": op8_token_ids, "op9_packing": op9_packing, "op10_chat_format": op10_chat_format, "op11_centroids": op11_centroids, "op12_secrets": op12_secrets, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": OP6_SQL, "op10_chat_format": OP10_SQL, "op11_centroids": _op11_sql()}
