"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.chat import format_chats
from folioquery.llm.hilbert import nearest
from folioquery.llm.labelled import fold
from folioquery.llm.line_dedup import drop_repeated_lines
from folioquery.llm.maxscore import top_k
from folioquery.llm.mixing import plan_mix
from folioquery.llm.pieces import encode_documents
from folioquery.llm.quality import fit_quality, score_quality
from folioquery.llm.sharding import pack_shards
from folioquery.llm.simhash import simhash_groups
from folioquery.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(_table(spark, sf_dir, "documents"), budget_percent=60)
    return plan.select("domain", "lang", "source", "doc_id", "n_tokens", "leaf_budget", F.explode("epochs").alias("epoch"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(_table(spark, sf_dir, "documents"), 8)


def piece_model() -> str:
    """The model file of the production query; the package that names it is no dependency of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, piece_model()).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), width=3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_top_k": op2_top_k,
    "op3_source_mix": op3_source_mix,
    "op4_chat_format": op4_chat_format,
    "op5_shards": op5_shards,
    "op6_pieces": op6_pieces,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_nearest": op10_nearest,
}


def _fill_sql(source: str, parents: str, name: str, given: str) -> str:
    """One level of the budget tree over rows with cap, weight and the parent's budget."""
    by = f"PARTITION BY {parents}"
    line = f"{by} ORDER BY cap::DOUBLE / weight, {name}"
    return f"""
    SELECT *, a + CASE WHEN f = 0 AND row_number() OVER ({by}, f ORDER BY {name}) <= b - sum(a) OVER ({by}) THEN 1 ELSE 0 END AS alloc
    FROM (SELECT *, CASE WHEN f = 1 THEN cap ELSE (weight * (b - coalesce(sum(cap) FILTER (f = 1) OVER ({by}), 0)))
                      // nullif(coalesce(sum(weight) FILTER (f = 0) OVER ({by}), 0), 0) END AS a
          FROM (SELECT *, min(f0) OVER ({line} ROWS UNBOUNDED PRECEDING) AS f
                FROM (SELECT *, CASE WHEN cap * (w_all - w_before) <= weight * (b - c_before) THEN 1 ELSE 0 END AS f0
                      FROM (SELECT *, least({given}, sum(cap) OVER ({by})) AS b, sum(weight) OVER ({by}) AS w_all,
                                   coalesce(sum(cap) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
                                   coalesce(sum(weight) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
                            FROM ({source})))))"""


_CAPS = "sum(cap)::HUGEINT AS cap"
_DOMAINS = _fill_sql(
    "SELECT domain, 0 AS root, CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END::HUGEINT AS weight, "
    f"{_CAPS} FROM leaves GROUP BY domain",
    "root",
    "domain",
    "(SELECT sum(tokens) * 60 // 100 FROM leaves)",
)
_LANGS = _fill_sql(
    "SELECT l.domain, l.lang, CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::HUGEINT AS weight, "
    f"sum(l.cap)::HUGEINT AS cap, any_value(d.alloc) AS given FROM leaves l JOIN domains d ON l.domain = d.domain GROUP BY l.domain, l.lang",
    "domain",
    "lang",
    "given",
)
_SOURCES = _fill_sql(
    "SELECT l.domain, l.lang, l.source, 1::HUGEINT AS weight, l.cap, l.tokens, p.alloc AS given "
    "FROM leaves l JOIN langs p ON l.domain = p.domain AND l.lang = p.lang",
    "domain, lang",
    "source",
    "given",
)

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
    WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    hot AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    flagged AS (SELECT keyed.doc_id, pos, line, hot.keep IS NOT NULL AND hot.keep <> keyed.doc_id AS gone
                FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM flagged GROUP BY doc_id""",
    "op2_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op3_source_mix": f"""
    WITH units AS (SELECT 'domain' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 4)::VARCHAR AS domain,
                          lang, source, doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 4 * sum(n_tokens)::HUGEINT AS cap FROM units GROUP BY ALL),
    domains AS ({_DOMAINS}), langs AS ({_LANGS}), sources AS ({_SOURCES}),
    plan AS (SELECT domain, lang, source, alloc, alloc // tokens AS whole, alloc % tokens AS rest FROM sources),
    drawn AS (SELECT u.*, p.alloc::BIGINT AS leaf_budget, p.whole, p.rest, md5('42:' || p.whole || ':' || u.doc_id) AS h
              FROM units u JOIN plan p ON u.domain = p.domain AND u.lang = p.lang AND u.source = p.source),
    ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS tail FROM drawn)
    SELECT domain, lang, source, doc_id, n_tokens, leaf_budget,
           unnest(generate_series(0, (whole - CASE WHEN tail THEN 0 ELSE 1 END)::BIGINT)) AS epoch
    FROM ranked""",
    "op4_chat_format": """
    WITH c AS (SELECT conv_id, count(*) AS n,
                      list('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) ORDER BY turn) AS ts
               FROM conversations GROUP BY conv_id)
    SELECT a.conv_id, a.n AS n_turns, array_to_string(a.ts, '') AS rendered FROM c a
    WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.ts[1] = a.ts[1] AND list_slice(b.ts, 1, a.n) = a.ts
                      AND (b.n > a.n OR (b.n = a.n AND b.conv_id < a.conv_id)))""",
}
