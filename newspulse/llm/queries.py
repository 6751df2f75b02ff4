"""The registered queries of this subpackage and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newspulse.llm import decontam, exact_dedup, langid, licenses, lm, mixing, neardup, packing, periodic, quality, substrings, urlfilter, vectorcodes
from newspulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op2_stateful_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one that stays of their equals."""
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


ORACLES["op2_stateful_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""


@query
def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item found in it."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that occur elsewhere."""
    return substrings.remove(table(spark, sf_dir, "documents")).drop("text", "spans")


@query
def op5_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among all documents: 3-word shingles, 85 percent."""
    return neardup.cluster(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1, in training order."""
    return mixing.ordered(mixing.mix(table(spark, sf_dir, "documents")))


@query
def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query
def op11_scale_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after a tenth of them got one."""
    return periodic.digest(periodic.collapse(periodic.planted(table(spark, sf_dir, "documents"))))


@query
def op12_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 8 parts of 16 entries, 6 rounds."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The same codes by comparing every part with every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, entry, d FROM (
    SELECT r, part, entry, d, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS k FROM (
      SELECT x.r, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
      FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)) WHERE k = 1)""")
        steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m.v, b{k}.v) AS v FROM b{k} LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v
    FROM x JOIN a{k} USING (r, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 x AS MATERIALIZED (
  SELECT r, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, v FROM (
    SELECT r, len(embedding) AS n, generate_subscripts(embedding, 1) AS i,
           CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)),
 b0 AS MATERIALIZED (SELECT part, r AS entry, pos, v FROM x WHERE r < {entries}),
 {", ".join(steps[:-1])},
 codes AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
 FROM kept JOIN codes USING (r)"""


ORACLES["op12_gnat_codes"] = _codes_sql(vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.ROUNDS, vectorcodes.SCALE)


@query
def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)
