"""The operators as registered queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitgrain.llm import (
    bpe, centroids, decontaminate, pii, quality, resharding, secrets, simhash, token_counts, token_frames, topk, url_filter,
    whitening,
)
from visitgrain.llm.common import pick, read_table, settle
from visitgrain.sources.fs import new_folder

#: A score from which a document counts as good.
GOOD = 0.7
#: Old shards that the documents are taken to stand in, dealt by source.
OLD_SHARDS = 8
SHARDS = 8


def _joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of an array of spans, comma-joined; only the given kinds."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _digest(found: DataFrame, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    """The counts and digests that stand for a document's spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, kinds),
        F.sha2(_joined(spans, kinds).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.scan_secrets(read_table(spark, sf_dir, "documents")), "secrets", secrets.BASE_KINDS)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return quality.score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    old = (F.crc32(F.col("source").cast("string").cast("binary")) % OLD_SHARDS).cast("int")
    made = resharding.assignments(
        docs, spark, old, new_folder(spark, "shards"), SHARDS, shard_columns=("source",)
    )
    return made.select(
        "doc_id", "size", "text_crc32", F.lit(resharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), spark, radius=2, segments=2)
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, whole=False)


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_frames.write_frames(
        read_table(spark, sf_dir, "documents"), spark, new_folder(spark, "tokens"), path, end_id=2
    )
    return token_frames.read_frames(manifest, whole=False)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, F.col("id") % 100 == 0, spark, k=10, scale=1024)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.find_items(docs, benchmark, spark).select(
        "doc_id", "item_id", "shared", "size", F.round(F.col("shared") / F.col("size"), 6).alias("containment")
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.scan_pii(read_table(spark, sf_dir, "documents")), "pii", pii.BASE_KINDS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: every document comes; exact copies go; documents that are not in
    English are counted anew under the vocabulary for many languages. The last batch is sent twice.

    Of rows with one text, null being the empty one, that with the least id stays; without ids, the
    least by source and language."""
    one, many = "byte_bpe_50k", "byte_bpe_multi_50k"
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in (one, many)}
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source").withColumn(
        "text_hash", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    )
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    wanted = F.when(foreign, F.array(F.lit(one), F.lit(many))).otherwise(F.array(F.lit(one)))
    counted = settle(
        token_counts.count_tokens(
            docs, versions, public_tokenizers.PATTERN, ("doc_id", "lang", "source", "text_hash"), wanted
        ),
        spark,
        "counts",
    )
    # The row of each text with the least id, ids before none; combined before the shuffle, so that copies never meet.
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", F.map_entries("counts").alias("counts"))
    firsts = settle(
        counted.groupBy("text_hash").agg(F.min(least).alias("r"))
        .select("r.doc_id", "r.source", "r.lang", F.map_from_entries("r.counts").alias("counts")),
        spark,
        "firsts",
    )
    again = firsts.where(foreign)
    ledger = token_counts.Ledger(spark, new_folder(spark, "ledger"))
    ledger.commit("come", token_counts.signed(counted, 1, one))
    # What goes is all rows less the first ones; as totals, neither has to be told apart row by row.
    ledger.commit("copies-go", token_counts.signed(counted, -1, one).unionByName(token_counts.signed(firsts, 1, one)))
    revised = token_counts.signed(again, -1, one).unionByName(token_counts.signed(again, 1, many))
    for _ in range(2):
        ledger.commit("revised", revised)
    return ledger.totals()


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = centroids.clusters(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)
    return made


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), spark, most=16, scale=64, offset=1_000_000)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees learn from URLs labelled by words of their host; a quarter of the pages is held out."""
    pages = read_table(spark, sf_dir, "pages")
    label = url_filter.label_by_words(F.col("host"))
    model = url_filter.fit(pages, label, spark, learn=~held_out("page_id"))
    return url_filter.judge(pages, model)


QUERIES = {
    q.__name__: q
    for q in (
        op1_secret_scan,
        op2_quality_classifier,
        op3_resharding,
        op4_simhash_near_dedup,
        op5_bpe,
        op6_token_frames,
        op7_exact_top_k,
        op8_benchmark_decontamination,
        op9_pii,
        op10_token_counts,
        op11_centroid_clustering,
        op12_embedding_whitening,
        op13_url_filter,
    )
}

_ROUND = """, a{0} AS (
      SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT vec_id, v, row, c, CAST(list_sum([(z[1] - z[2]) ** 2 for z in list_zip(v, w)]) AS BIGINT) AS d
        FROM kept, c{0})
      GROUP BY vec_id, v, row)"""
_STEP = """, s{0} AS (
      SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{0}, unnest(range(1, 65)) AS t(i) GROUP BY c, i
    ), m{0} AS (
      SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{0} GROUP BY c
    ), c{1} AS (
      SELECT c, coalesce(m{0}.w, c{0}.w) AS w FROM c{0} LEFT JOIN m{0} USING (c))"""
_CLUSTERS = (
    """WITH kept AS (
      SELECT vec_id, row_number() OVER () AS row, [CAST(floor(64 * x::DOUBLE) AS BIGINT) for x in embedding] AS v
      FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64
    ), c0 AS (
      SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS c, v AS w FROM kept
      WINDOW w AS (ORDER BY sha256(concat('1:', vec_id)), v) QUALIFY row_number() OVER w <= 16)"""
    + "".join(_ROUND.format(i) + _STEP.format(i, i + 1) for i in range(3))
    + _ROUND.format(3)
    + """
    SELECT vec_id, c AS cluster, d AS distance,
      CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(w, ',')) AS centroid_sha256
    FROM a3 JOIN c3 USING (c)"""
)

ORACLES = {
    "op11_centroid_clustering": _CLUSTERS,
    "op7_exact_top_k": """
        WITH v AS (
          SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v
          FROM embeddings WHERE embedding IS NOT NULL
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op8_benchmark_decontamination": r"""
        WITH item_words AS (
          SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
        ), items AS (
          SELECT DISTINCT item_id, w[i : i + 4] AS s
          FROM item_words, unnest(range(1, len(w) - 3)) AS t(i)
        ), sizes AS (
          SELECT item_id, count(*) AS size FROM items GROUP BY item_id
        ), doc_words AS (
          SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, w[i : i + 4] AS s
          FROM doc_words, unnest(range(1, len(w) - 3)) AS t(i)
        ), met AS (
          SELECT doc_id, item_id, count(*) AS shared
          FROM shingles JOIN items USING (s) GROUP BY doc_id, item_id
        )
        SELECT doc_id, item_id, shared, size, round(shared / size, 6) AS containment
        FROM met JOIN sizes USING (item_id) WHERE shared >= 0.8 * size
    """,
}
