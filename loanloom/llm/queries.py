"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import (
    additive,
    byte_gru,
    curriculum,
    debruijn,
    decontam,
    elias_fano,
    golay,
    multi_index,
    noisy_or,
    piece_codec,
    resample,
    rotation,
    wrapper,
)
from loanloom.llm.common import bucket_of, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Least score of a document that counts as toxic.
TOXIC = 0.3
#: Weights over the training of the first, second, third source, and so on in turn: they amount to
#: 5, 2 and 1; large sources fade, small ones grow.
SCHEDULES = (((0, 7.5), (1, 2.5)), ((0, 2), (1, 2)), ((0, 0.5), (1, 1.5)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(
        table(spark, sf_dir, "documents"), PIECE_MODEL, ("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def _held_out(n: int, remainder: int):
    """Whether a document's labels are kept back; a null id is not."""
    return F.coalesce(bucket_of("doc_id", n) == remainder, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_gru.fit(docs.where(bucket_of("doc_id", 5) != 0))
    return byte_gru.predict(docs, net).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.drop_repeats(
        table(spark, sf_dir, "documents"), 20, ("n_words", "n_removed", "kept_sha256")
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(bucket_of("doc_id", 4) != 2)


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = noisy_or.fit(docs, training_labels(spark, sf_dir))
    return _scored(noisy_or.score(docs, model), TOXIC)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay.near_groups(table(spark, sf_dir, "documents"), shingle=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = additive.fit(docs, training_labels(spark, sf_dir))
    return _scored(additive.score(docs, model), 0.7)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = elias_fano.write_token_files(docs, WORD_TOKENIZER, 2, elias_fano.new_folder(docs))
    return elias_fano.read_token_files(files, ("ids_crc32",))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return rotation.fill_in_middle(table(spark, sf_dir, "documents"), wanted)


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their share of the mix; position: when training first meets one, null if never."""
    mixed = curriculum.mix(table(spark, sf_dir, "documents"), SCHEDULES)
    first = F.when(F.size("times") > 0, F.col("times")[0])
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_main_text": op2_main_text,
    "op3_language": op3_language,
    "op4_embeddings": op4_embeddings,
    "op5_substrings": op5_substrings,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixture": op12_mixture,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op4_embeddings": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
              ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.95
        ), reached AS (
            SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
        ), least AS (
            SELECT a, min(b) AS b FROM reached GROUP BY a
        ), counted AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
               least(vec_id, coalesce(least.b, vec_id)) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
    """,
    "op9_decontamination": r"""
        WITH items AS (
            SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k
            FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark)
            WHERE len(w) > 0
        ), bags AS (
            SELECT item_id, n, k, said, count(*) AS wanted
            FROM (SELECT item_id, n, k, array_to_string(w[s : s + k - 1], ' ') AS said
                  FROM (SELECT *, unnest(range(1, n - k + 2)) AS s FROM items))
            GROUP BY ALL
        ), docs AS (
            SELECT doc_id, w, len(w) AS size
            FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents)
        ), places AS (
            SELECT doc_id, size, k, s, array_to_string(w[s + 1 : s + k], ' ') AS said
            FROM (SELECT docs.*, k, unnest(range(0, size - k + 1)) AS s
                  FROM docs JOIN (SELECT DISTINCT k FROM items) ON size >= k)
        ), hits AS (
            SELECT doc_id, size, item_id, n, bags.k, s, said, wanted FROM places JOIN bags USING (k, said)
        ), windows AS (
            SELECT doc_id, item_id, n, size, k, said, wanted,
                   unnest(if(size < n, [0], range(greatest(0, s - n + k), least(s, size - n) + 1))) AS start
            FROM hits
        ), shared AS (
            SELECT doc_id, item_id, n, size, k, start, sum(least(found, wanted)) AS common
            FROM (SELECT doc_id, item_id, n, size, k, start, said, wanted, count(*) AS found FROM windows GROUP BY ALL)
            GROUP BY ALL
        ), alike AS (
            SELECT doc_id, item_id, start,
                   common::DOUBLE / ((n - k + 1) + (least(n, size) - k + 1) - common)::DOUBLE AS similarity
            FROM shared
        )
        SELECT doc_id, item_id, similarity, start FROM alike WHERE similarity >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
    """,
    "op5_substrings": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS said
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
        ), later AS (
            SELECT doc_id, s FROM windows
            QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, s) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
        ), kept AS (
            SELECT doc_id, i, word
            FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words)
            ANTI JOIN gone USING (doc_id, i)
        ), joined AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said FROM kept GROUP BY doc_id
        )
        SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(said, '')) AS kept_sha256
        FROM words LEFT JOIN joined ON words.doc_id = joined.doc_id
    """,
    "op11_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, t, len(w) AS n, w, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS h
            FROM (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
                  FROM documents)
        ), cut AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h[3] % 100 >= 50 THEN 'plain'
                        WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (
            SELECT doc_id, n, form, t, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m,
                   array_to_string(w[b + 1 : n], '') AS s
            FROM cut
        )
        SELECT doc_id, n::BIGINT AS n, form,
               if(form = 'plain', NULL, length(p))::BIGINT AS prefix_chars,
               if(form = 'plain', NULL, length(m))::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op12_mixture": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1 : 15])::BIGINT AS draw
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
            FROM docs GROUP BY source
        ), weighed AS (
            SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM sources
        ), rounds AS (
            SELECT 0 AS round, source, kind, source_size, weight, most, false AS is_full FROM weighed
            UNION ALL
            SELECT round + 1, source, kind, source_size, weight, most, is_full OR weight * words > most * open
            FROM (SELECT *, sum(source_size::DOUBLE) OVER () - sum(if(is_full, most, 0)) OVER () AS words,
                         sum(if(is_full, 0, weight)) OVER () AS open
                  FROM rounds WHERE round <= (SELECT count(*) FROM weighed))
        ), targets AS (
            SELECT source, kind, source_size,
                   if(is_full, most, least(most, (sum(source_size::DOUBLE) OVER () - sum(if(is_full, most, 0)) OVER ())
                                                 * weight / sum(if(is_full, 0, weight)) OVER ())) AS target
            FROM rounds WHERE round = (SELECT max(round) FROM rounds)
        ), placed AS (
            SELECT doc_id, size, source_size, target, kind, floor(target)::BIGINT AS demand,
                   (sum(size) OVER (PARTITION BY docs.source ORDER BY draw, doc_id NULLS LAST, size
                                    ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
            FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
        ), counted AS (
            SELECT *, if(size > 0, demand // source_size, 0) AS passes,
                   if(size > 0, greatest(0, least(size, demand % source_size - before)), 0) AS over FROM placed
        ), timed AS (
            SELECT *, if(passes * size + over > 0, before::DOUBLE / target, NULL) AS part FROM counted
        )
        SELECT doc_id, size, source_size, target, (passes * size + over)::BIGINT AS taken,
               CASE WHEN part IS NULL THEN NULL WHEN part = 0 THEN 0.0::DOUBLE WHEN kind = 1 THEN 2.0 * (part * 2.0) / (2.0 + sqrt(4.0 + 0.0 * part))
                    WHEN kind = 0 THEN 2.0 * (part * 5.0) / (7.5 + sqrt(56.25 + -10.0 * (part * 5.0)))
                    ELSE 2.0 * (part * 1.0) / (0.5 + sqrt(0.25 + 2.0 * (part * 1.0))) END::DOUBLE AS position
        FROM timed
    """,
}
