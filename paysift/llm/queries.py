"""The queries opN_* over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, ball_search, bpe_codec, collocations, conversation_repair, fingerprints, language, mixing, ngram_join, packing, suffix_dedup, token_counts, toxicity
from .common import fold, table


def vocabulary(name: str) -> str:
    """A public tokenizer file; the folder can be named by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    return language.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.ints, v.ints), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM sound q JOIN sound v ON q.vec_id <> v.vec_id AND len(q.ints) = len(v.ints) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal shares of all sources: (doc_id, source, copy, n_chars, text_md5)."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_copy").alias("copy"), "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP3_SQL = """
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, ((SELECT sum(n) FROM counted) / (SELECT count(*)::DOUBLE FROM counted)) * 1.0 / n AS rate FROM counted),
parts AS (SELECT source, rate, greatest(ceil(rate / 8), 1)::INTEGER AS parts FROM rated),
steps AS (SELECT source, parts, k, rate / parts AS share FROM parts, range(0, 65) AS r(k)),
logs AS (SELECT source, parts, k, sum(exp(-share) * share ** k / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS below FROM steps),
cdf AS (SELECT source, list(below ORDER BY k) AS below FROM logs WHERE k < 64 GROUP BY source),
draws AS (
  SELECT d.doc_id, d.source, d.n_chars, d.text, i.part,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '|17|' || i.part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) AS i(part)
),
counts AS (
  SELECT r.doc_id, r.source, r.n_chars, r.text, sum(len(list_filter(c.below, lambda b: r.u >= b)))::BIGINT AS n
  FROM draws r JOIN cdf c ON r.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT doc_id, source, copy::INTEGER AS copy, n_chars, md5(text) AS text_md5 FROM counts, range(0, n) AS g(copy)
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, set_id, n_links): five-word shingles, similarity of 0.8 or more."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links")


OP4_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS items FROM worded
),
keyed AS (SELECT doc_id, items, md5(array_to_string(items, '|')) AS set_key FROM shingled),
sets AS (SELECT set_key, min(doc_id) AS set_id, first(items) AS items, len(first(items)) AS n FROM keyed WHERE set_key IS NOT NULL GROUP BY set_key),
flat AS (SELECT set_id, n, unnest(items) AS item FROM sets),
shared AS (SELECT a.set_id AS a, b.set_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM flat a JOIN flat b ON a.item = b.item AND a.set_id < b.set_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE common::DOUBLE / (na + nb - common) >= 0.8),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
classes AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT k.doc_id, coalesce(c.class_id, s.set_id, k.doc_id) AS class_id, coalesce(s.set_id, k.doc_id) AS set_id, coalesce(m.n_links, 0)::BIGINT AS n_links
FROM keyed k LEFT JOIN sets s ON k.set_key = s.set_key LEFT JOIN classes c ON s.set_id = c.a LEFT JOIN counts m ON s.set_id = m.a
"""


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return attention_lm.score_texts(docs, fold("doc_id", 7) != 2, vocabulary("word_bpe_49k.json"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def labels_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of the label table in chain order: low quality, then toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, p_strongly_toxic, is_toxic) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, labels_by_category(spark, sf_dir)).drop("text")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"))


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's 2000 best phrases of two to four words."""
    return collocations.mine(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, 5)) AS m FROM worded),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM sized WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m > 1 AND n >= 30),
cut_at AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, min({'score': ((2000000::HUGEINT * c.a) // (h.n + t.n))::BIGINT, 'k': c.k, 'l': h.n, 'r': t.n}) AS best
  FROM cut_at c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f t ON c.lang = t.lang AND c.tail = t.phrase GROUP BY ALL
),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a FROM (SELECT lang, m, w, a, unnest(range(2, m)) AS s FROM candidates WHERE m > 2), range(1, 4) AS g(i) WHERE i + s - 1 <= m
),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY best.score DESC, a DESC, encode(s.phrase)) AS rank, s.phrase, a, best.l AS l, best.r AS r, t.n, best.score AS score
  FROM scored s JOIN totals t ON s.lang = t.lang LEFT JOIN longer g ON s.lang = g.lang AND s.phrase = g.phrase WHERE coalesce(100 * g.most < 80 * a, true)
)
SELECT * FROM ranked WHERE rank <= 2000
"""


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that the contract of op12 plants by crc32 of `conv_id:turn`."""
    shown = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = (F.crc32(shown) % 20).alias("fault")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault).where("fault <> 0")
    kind = F.col("fault")
    return marked.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every original conversation."""
    turns = table(spark, sf_dir, "conversations")
    report = conversation_repair.repair_report(damage(turns))
    ids = turns.select("conv_id").distinct().withColumn("conv", conversation_repair.conversation_key("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(report, "conv", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    vocabulary_file = vocabulary("word_bpe_49k.json")
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file).drop("text")
    return bpe_codec.decode(encoded, vocabulary_file).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_language_id, op2_top_inner_products, op3_mix_sources, op4_ngram_jaccard, op5_attention_lm, op6_pack_sequences, op7_order_minhash,
        op8_toxicity_chain, op9_repeated_bytes, op10_count_tokens, op11_collocations, op12_conversation_repair, op13_bpe_round_trip,
    )
}
SQL = {"op2_top_inner_products": OP2_SQL, "op3_mix_sources": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op11_collocations": OP11_SQL}
