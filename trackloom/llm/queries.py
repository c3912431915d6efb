"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import quality_rules as q

    book = q.ledger(_docs(spark, sf_dir))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~q.passes(q.BASE)).alias("base_failed"), (q.passes(q.BASE) & q.passes(q.STRICT)).alias("kept"), "failure_bits", q.kept_without(q.STRICT).alias("kept_without"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import simhash_dedup as q

    found = q.near_duplicates(_docs(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import decontaminate as q

    found = q.leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_compared").cast("long"), F.col("n_equal").cast("long"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import pii as q

    return q.pseudonyms(_docs(spark, sf_dir), key=q.DEMO_KEY)


def op4_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trackloom.llm import token_output as q
    from trackloom.llm.common import fresh_path

    shards = q.write_sequences(_docs(spark, sf_dir), fresh_path(spark, "sequences"), public_tokenizers.path("word_bpe_49k.json"))
    return q.read_documents(shards).withColumnRenamed("id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trackloom.llm import packing as q

    _, placed = q.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select(F.col("id").alias("doc_id"), "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import html_extract as q

    found = q.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import quality_classifier as q
    from trackloom.llm.language_id import held_out

    docs = _docs(spark, sf_dir)
    found = q.score(docs, q.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import language_id as q

    docs = _docs(spark, sf_dir)
    found = q.predict(docs, q.fit_documents(docs))
    return found.select(F.col("id").alias("doc_id"), q.held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import secret_scan as q

    found = q.scan(_docs(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import mixing as q

    found = q.copies(_docs(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import conversation_repair as q

    return q.repair(q.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import lexical_search as q

    found = q.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {
    "op11_source_mix": op11_source_mix,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
    "op1_secret_scan": op1_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op10_language_id": op10_language_id,
    "op2_main_text": op2_main_text,
    "op4_arrow_output": op4_arrow_output,
    "op8_packing": op8_packing,
    "op6_decontaminate": op6_decontaminate,
    "op9_pii": op9_pii,
    "op7_simhash": op7_simhash,
    "op5_quality_rules": op5_quality_rules,
}

ORACLE_SQL = {
    # ranks in one window for each source
    "op11_source_mix": r"""
WITH s AS (SELECT doc_id, coalesce('0' || source, '1') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT k, sum(size)::BIGINT AS source_size FROM s GROUP BY k),
w AS (SELECT k, source_size, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (SELECT k, source_size, weight, cap, cap / weight AS ratio,
        ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
g AS (SELECT k, source_size, coalesce(least(cap, max(level) FILTER (level < ratio) OVER () * weight), cap) AS target,
        ('0x' || substr(md5('11:' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM l),
r AS (SELECT doc_id, k, size, row_number() OVER (PARTITION BY k ORDER BY size, doc_id NULLS FIRST) AS n FROM s)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE floor(u + target / source_size * n) - floor(u + target / source_size * (n - 1)) END * size)::BIGINT AS taken FROM r JOIN g USING (k)
""",
    # every term of every document, joined with every item's terms
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
i AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM benchmark)),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
    # every shift of every item along every document, without seeds: shifts with enough equal words
    "op6_decontaminate": r"""
WITH b AS (SELECT min(item_id) AS item_id, t, len(t) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM benchmark) WHERE len(t) > 0 GROUP BY t),
d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents)),
bw AS (SELECT item_id, n, unnest(t) AS word, unnest(range(1, n + 1)) AS q FROM b),
dw AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
h AS (SELECT r, item_id, p - q AS shift FROM dw JOIN bw USING (word) GROUP BY r, item_id, p - q, n HAVING count(*) >= CASE WHEN n < 8 THEN n ELSE ceil(0.8 * least(13, n)) END),
e AS (SELECT r, doc_id, item_id, shift, t, w, unnest(range(greatest(1, 1 - shift), least(n, len(w) - shift) + 1)) AS p, least(13, n) AS k FROM h JOIN d USING (r) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, k, sum((t[p] = w[p + shift])::INT) OVER win AS n, count(*) OVER win AS c FROM e
      WINDOW win AS (PARTITION BY r, item_id, shift ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
s2 AS (SELECT doc_id, item_id, k, n FROM s WHERE k = 13 AND c = 13
       UNION ALL SELECT doc_id, item_id, k, sum((t[p] = w[p + shift])::INT) FROM e WHERE k < 13 GROUP BY r, doc_id, item_id, shift, k HAVING count(*) = k)
SELECT doc_id, item_id, k::BIGINT AS n_compared, max(n)::BIGINT AS n_equal FROM s2 GROUP BY doc_id, item_id, k HAVING max(n) >= CASE WHEN k < 8 THEN k ELSE ceil(0.8 * k) END
""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) t(j) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS c,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, coalesce(c, 0) AS word_chars FROM m),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 100 * n_upper > 30 * word_chars THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END) AS bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failure_bits,
       (CASE WHEN bits = 0 THEN 63 WHEN bits & (bits - 1) = 0 THEN bits ELSE 0 END)::BIGINT AS kept_without FROM f
""",
}
