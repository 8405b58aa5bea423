"""One query per operator over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sprintloom.llm import (
    chat, decontamination, exact_dedup, language_id, packing, periodic_runs, recurrent_lm, sharding, simhash, token_counts,
    url_filter, vector_codes, warc)
from sprintloom.llm.common import id_remainder, table
from sprintloom.session import shared_dir, written


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their word counts and then with BPE counts as a second tokenizer version.
    A third batch revises the word counts, which now include an end token per document, and deletes the BPE
    counts of toxic documents. The second batch is sent twice."""
    counts = written(token_counts.count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    none = F.lit(None).cast("long")
    insert = lambda version, tokens: counts.select(
        F.lit("insert").alias("change"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), none.alias("old_tokens"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    removed = counts.join(toxic, "doc_id", "left_semi").select(
        F.lit("delete").alias("change"), "source", "lang", F.lit(token_counts.BPE).alias("tokenizer"), F.col("bpe_tokens").alias("tokens"), none.alias("old_tokens"))
    with_end = counts.select(F.lit("revise").alias("change"), "source", "lang", F.lit(token_counts.WORDS).alias("tokenizer"),
                             (F.col("words") + 1).alias("tokens"), F.col("words").alias("old_tokens"))
    rollup = token_counts.Rollup(spark, shared_dir(spark, "rollup"))
    rollup.commit("words", insert(token_counts.WORDS, "words"))
    for _ in range(2):
        rollup.commit("bpe", insert(token_counts.BPE, "bpe_tokens"))
    rollup.commit("corrections", removed.union(with_end))
    return rollup.totals()


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 4) == 2
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(written(chat.segments(given.union(extra)), "chat"))


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 1)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic_runs.repeat_tail))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of capture; their ids as seconds stand for it. Rows come in the order of the merged index."""
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_recurrent_lm": op10_recurrent_lm,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}

def _url_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.host)}, {quoted(r.path)}, {quoted(r.verdict)})" for r in url_filter.HOST_RULES)
    patterns = ", ".join(f"({quoted(r.name)}, {quoted(r.verdict)}, {quoted(url_filter.regex_of(r.pattern))})" for r in url_filter.PATTERN_RULES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH rules(host, path, verdict) AS (VALUES {rules}), patterns(name, verdict, regex) AS (VALUES {patterns}),
        parsed AS (
            SELECT page_id, coalesce(url, '') AS url,
                   {low.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        own AS (
            SELECT page_id, max({{'size': length(r.host) + length(r.path), 'name': r.host || r.path, 'verdict': r.verdict}}) AS r
            FROM parsed p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY page_id),
        found AS (
            SELECT page_id, string_agg(m.name, ',' ORDER BY m.name) AS patterns, bool_or(m.verdict = 'allow') AS allowed,
                   bool_or(m.verdict = 'block') AS blocked
            FROM parsed p JOIN patterns m ON regexp_matches({low.format("p.url")}, m.regex) GROUP BY page_id)
        SELECT page_id, host, path, r.name AS rule, coalesce(patterns, '') AS patterns,
               coalesce(r.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
        FROM parsed LEFT JOIN own USING (page_id) LEFT JOIN found USING (page_id)"""


def _codes_sql() -> str:
    """Vectors of 64 components: 16 parts of 4."""
    places = range(4)
    far = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in places)
    xs = ", ".join(f"x{i}" for i in places)
    rounds, book = "", "book0"
    for n in range(1, vector_codes.ROUNDS + 2):
        rounds += f""",
        given{n} AS MATERIALIZED (
            SELECT p.vec_id, p.part, min({{'far': {far}, 'entry': c.entry}}) AS best
            FROM parts p JOIN {book} c USING (part) GROUP BY p.vec_id, p.part)"""
        if n <= vector_codes.ROUNDS:
            means = ", ".join(f"CAST(floor(sum(p.x{i}) / count(*)) AS BIGINT) AS x{i}" for i in places)
            old = ", ".join(f"coalesce(m.x{i}, c.x{i}) AS x{i}" for i in places)
            rounds += f""",
        book{n} AS MATERIALIZED (
            SELECT part, entry, {old} FROM {book} c LEFT JOIN (
                SELECT part, g.best.entry AS entry, {means} FROM given{n} g JOIN parts p USING (vec_id, part) GROUP BY ALL) m USING (part, entry))"""
            book = f"book{n}"
    last = vector_codes.ROUNDS + 1
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, part, {", ".join(f"CAST(floor(256 * v[4 * part + {i + 1}]) AS BIGINT) AS x{i}" for i in places)}
            FROM kept, (SELECT unnest(range({vector_codes.PARTS})) AS part)),
        book0 AS MATERIALIZED (
            SELECT part, entry, {xs} FROM parts JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {vector_codes.ENTRIES}){rounds},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error
            FROM given{last} GROUP BY vec_id),
        whole AS (SELECT sha256(string_agg(concat_ws(',', {xs}), ',' ORDER BY part, entry)) AS sha FROM {book})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id), whole"""


ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_sharding": f"""
        WITH hashed AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS bytes, row_number() OVER () AS row,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
                        || substr(md5(coalesce(text, '')), 1, 7) AS BIGINT) AS hash
            FROM documents),
        sized AS (
            SELECT *, hash >> (60 - depth) AS prefix, sum(bytes) OVER same AS shard_bytes, count(*) OVER same AS shard_docs
            FROM hashed, (SELECT CAST(unnest(range(61)) AS INTEGER) AS depth) WINDOW same AS (PARTITION BY depth, hash >> (60 - depth)))
        SELECT doc_id, hash, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
               shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes <= {sharding.LIMIT} AS fits
        FROM sized WHERE shard_bytes <= {sharding.LIMIT} OR depth = 60
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1""",
    "op7_url_filter": _url_sql(),
    "op9_chat": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                   sum(13 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g'))) AS chars
            FROM rows GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(chars AS BIGINT) AS formatted_chars FROM whole""",
    "op12_vector_codes": _codes_sql(),
    "op13_warc": f"""
        SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN shared AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN shared AND page_id <> last THEN last END AS refers_to
        FROM (SELECT page_id, payload, strlen(payload) >= {warc.LEAST_SHARED} AS shared, max(page_id) OVER (PARTITION BY payload) AS last
              FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))""",
}
