"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import alignment, ann, bpe, language_id, mixing, periodic_runs, pii, token_files, warc
from tablemend.llm.exact_dedup import group_equal
from tablemend.llm.licenses import scan
from tablemend.llm.ngram_join import join_similar
from tablemend.llm.substring_dedup import remove_repeats
from tablemend.session import scratch_path


PII_KEY = "a key for these tables only; keep a real one out of the code"
SHARE, EPOCHS, SEED = 0.9, 2, 7
TREE = mixing.Tree(
    levels=[
        ("domain", r"'domain' || pmod(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int), 3)"),
        ("lang", "lang"),
        ("source", "source"),
    ],
    weights={"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 6, "de": 2, "fr": 2}},
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.vocabulary(spark)
    return bpe.there_and_back(_documents(spark, sf_dir), ranks, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.identify(docs, language_id.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_equal(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir), PII_KEY)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    path = scratch_path(spark)
    token_files.write_ids(_documents(spark, sf_dir), model, path)
    return token_files.read_ids(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(vectors, F.col("vec_id") % 100 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), TREE, SHARE, EPOCHS, SEED)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = warc.resolved(warc.read_records(warc.written(spark, path), with_payload=False))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "problem")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = alignment.posting_blocks(_documents(spark, sf_dir), alignment.public_models())
    digests = F.transform("groups", lambda g: F.when(g != "", F.sha2(g.cast("binary"), 256)).otherwise(""))
    out = alignment.scored(blocks.withColumn("groups", digests))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of one document in ten made periodic from a word on, as crc32(doc_id) says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+", -1), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("_words"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.when(F.size("_words") > 0, F.size("_words")))
    rows = rows.withColumn("_at", (F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_period", (1 + F.floor((F.col("_n") - F.col("_at")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_at")
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_at") + 1, F.col("_period")), F.ceil(rest / F.col("_period")).cast("int")))
    periodic = F.concat_ws(" ", F.concat(F.slice("_words", 1, F.col("_at")), F.slice(again, 1, rest)))
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periods(_documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_ngram_join, op4_language_id, op5_exact_dedup, op6_license_scan, op7_pii, op8_token_files, op9_nearest, op10_mixing, op11_warc, op12_alignment, op13_periodic_runs)}

def _divided(node: str, parents: list[str], above: str) -> str:
    """SQL for one level of the budget: (parents, node, got) from (parents, given) in ``above``."""
    by = ", ".join(parents) or "1"
    names = "".join(f"{p}, " for p in parents)
    return f"""
        SELECT {names}{node}, CASE WHEN filled THEN can ELSE rest * upto // free - rest * (upto - weight) // free END AS given
        FROM (SELECT *, given - coalesce(sum(can) FILTER (filled) OVER (PARTITION BY {by}), 0)::HUGEINT AS rest,
                     coalesce(sum(weight) FILTER (NOT filled) OVER (PARTITION BY {by}), 1)::HUGEINT AS free,
                     coalesce(sum(weight) FILTER (NOT filled) OVER (PARTITION BY {by} ORDER BY {node}), 0)::HUGEINT AS upto
              FROM (SELECT *, can * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                              <= (given - coalesce(sum(can) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
                    FROM (SELECT {names}{node}, (sum(supply) * {EPOCHS})::HUGEINT AS can, {_weight(node)} AS weight FROM supply GROUP BY ALL)
                    {"JOIN " + above + " USING (" + by + ")" if parents else "CROSS JOIN " + above}
                    WINDOW w AS (PARTITION BY {by} ORDER BY can / weight, {node})))"""


def _weight(level: str) -> str:
    named = TREE.weights.get(level, {})
    whens = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in named.items())
    return f"CASE{whens} ELSE {TREE.other} END::HUGEINT" if whens else f"{TREE.other}::HUGEINT"


ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS body FROM documents)
        WINDOW w AS (PARTITION BY body)
    """,
    "op11_warc": """
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last
              FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
    """,
    "op10_mixing": rf"""
        WITH leaves AS (
            SELECT doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 3), '') AS domain,
                   coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS n_tokens
            FROM documents),
        supply AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM leaves GROUP BY ALL),
        total AS (SELECT least(floor(sum(supply) * {SHARE}::DOUBLE), sum(supply) * {EPOCHS})::HUGEINT AS given FROM supply),
        by_domain AS ({_divided("domain", [], "total")}),
        by_lang AS ({_divided("lang", ["domain"], "by_domain")}),
        by_source AS ({_divided("source", ["domain", "lang"], "by_lang")}),
        stream AS (
            SELECT l.*, epoch, given, (epoch - 1) * supply + sum(n_tokens) OVER (
                PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}|' || epoch || '|' || doc_id)) - n_tokens AS start
            FROM leaves l JOIN supply USING (domain, lang, source) JOIN by_source USING (domain, lang, source), range(1, {EPOCHS} + 1) e(epoch))
        SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens, least(n_tokens, given - start)::BIGINT AS n_taken
        FROM stream WHERE n_tokens > 0 AND start < given
    """,
}
