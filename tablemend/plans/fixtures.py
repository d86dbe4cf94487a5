"""Labelled dirty tables derived from a star schema, for tests, benchmarks and the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.functions.expr import key_hash, time_text, uniform
from tablemend.operators import inject
from tablemend.operators.domains import domain
from tablemend.session import merge_if_large
from tablemend.sources.tables import bind_observed, read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out by their id: a table of few bytes is read by one task, whatever its rows cost afterwards."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")


def lineitem_id():
    return key_hash("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date"))).alias("row_id")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, part, source, claim, truth): suppliers' claims of a part's type, wrong at a rate of their own."""
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem").select(lineitem_id(), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source"))
    base = line.join(part.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("truth")), "part")
    options = domain(part, ["p_type"])
    rate = 0.05 + 0.4 * uniform("rate", "source")
    dirty = inject.swaps(base, "truth", "claim", options, rate)
    return dirty.select("row_id", "part", "source", "claim", "truth")


def claims_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, part, source, kind, brand, true_kind, true_brand): claims of two fields, wrong at their source's rate."""
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem").select(lineitem_id(), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source"))
    truth = merge_if_large(part.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("true_kind"), F.col("p_brand").alias("true_brand")))
    out = line.join(truth, "part")
    for name, column in (("kind", "p_type"), ("brand", "p_brand")):
        out = inject.swaps(out, f"true_{name}", name, domain(part, [column]), 0.05 + 0.4 * uniform("rate", "source"))
    return out.select("row_id", "part", "source", "kind", "brand", "true_kind", "true_brand")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings: a mistyped place within a key, area and kind missing at times, an amount partly in thousands."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_brand").alias("key"), F.col("p_name").alias("true_place"), F.col("p_type").alias("true_area"),
        F.col("p_size").cast("string").alias("true_kind"), F.col("p_retailprice").alias("true_amount"))
    df = table(spark, sf_dir, "lineitem").select(lineitem_id(), F.col("l_partkey").alias("part")).join(merge_if_large(part), "part")
    df = inject.missing(inject.missing(inject.typos(df, "true_place", "place"), "true_area", "area", 0.15), "true_kind", "kind", 0.1)
    df = inject.units(df, "true_amount", "amount", 0.001, 0.2, 5)
    return df.select("row_id", "key", "place", "area", "kind", "amount", *[f"true_{c}" for c in ("place", "area", "kind", "amount")])


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, part, noisy, shown, truth): noisy readings of a part's price, some in thousands."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("truth"))
    line = table(spark, sf_dir, "lineitem").select(lineitem_id(), F.col("l_partkey").alias("part"))
    noisy = inject.noise(line.join(part, "part"), "truth", "noisy", 10.0)
    return inject.units(noisy, "noisy", "shown", 0.001, 0.2, 5).select("row_id", "part", "noisy", "shown", "truth")


def parts_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with mistyped names and missing types, and their clean values."""
    part = spread(bind_observed(table(spark, sf_dir, "part"), ["p_partkey"]).select("row_id", "p_name", "p_type", "p_brand"))
    typed = inject.typos(part, "p_name", "dirty_name")
    gone = inject.missing(typed, "p_type", "dirty_type", 0.15)
    return gone.select(
        "row_id", F.col("dirty_name").alias("p_name"), F.col("dirty_type").alias("p_type"), "p_brand",
        F.col("p_name").alias("clean_name"), F.col("p_type").alias("clean_type"),
    )


def customers_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region spelled out, nation and segment mistyped, regions missing."""
    cust = bind_observed(table(spark, sf_dir, "customer"), ["c_custkey"])
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    flat = (
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("row_id", "c_name", F.col("c_mktsegment").alias("true_segment"), F.col("n_name").alias("true_nation"), F.col("r_name").alias("true_region"))
    )
    flat = inject.typos(spread(flat), "true_segment", "segment")
    flat = inject.typos(flat, "true_nation", "nation")
    flat = inject.missing(flat, "true_region", "region", 0.1)
    return flat.select("row_id", "c_name", "segment", "nation", "region", "true_segment", "true_nation", "true_region")


def markets_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segment, nation and region, each mistyped or missing, and the truth."""
    flat = customers_flat(spark, sf_dir).select("row_id", "true_segment", "true_nation", "true_region")
    for c in ("segment", "nation", "region"):
        flat = inject.missing(inject.typos(flat, f"true_{c}", f"typed_{c}"), f"typed_{c}", c, 0.1).drop(f"typed_{c}")
    return flat.select("row_id", "segment", "nation", "region", "true_segment", "true_nation", "true_region")


def suppliers_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, s_name, country, true_nation): suppliers with a mistyped nation and no region."""
    s = bind_observed(table(spark, sf_dir, "supplier"), ["s_suppkey"])
    named = s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("row_id", "s_name", F.col("n_name").alias("true_nation"))
    return inject.typos(named, "true_nation", "country").select("row_id", "s_name", "country", "true_nation")


def nations(spark: SparkSession, sf_dir: str, flat: DataFrame | None = None) -> DataFrame:
    """The clean entity table (entity_id, nation, region), with ``n`` records naming each exactly if ``flat`` is given."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key_hash("n_name", "r_name").alias("entity_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
    if flat is None:
        return out
    counts = flat.groupBy("nation").agg(F.count("*").alias("n"))
    return out.join(counts, "nation").select("entity_id", "nation", "region", "n")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, first, middle, last, shown): two-word part names with the type between them, partly abbreviated."""
    part = bind_observed(table(spark, sf_dir, "part"), ["p_partkey"])
    base = part.select(
        "row_id", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.col("p_type").alias("middle"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last"),
    )
    return inject.name_forms(base, "first", "middle", "last", "shown")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, time_text): times of day as text, some malformed."""
    ev = table(spark, sf_dir, "events").select(key_hash("event_id").alias("row_id"), time_text("ts").alias("t"))
    u = uniform("malformed", "row_id")
    broken = F.when(u < 0.05, F.replace("t", F.lit("."), F.lit(""))).when(u < 0.1, F.replace("t", F.lit(":"), F.lit("."))).otherwise(F.col("t"))
    return ev.select("row_id", broken.alias("time_text"))


def langs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, shown): language codes of documents, mistyped; the shortest values of all."""
    docs = bind_observed(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])
    return inject.typos(docs, "lang", "shown").select("row_id", "shown")


def urls_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, url, shown): page addresses and their mistyped form; long values."""
    pages = bind_observed(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"])
    return inject.typos(pages, "url", "shown").select("row_id", "url", "shown")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return docs.unionByName(table(spark, sf_dir, "benchmark").select("text"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part spelled out: number sometimes missing, texts mistyped, and the truth."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_partkey").cast("string").alias("true_number"),
        F.col("p_name").alias("true_name"), F.col("p_brand").alias("true_brand"), F.col("p_type").alias("true_type"))
    line = table(spark, sf_dir, "lineitem").select(lineitem_id(), F.col("l_partkey").alias("part"))
    df = inject.missing(line.join(merge_if_large(part), "part"), "true_number", "number", 0.1)
    for c in ("name", "type"):
        df = inject.typos(df, f"true_{c}", c)
    df = inject.missing(df, "true_brand", "brand", 0.1)
    truth = [f"true_{c}" for c in ("number", "name", "brand", "type")]
    return df.select("row_id", "number", "name", "brand", "type", *truth)
