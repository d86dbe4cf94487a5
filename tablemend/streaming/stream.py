"""Online cleaning: records arrive in micro-batches and reuse all earlier state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemend.operators.candidates import meet, observed_keys, word_keys
from tablemend.operators.learn import error_counts, learn_py
from tablemend.operators.link import LinkModel, link, merge_new, on_tuple, scored_pairs, tuples
from tablemend.operators.spread import spread_join
from tablemend.session import cut_lineage, drop_table, is_written, scratch


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_error_counts(stream: DataFrame, observed: str, value: str, source: str) -> DataFrame:
    """Errors and matches per source so far; the state holds one row per source."""
    return stream.groupBy(source).agg(*error_counts(observed, value))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_error_rate(stream: DataFrame, observed: str, value: str, source: str, out: str) -> DataFrame:
    """Run to completion; each batch writes the sources it changed under its own id, so a
    replayed batch overwrites itself, and the newest row per source is the running count."""
    counts = running_error_counts(stream, observed, value, source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={batch_id}")

    drain(counts, write, f"{out}/checkpoint", "update")
    updates = counts.sparkSession.read.parquet(f"{out}/updates")
    latest = updates.groupBy(source).agg(F.max_by(F.struct("errors", "matches"), "batch").alias("s"))
    return latest.select(source, "s.*")


def stretches(n: int) -> list[tuple[int, int]]:
    """The batches before ``n`` in stretches of powers of two, longest first."""
    out, at = [], 0
    while at < n:
        out.append((at, at + (1 << (n - at).bit_length() - 1)))
        at = out[-1][1]
    return out


def replaced(n: int) -> list[tuple[int, int]]:
    """The stretches that the last one before ``n`` takes the place of."""
    at, end = stretches(n)[-1]
    return [x for x in stretches(n - 1) if x[0] >= at] + [(n - 1, n)] if end - at > 1 else []


class LinkStream:
    """Incremental linking with versioned state in the shared folder.

    Batch ``b`` writes ``links/batch=b``, ``added/batch=b`` (references gained per entity, new
    entities included) and ``keys/b-b+1``, the candidate keys of the names it added.  Every
    ``refresh`` batches the entity table is compacted to ``state/before=b`` and the entity-count
    prior re-estimated from it.  A batch lists the keys of its own records only and meets the
    stored ones; of the entities, those it met are brought up to date and the others are just
    read past.  Stretches of key tables merge by powers of two, so there are few at any time and
    each key is written again once per doubling of the number of batches.

    A replayed batch overwrites exactly what it wrote before.  What a committed batch replaced is
    dropped when the next one starts.
    """

    # The grid the refresh chooses from.
    STRENGTHS = (0.5, 1.0, 2.0, 4.0)
    DISCOUNTS = (0.0, 0.25, 0.5)

    def __init__(self, spark: SparkSession, model: LinkModel, entities: DataFrame, path: str, refresh: int = 2):
        self.spark, self.model, self.path, self.refresh = spark, model, path.rstrip("/"), refresh
        first = entities.select("entity_id", *model.fields, F.col("n").cast("long").alias("n"))
        self.schema = first.schema
        if not is_written(spark, f"{self.path}/keys/first"):  # else the stream goes on where it stopped
            first.write.mode("overwrite").parquet(f"{self.path}/state/before=0")
            self._keys(self._parts(0, 0)).write.mode("overwrite").parquet(f"{self.path}/keys/first")

    # --- entities

    def _base(self, batch_id: int) -> int:
        return batch_id - batch_id % self.refresh

    def _parts(self, base: int, batch_id: int) -> DataFrame:
        """Rows that add up to the entities as batch ``batch_id`` finds them."""
        read = self.spark.read.schema(self.schema)
        state = read.parquet(f"{self.path}/state/before={base}")
        added = [f"{self.path}/added/batch={b}" for b in range(base, batch_id)]
        return state.unionByName(read.parquet(*added)) if added else state

    def _merge(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("entity_id").agg(*[F.min(c).alias(c) for c in self.model.fields], F.sum("n").alias("n"))

    def _compacted(self, batch_id: int) -> DataFrame:
        """The rows of ``_parts``, after compaction if it is due."""
        base = self._base(batch_id)
        if base == batch_id and base > 0:
            self._merge(self._parts(base - self.refresh, base)).write.mode("overwrite").parquet(f"{self.path}/state/before={base}")
        return self._parts(base, batch_id)

    def entities(self, batch_id: int) -> DataFrame:
        """Entities and reference counts as batch ``batch_id`` finds them."""
        return self._merge(self._compacted(batch_id))

    def state(self) -> DataFrame:
        """Entities and reference counts after the last batch that was processed."""
        done = self.spark.read.parquet(f"{self.path}/links").agg(F.max("batch")).first()[0]
        return self.entities(0 if done is None else int(done) + 1)

    def prior(self, batch_id: int) -> LinkModel:
        """The model with the entity-count prior learned at the last compaction (two numbers)."""
        base = self._base(batch_id)
        if base == 0:
            return self.model
        best = learn_py(self._parts(base, base).where("n > 0"), self.STRENGTHS, self.DISCOUNTS).first()
        return replace(self.model, strength=best["strength"], discount=best["discount"])

    # --- candidate index

    def _keys(self, rows: DataFrame) -> DataFrame:
        return word_keys(rows.select(F.col(self.model.name).alias("word")), self.model.max_typos)

    def _read_keys(self, pieces: list[tuple[int, int]], *more: str) -> DataFrame:
        return self.spark.read.schema("word string, _v long").parquet(*more, *[f"{self.path}/keys/{a}-{b}" for a, b in pieces])

    def index(self, batch_id: int) -> DataFrame:
        """(word, _v) of all names that batch ``batch_id`` finds."""
        pieces = stretches(batch_id)
        if batch_id and replaced(batch_id):
            a, b = pieces[-1]
            self._read_keys(replaced(batch_id)).distinct().write.mode("overwrite").parquet(f"{self.path}/keys/{a}-{b}")
        return self._read_keys(pieces, f"{self.path}/keys/first")

    # --- batches

    def _drop_replaced(self, batch_id: int) -> None:
        """Drops what the batch before this one, committed by now, had replaced."""
        before = batch_id - 1
        if before < 1:
            return
        for a, b in replaced(before):
            drop_table(self.spark, f"{self.path}/keys/{a}-{b}")
        if self._base(before) == before:
            drop_table(self.spark, f"{self.path}/state/before={before - self.refresh}")
            for b in range(before - self.refresh, before):
                drop_table(self.spark, f"{self.path}/added/batch={b}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self._drop_replaced(batch_id)
        with scratch(self.spark):
            parts = self._compacted(batch_id)
            model = self.prior(batch_id)
            tups = cut_lineage(tuples(batch, model))
            shown = observed_keys(tups.select(F.col(model.name).alias("observed")), model.max_typos)
            pairs = cut_lineage(scored_pairs(meet(shown, self.index(batch_id), model.max_typos), model.max_typos))
            # Names stand in the rows that opened their entities only; references in all.
            met = parts.join(pairs.select(F.col("word").alias(model.name)).distinct(), model.name, "left_semi").select("entity_id").distinct()
            entities = cut_lineage(self._merge(parts.join(met, "entity_id", "left_semi")))
            decided = link(tups, entities, model, pairs, parts.select(F.sum("n")).scalar()).drop("score")
            linked = on_tuple(batch, decided, model).select("row_id", *model.fields, "entity_id", "is_new")
            path = f"{self.path}/links/batch={batch_id}"
            linked.write.mode("overwrite").parquet(path)
        links = self.spark.read.schema(linked.schema).parquet(path)
        opened = [F.min(F.when(F.col("is_new"), F.col(c))).alias(c) for c in model.fields]
        path = f"{self.path}/added/batch={batch_id}"
        added = links.groupBy("entity_id").agg(*opened, F.count("*").alias("n"))
        added.write.mode("overwrite").parquet(path)
        self._keys(self.spark.read.schema(added.schema).parquet(path)).write.mode("overwrite").parquet(f"{self.path}/keys/{batch_id}-{batch_id + 1}")

    def merged(self, links: DataFrame) -> DataFrame:
        """``links`` with near-equal entities that the stream opened as one: batches do not see each other's new
        entities before they are opened, so the same stranger may have come twice."""
        opened = links.where("is_new").groupBy(*self.model.fields).agg(F.count("*").alias("c"))
        mapped = merge_new(opened, self.model).groupBy("old_id").agg(F.min("entity_id").alias("_to"), F.sum("c").alias("_n"))
        out = spread_join(links.withColumnRenamed("entity_id", "old_id"), mapped, ["old_id"], "_n").drop("_n")
        return out.withColumn("entity_id", F.coalesce("_to", "old_id")).drop("_to", "old_id").select(*links.columns)

    def run(self, stream: DataFrame) -> DataFrame:
        drain(stream, self.process, f"{self.path}/checkpoint")
        return self.spark.read.parquet(f"{self.path}/links")
