"""One object over the whole flow: put documents, replicate, drain, search, answer, write back.

The change log is the source of truth: a put appends one log version, and the document table (text
image and vector in one row) is brought up to the log afterwards. A failure in between leaves a log
version that the next call applies, so no document is ever without its vector. One process writes;
any number read. ``change_id`` is the version of the put, since a put sets each key once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas, tables
from tributary.functions import scalars
from tributary.operators import changes, embedding, grouping, knn, prompts, writeback
from tributary.streaming import drain as draining
from tributary.streaming.sinks import Sink

DOCS = "docs"
INBOX_COLUMNS = "ts bigint, src string, payload string"
VECTOR_COLUMNS = "emb array<float>, model string, text_hash string"


def _one_each(rows: DataFrame, columns: Sequence[str], order: str | None) -> DataFrame:
    """One row per id: the one with the largest ``order``; without an order a repeated id is an error."""
    if order is not None:
        return changes.fold(rows.select(*columns, order), "id", order).select(*columns)
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0]['id']!r} stands in the batch {twice[0]['n']} times; name the column that orders its rows")
    return rows.select(*columns)


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        model: embedding.Model | None = None,
        model_name: str = "hash-384",
        generator: Callable[[Sequence[str]], Sequence[str]] | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.model = model or embedding.hash_model(384)
        self.model_name = model_name
        self.generator = generator
        self.table = tables.MergeTable(spark, f"{self.root}/docs", extra=VECTOR_COLUMNS)
        self.inbox_table = tables.MergeTable(spark, f"{self.root}/inbox", INBOX_COLUMNS)
        self.log = draining.change_versions(spark, f"{self.root}/log")
        self.outbox = tables.Versions(spark, f"{self.root}/outbox", schemas.OUTBOX)
        self.acks = tables.Versions(spark, f"{self.root}/acks", schemas.ACKS)
        self.drains = tables.Versions(spark, f"{self.root}/drained", schemas.struct("name string, newest bigint"))

    # ---- documents ---------------------------------------------------------------------------------

    @property
    def log_path(self) -> str:
        return self.log.path

    def put(self, id_: str, text: str, meta: str | None = None) -> int:
        """Upsert one document; for more than one use :meth:`put_many`."""
        return self.put_many(self.spark.createDataFrame([(id_, text, meta)], "id string, text string, meta string"))

    def put_many(self, docs: DataFrame, order: str | None = None, tag: str | None = None) -> int:
        """Upsert ``docs(id, text, meta)`` as one version; returns the version.

        Ids must be unique in ``docs``, or ``order`` must name the column whose largest value wins. A ``tag`` names
        the batch: putting a batch again whose tag is in the log adds nothing.
        """
        if tag is not None and (before := self.log.tagged(tag)) is not None:
            return before
        docs = _one_each(docs, ["id", "text", "meta"], order)
        image = F.to_json(
            F.struct("id", "text", F.coalesce("meta", F.lit("null")).alias("meta"), scalars.now_seconds().alias("ts"))
        )
        return self._commit(docs.select("id", F.lit(True).alias("_kept"), image.alias("_new")), tag)

    def delete(self, ids: DataFrame) -> int:
        """Delete the documents named in ``ids(id)``."""
        gone = F.lit(None).cast("string")
        return self._commit(ids.select("id", F.lit(False).alias("_kept"), gone.alias("_new")).distinct())

    def land(
        self, lines: DataFrame, to_documents: Callable[[DataFrame], DataFrame], name: str,
        push_every: float | None = None, push_writes: int | None = None, publish: Callable[[], None] | None = None,
    ):
        """Stream landed text ``lines`` through ``to_documents`` into the log; returns the streaming query.

        Each micro-batch is one put named after the feed and its number, so a repeated one adds nothing; of several
        lines with one id the last counts. ``publish`` is called when ``push_writes`` documents or more have come in
        since the last call (after every batch, if no number is given).
        """
        waiting = [0]

        def put(batch: DataFrame, number: int) -> None:
            version = self.put_many(batch.withColumn("_line", F.monotonically_increasing_id()), "_line", f"{name}:{number}")
            waiting[0] += self.log.read_only([version]).count()
            if publish is not None and waiting[0] and waiting[0] >= (push_writes or 1):
                waiting[0] = 0
                publish()

        return draining.land_documents(lines, to_documents, put, f"{self.root}/feeds/{name}", push_every)

    def _commit(self, wanted: DataFrame, tag: str | None = None) -> int:
        self.recover()
        version = max(self.table.version(), self.log.newest()) + 1
        old = F.to_json(F.struct("id", "text", "meta", "ts"))
        current = self.table.touching(wanted).select("id", old.alias("_old"))
        joined = wanted.join(current, "id", "left").filter(F.col("_kept") | F.col("_old").isNotNull())
        code = (
            F.when(~F.col("_kept"), scalars.OP_CODES["delete"])
            .when(F.col("_old").isNull(), scalars.OP_CODES["insert"])
            .otherwise(scalars.OP_CODES["update"])
        )
        log = joined.select(
            F.lit(version).cast("bigint").alias("change_id"),
            code.cast("int").alias("change_type"),
            F.lit(DOCS).alias("table_name"),
            F.col("_old").alias("before"),
            F.col("_new").alias("after"),
        )
        self.log.write(log, version, tag)
        self.recover()
        return version

    def recover(self) -> None:
        """Apply log versions the document table does not have yet."""
        done = self.table.version()
        for row in self.log.commits().where(F.col("version") > done).orderBy("version").collect():
            log = self.log.read_only([row["version"]]).drop("version")
            effects = changes.document_state(changes.effects(changes.decode(log)))
            self.table.apply(self._with_vectors(effects), row["version"])

    def compact(self, expire: bool = False) -> int:
        """Fold what the puts have left into a new base of the document table; with ``expire`` drop what it replaces."""
        version = self.table.compact()
        if expire:
            self.table.expire()
        return version

    def _with_vectors(self, effects: DataFrame) -> DataFrame:
        """Adds vectors: a text that is stored already under this model keeps its vector."""
        text = F.when(F.col("op") != "delete", F.col("text"))
        rows = effects.withColumn("_text", text).withColumn(
            "text_hash", F.when(F.col("_text").isNotNull(), embedding.text_hash(F.col("_text")))
        )
        here = self.table.touching(rows).filter(F.col("model") == self.model_name)
        stored = here.select("id", "text_hash", "emb")
        kept = rows.join(stored, ["id", "text_hash"], "left")
        missing = F.when(F.col("emb").isNull(), F.col("_text"))
        both = kept.withColumn("emb", F.coalesce("emb", embedding.embed_given(missing, self.model)))  # one pass: the log is decoded once
        model = F.when(F.col("emb").isNotNull(), F.lit(self.model_name))
        return both.withColumn("model", model).select(*self.table.schema.names)

    def documents(self, version: int | None = None) -> DataFrame:
        return self.table.rows(version).select("id", "text", "meta", "ts")

    def vectors(self) -> DataFrame:
        """Vectors of this engine's model: ``(id, emb, model, text_hash)``."""
        rows = self.table.rows().filter(F.col("model") == self.model_name)
        return rows.select("id", "emb", "model", "text_hash")

    # ---- replicas ----------------------------------------------------------------------------------

    def pull(self, master: Engine) -> bool:
        """Bring this engine's documents up to ``master``; whether anything changed."""
        if self.table.version() < 0:
            return tables.bootstrap(master.table, self.table) >= 0
        return tables.pull(master.table, self.table)

    def converged_with(self, master: Engine) -> DataFrame:
        return changes.same_content(master.documents(), self.documents())

    # ---- search ------------------------------------------------------------------------------------

    def _embedded(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", embedding.embed_column(F.col("query"), self.model).alias("emb"))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Hits of ``queries(query_id, query)``: ``(query_id, rank, id, text, meta, score)``."""
        return self._hits(self._embedded(queries), k)

    def _hits(self, asked: DataFrame, k: int) -> DataFrame:
        # Text and vector are one row, so a vector always has its document and no join is needed to know.
        rows = self.table.rows()
        stored = embedding.of_model(rows.select("id", "emb", "model"), self.model_name)
        same = stored.select("id", F.when(F.col("model").isNotNull(), F.col("emb")).alias("emb"))
        found = rows.select("id", "text", "meta").join(knn.nearest(same, asked, k), "id")
        return found.select("query_id", "rank", "id", "text", "meta", F.col("dist").alias("score"))

    def search_timed(self, queries: Sequence[str], k: int = 5) -> tuple[list, float, float]:
        """Hits, milliseconds spent on embedding the queries, and on the scan."""
        start = time.monotonic()
        vectors = [[float(x) for x in v] for v in self.model(list(queries))]
        middle = time.monotonic()
        asked = self.spark.createDataFrame(list(enumerate(vectors)), "query_id int, emb array<float>")
        hits = self._hits(asked, k).orderBy("query_id", "rank").collect()  # k rows per query
        return hits, (middle - start) * 1000, (time.monotonic() - middle) * 1000

    def answer(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """``(query_id, prompt, answer)``; the answer is empty without a text model."""
        asked = prompts.cited_prompts(self.search(queries, k), queries)
        return asked.withColumn("answer", embedding.generate_column(F.col("prompt"), self.generator))

    # ---- drain -------------------------------------------------------------------------------------

    def drain(self, sinks: Iterable[Sink], name: str = "main") -> draining.DrainStats:
        """Send what is new in the log to ``sinks``; ``name`` identifies this set of sinks."""
        newest = self.log.newest()
        if name not in self.drained():
            self._drained(name, -1)
        stats = draining.drain(self.spark, self.log_path, sinks, f"{self.root}/checkpoints/{name}", table=DOCS)
        self._drained(name, newest)  # all versions up to here have been sent
        return stats

    def _drained(self, name: str, newest: int) -> None:
        row = self.spark.createDataFrame([(name, newest)], self.drains.schema)
        self.drains.write(row, self.drains.newest() + 1)

    def drained(self) -> dict[str, int]:
        """The newest log version each set of sinks has received in full; -1 before its first drain ended."""
        return {r["name"]: r["v"] for r in self.drains.read().groupBy("name").agg(F.max("newest").alias("v")).collect()}

    def prune(self, upto: int | None = None) -> int:
        """Delete log versions that the document table and every set of sinks have; returns how many.

        ``upto`` keeps later versions as well.
        """
        had = [self.table.version(), *self.drained().values()] + ([upto] if upto is not None else [])
        return draining.prune(self.spark, self.log_path, had)

    def summary(self) -> DataFrame:
        return grouping.summary_by_source(self.documents())

    # ---- write-back --------------------------------------------------------------------------------

    def enqueue(self, payloads: Sequence[str], src: str | None = None) -> None:
        """Queue payloads of one source in the given order."""
        src = src if src is not None else self.root
        top = self.outbox.read().filter(F.col("src") == src).agg(F.max("seq")).first()[0] or 0
        rows = [(src, top + n, payload) for n, payload in enumerate(payloads, start=1)]
        queued = self.spark.createDataFrame(rows, "src string, seq bigint, payload string")
        self.outbox.write(queued.withColumn("ts", scalars.now_seconds()), self.outbox.newest() + 1)

    def outbox_pending(self) -> DataFrame:
        return writeback.pending(self.outbox.read().drop("version"), self.acks.read().drop("version"))

    def flush_outbox(self, send: Callable[[dict], bool], page: int = writeback.PAGE) -> int:
        """Deliver what is queued, source by source in order, up to the first failure; returns how many."""
        sent = writeback.deliver(writeback.next_page(self.outbox_pending(), page), send)
        version = self.acks.newest() + 1
        self.acks.write(sent, version)
        return self.acks.read_only([version]).count()

    def ingest_inbox(self, messages: DataFrame, order: str | None = None) -> int:
        """Land ``messages(id, src, payload)``; an id that is there already has its row replaced.

        Ids must be unique in ``messages``, or ``order`` must name the column whose largest value wins.
        """
        version = self.inbox_table.version() + 1
        rows = _one_each(messages, ["id", "src", "payload"], order).withColumns(
            {"change_id": F.lit(version).cast("bigint"), "op": F.lit("insert"), "ts": scalars.now_seconds()}
        )
        self.inbox_table.apply(rows, version)
        return version

    def inbox(self) -> DataFrame:
        return self.inbox_table.rows().select("id", "ts", "src", "payload")
