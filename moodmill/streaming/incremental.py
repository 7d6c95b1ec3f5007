"""Preparation of an archive that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from moodmill.operators.emoji import EmojiDictionary, FilterConfig
from moodmill.operators.language import LanguageModel, language_predict
from moodmill.plans.preparation import labelled_tweets, prepare
from moodmill.session import durable
from moodmill.sources.archive import named_lines, usable_texts
from moodmill.sources.tables import write_prepared

# Fixed value: files of a batch.
FILES_PER_BATCH = 200
PREPARED = ("text", "lang", "prob", "class", "count")
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def prepare_incremental(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    dictionary: DataFrame | EmojiDictionary,
    languages: LanguageModel,
    config: FilterConfig = FilterConfig(),
    files_per_batch: int = FILES_PER_BATCH,
    refused: str | None = None,
    scope: str = "file",
    max_refused: float | None = None,
) -> None:
    """Prepare all files not seen before, in batches, and return when none is left.

    The checkpoint remembers the files. A file is never split over batches, so
    duplicates per file are found within one. A repeated batch overwrites its own
    folder, so a failure in between leaves no doubled rows. Refused records go to a
    folder per batch below ``refused``, if it is given; ``max_refused`` is their largest
    share in a batch.

    With ``scope='all'`` a text is prepared once, however many files, batches and runs hold
    it. A second stream reads the labelled rows of the first, which lie below the
    checkpoint, and drops the texts it has seen. It keeps a digest per text in a state
    store on disk, whose parts are those of the shuffle; their number is fixed by the
    first run. A repeated batch meets the state of the batch before it, so it gives the same rows.
    """
    if scope not in ("file", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    d = EmojiDictionary.of(dictionary)
    labelled = f"{checkpoint}/labelled"

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch={number:06d}"
        texts = usable_texts(batch, f"{refused}/{name}" if refused else None, max_refused)
        if scope == "all":
            labelled_tweets(texts, d, config).write.mode("overwrite").parquet(f"{labelled}/{name}")
        else:
            write_prepared(prepare(texts, d, languages, config), f"{target}/{name}", mode="overwrite")

    def write_new(batch: DataFrame, number: int) -> None:
        rows = language_predict(durable(batch, "new-texts"), languages)
        write_prepared(rows.select(*PREPARED), f"{target}/batch={number:06d}", mode="overwrite")

    files = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)
    drain(named_lines(files), write, f"{checkpoint}/files" if scope == "all" else checkpoint)
    if scope == "all":
        schema = labelled_tweets(spark.createDataFrame([], "source_file string, text string"), d, config).schema
        rows = spark.readStream.schema(schema).parquet(f"{labelled}/batch=*")
        digest = F.unhex(F.sha2("text", 256))
        new = rows.withColumn("_digest", digest).dropDuplicates(["_digest"]).select("text", "class", "count")
        with_state = spark.conf.get(_STATE_STORE, None)
        spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            drain(new, write_new, f"{checkpoint}/texts")
        finally:
            spark.conf.set(_STATE_STORE, with_state) if with_state else spark.conf.unset(_STATE_STORE)


def drain(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Write all that a stream has to give now."""
    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
