"""Readers and writers.  Structure breaks stop the run; content gaps don't."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import permits_cloning
from . import checkouts, sarif_sink


class Refused(ValueError):
    """An input that breaks a rule the whole run depends on."""


def refuse_any(bad: DataFrame, what: str) -> None:
    """Raise if ``bad`` has a row, naming one."""
    if row := bad.limit(1).collect():
        raise Refused(f"{what}: {row[0].asDict()}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where it is unset a place in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what exists can be marked
    files.deleteOnExit(place)
    return f"{path}/data"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch path and read back: computed once, and its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def parse_registry_pages(pages: DataFrame, column: str = "value") -> DataFrame:
    """One row per registry entry (name, repo_url) of pages of JSON text.

    A page without a list of servers, an entry without a server object or with an empty name stops the query.
    """
    parsed = pages.select(F.from_json(column, schemas.REGISTRY_PAGE).alias("page"))
    parsed = parsed.select(F.when(F.col("page.servers").isNull(), F.raise_error(F.lit("a registry page has no list of servers"))).otherwise(F.col("page.servers")).alias("servers"))
    entries = parsed.select(F.explode("servers").alias("e"))
    name = F.when(F.length(F.coalesce("e.server.name", F.lit(""))) == 0, F.raise_error(F.lit("a registry entry has no server or an empty name"))).otherwise(F.col("e.server.name"))
    return entries.select(name.alias("name"), F.col("e.server.repository.url").alias("repo_url"))


def read_registry_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry_pages(spark.read.text(path, wholetext=True))


def _strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Server records whose URL may be cloned; no record at all is refused."""
    index = _strict_json(spark, path, schemas.SERVER_RECORD).where("server_id is not null")
    kept = index.where(permits_cloning(F.col("repo_url")))
    if not kept.limit(1).count():
        raise Refused("the index holds no record")
    return kept


def write_index(index: DataFrame, path: str) -> None:
    index.select("server_id", "repo_url", "discovered_via").write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History records; a missing path is an empty history, a corrupt line stops the run."""
    return _strict_json(spark, path, schemas.HISTORY) if exists(spark, path) else spark.createDataFrame([], schemas.HISTORY)


def write_history(history: DataFrame, path: str) -> None:
    history.repartitionByRange("finding_id").sortWithinPartitions("finding_id").write.mode("overwrite").json(path)


def write_bucketed_history(history: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """A history with k (see ``history.dealt``) as a table of buckets by k, read back; ``path`` places it outside the warehouse."""
    writer = history.write.bucketBy(buckets, "k").sortBy("k").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return history.sparkSession.table(table)


def read_files(spark: SparkSession, path: str, server_depth: int = 1, most_bytes: int = 0) -> DataFrame:
    """Checkouts below ``path`` (one folder per server) as a table of files; links are rows without content and never followed.

    Files of more than ``most_bytes`` (0: no limit) come without content.
    """
    if path.startswith("file:") or "://" not in path:
        checkouts.register(spark)
        listed = settled(spark.read.format("checkouts").option("server_depth", server_depth).load(path))
        return checkouts.with_content(listed, most_bytes)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)  # a store that knows no links
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    parts = F.split(F.regexp_replace(F.col("path"), rf"^[a-z0-9]+:/*{root}/", ""), "/")
    server = F.array_join(F.slice(parts, 1, server_depth), "/")
    tail = F.array_join(F.slice(parts, F.lit(server_depth + 1), F.greatest(F.size(parts) - server_depth, F.lit(0))), "/")
    content = F.when((F.lit(most_bytes) == 0) | (F.col("length") <= most_bytes), F.col("content"))
    return found.select(server.alias("server_id"), F.lit(None).cast("string").alias("commit_sha"), tail.alias("path"), content.alias("content"), F.col("length").alias("size"), F.lit(False).alias("is_symlink"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries of four kinds; an unknown kind stops the query, a missing path is an empty ledger."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.LEDGER)
    ledger = _strict_json(spark, path, schemas.LEDGER)
    known = F.col("kind").isin("notice", "opt_out", "withdrawal", "extension")
    return ledger.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of ledger entry: "), F.coalesce("kind", F.lit("none"))))))


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("append").json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return _strict_json(spark, path, schemas.ANNOTATION) if exists(spark, path) else spark.createDataFrame([], schemas.ANNOTATION)


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    return _strict_json(spark, path, schemas.TREND) if exists(spark, path) else spark.createDataFrame([], schemas.TREND)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return _strict_json(spark, path, schemas.CACHE) if exists(spark, path) else spark.createDataFrame([], schemas.CACHE)


def write_corpus(corpus: DataFrame, sample: DataFrame, path: str) -> None:
    """The corpus with its claims, and the sample under a key of its own."""
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    sample.write.mode("overwrite").parquet(f"{path}/sample")


def write_lines(df: DataFrame, path: str) -> None:
    """Annotations, trend points or cached answers, one JSON object a line."""
    df.write.mode("append").json(path)


#: Results of one document at most, by a wide margin.
DOCUMENT_RESULTS = 5000


def sarif_documents(results: DataFrame, rules: DataFrame, tool: str = "scanledger", most: int = DOCUMENT_RESULTS, servers: DataFrame | None = None) -> DataFrame:
    """SARIF 2.1.0 documents as JSON text: server_id, part, document.

    A server's results are dealt to as many parts as hold about ``most`` each, by the first digits of their ids.  With
    ``servers`` (server_id), those without results have a document too, of part 0 without results.
    """
    descriptors = rules.agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.col("rule_index").alias("index")))).alias("rules"))
    body = F.struct(
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))).alias("runs"),
    )
    parts = results.groupBy("server_id").agg(F.ceil(F.count("*") / most).alias("parts"))
    part = F.conv(F.substring("finding_id", 1, 8), 16, 10).cast("long") % F.col("parts")
    dealt = results.join(parts, "server_id").withColumn("part", part)
    grouped = dealt.groupBy("server_id", "part").agg(F.array_sort(F.collect_list(F.struct("finding_id", "rule_id", "rule_index", "level", "message", "file", "line"))).alias("results"))
    if servers is not None:
        silent = servers.select("server_id").where("server_id is not null").distinct().join(parts, "server_id", "left_anti")
        grouped = grouped.unionByName(silent.select("server_id", F.lit(0).cast("long").alias("part"), F.array().cast(grouped.schema["results"].dataType).alias("results")))
    return grouped.crossJoin(F.broadcast(descriptors)).select("server_id", "part", F.to_json(body).alias("document"))  # the rules that fired, one row


def write_sarif(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per server and part, all of them or none (see ``sarif_sink``)."""
    sarif_sink.register(documents.sparkSession)
    documents.select("server_id", F.col("part").cast("long").alias("part"), "document").write.format("sarif").mode(mode).save(path)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """server_id, part, document of what ``write_sarif`` wrote."""
    sarif_sink.register(spark)
    return spark.read.format("sarif").load(path)
