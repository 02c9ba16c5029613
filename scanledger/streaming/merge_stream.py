"""The nightly fold as an incremental job over arriving files: the history and the trend, committed together.

Each micro-batch may hold rows of several nights, and a night may come in several batches.  The history is folded night by
night, key by key (see ``replay``).  A partial night updates what it covers and deletes nothing.  A night that arrives late keeps later stamps: it only
lowers first_seen and fills gaps.  The trend has a point for each day, made from all rows that have come for that day; a
point replaces that of its day only, so late nights land on theirs.

State is three tables.  The history is in ``BUCKETS`` buckets by server, rule, file and evidence, which an identity and the
moves of a finding never leave; a batch reads and rewrites only the buckets that its rows touch.  Sightings, what a batch saw
of a night, are only ever added to.  The trend is rewritten for the days that a batch touches, from their sightings.  A batch
writes under its own id as the version, and its manifest, written last, names the versions of every part of all three
tables: until it stands, readers see the state before the batch, of the history as of the trend.  A batch that failed anywhere before is run again
from the manifest before it and overwrites what it left; one whose manifest stands is done.  What neither the last nor the
last but one manifest names is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..schemas import FINDING, GATED
from ..sources.io import exists

NIGHT_ROWS = FINDING.replace("location struct<file: string, line: int>", "file string, line int") + ", finding_id string, night date"
STATE = FINDING.replace("location struct<file: string, line: int>", "file string, line int") + ", finding_id string, first_seen timestamp, last_seen timestamp, previous_ids array<string>"
NAMES = [f.split()[0] for f in STATE.split(", ")]
SIGHTING = "finding_id string, server_id string, rule_id string, severity string, mark long"
POINT = "scanned_at string, findings_found long, findings_published long, withheld long, servers_affected long, by_rule map<string, long>"
#: A row per part: a bucket of the history, a batch's sightings of a day, a day of the trend.
MANIFEST = "kind string, part string, version long, newest timestamp"
HISTORY, SEEN, TREND = "history", "seen", "trend"
BUCKETS = 64


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(*history.MOVE_KEY), F.lit(BUCKETS)).cast("int")


def fold_night(state: DataFrame, rows: DataFrame, night: str, newest: str | None = None) -> DataFrame:
    """The history after one night; for one before the ``newest`` day of the whole history, stamps are only widened and nothing is moved.

    Unless given, the newest day is that of ``state``; it is empty where there is no history.
    """
    now = F.lit(night).cast("timestamp")
    if newest is None:
        last = state.agg(F.max("last_seen")).first()[0]
        newest = str(last.date()) if last else ""
    current = history.last_of_each(rows.withColumn("_at", F.xxhash64(*[c for c in rows.columns])), ["finding_id"], "_at").drop("_at")
    if newest <= night:
        return history.nightly_fold(state, current, now)
    merged = history.merge_findings(state, current, now)
    seen = state.select("finding_id", F.col("first_seen").alias("s_first"), F.col("last_seen").alias("s_last"))
    held = current.select("finding_id", F.lit(True).alias("held"))
    widened = lambda pick, was: F.when(F.col("held"), pick(F.coalesce(was, now), now)).otherwise(F.col(was))
    return merged.join(seen, "finding_id", "left").join(held, "finding_id", "left").select(
        *history.FIELDS, widened(F.least, "s_first").alias("first_seen"), widened(F.greatest, "s_last").alias("last_seen"), "previous_ids"
    )


def read_manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """kind, part, version, newest of the newest manifest up to ``version``; empty where there is none."""
    for v in range(version, -1, -1):
        if committed(spark, folder, v):
            return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={v}")
    return spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, folder: str, version: int) -> bool:
    return exists(spark, f"{folder}/manifest/version={version}/_SUCCESS")


def place(folder: str, kind: str, part: str, version: int) -> str:
    table, name = {HISTORY: ("data", "bucket"), SEEN: ("seen", "day"), TREND: ("trend", "day")}[kind]
    return f"{folder}/{table}/version={version}/{name}={part}"


def _read(spark: SparkSession, folder: str, parts: list[tuple[str, str, int]], schema: str) -> DataFrame:
    """The parts (kind, part, version) as one table."""
    paths = [place(folder, *p) for p in sorted(parts)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _parts(manifest: list, *kinds: str) -> list[tuple[str, str, int]]:
    return [(r["kind"], r["part"], r["version"]) for r in manifest if r["kind"] in kinds]


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The newest history up to ``version``, or an empty one."""
    return _read(spark, folder, _parts(read_manifest(spark, folder, version).collect(), HISTORY), STATE)


def read_trend(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The trend up to ``version``, a point per day, in the order of days; or an empty one."""
    return _read(spark, folder, _parts(read_manifest(spark, folder, version).collect(), TREND), POINT).orderBy("scanned_at")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replay(seen: dict, late: set[int], nights: list[int]) -> dict:
    """The findings of one key after ``nights``, by id: [line, first_seen, last_seen, previous_ids, ...].

    ``seen`` has for each id such a row, its stamps None if it is new, and the nights in which the batch saw it.  The rules
    are those of ``fold_night``; only nights of the key and those that are ``nights`` for every key are looked at.
    """
    state = {i: row for i, (row, _) in seen.items() if row[1] is not None or row[2] is not None}
    by_night: dict = {}
    for i, (_, of) in seen.items():
        for night in of:
            by_night.setdefault(night, []).append(i)
    for night in sorted({*by_night, *nights}):
        tonight = by_night.get(night, ())
        if night in late:  # stamps are only widened, and nothing is moved
            for i in tonight:
                row = state.setdefault(i, [seen[i][0][0], night, night, [], *seen[i][0][4:]])
                row[1], row[2] = min(row[1], night), max(row[2], night)
            continue
        for i in tonight:
            state.setdefault(i, [seen[i][0][0], night, night, [], *seen[i][0][4:]])[2] = night
        came = [i for i, row in state.items() if row[1] == row[2] == night]
        gone = [i for i, row in state.items() if row[2] != night] if came else []
        if came and len(came) == len(gone):
            in_order = lambda i: (state[i][0] is not None, state[i][0], i)
            for new, old in zip(sorted(came, key=in_order), sorted(gone, key=in_order), strict=True):
                was = state.pop(old)
                state[new][1], state[new][3] = was[1], [*was[3], old]
    return state


def _replayed(late: set[int], nights: list[int], schema: pa.Schema) -> Callable:
    """``replay`` over rows that come in the order of k, the hash of their key; only the rows of one k are held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for _, of_hash in groupby(rows(batches), key=lambda r: r["k"]):
            keys: dict = {}
            for r in of_hash:
                row = [r["line"], r["first_at"], r["last_at"], r["previous_ids"] or [], r]
                keys.setdefault(tuple(r[c] for c in history.MOVE_KEY), {})[r["finding_id"]] = (row, r["nights"])
            for seen in keys.values():
                for _, first, last, previous, r in replay(seen, late, nights).values():
                    out.append(r | {"first_at": first, "last_at": last, "previous_ids": previous})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return fold


def fold_history(rows: DataFrame, folder: str, batch_id: int, before: list, touched: list[int], nights: dict[str, int]) -> str:
    """Write the buckets that ``rows`` touch, folded night by night as by ``fold_night``; returns the newest day.

    ``rows`` have each finding once a night, ``nights`` the microseconds of each day.  Neither an id nor a move leaves its
    key, so the nights are replayed key by key, in one pass over the history and the batch, whatever their number.
    """
    newest = max((str(r["newest"].date()) for r in before if r["newest"]), default="")
    late = {at for night, at in nights.items() if night < newest}
    state = _read(rows.sparkSession, folder, [p for p in _parts(before, HISTORY) if int(p[1]) in touched], STATE)
    micros = lambda c: F.unix_micros(c)
    old = state.select(*history.FIELDS, micros(F.col("first_seen")).alias("first_at"), micros(F.col("last_seen")).alias("last_at"), "previous_ids", F.lit(None).cast("long").alias("at"))
    new = rows.select(*history.FIELDS, *[F.lit(None).cast("long").alias(c) for c in ("first_at", "last_at")], F.lit(None).cast("array<string>").alias("previous_ids"), micros(F.col("night").cast("timestamp")).alias("at"))
    sides = old.unionByName(new).withColumns({"bucket": bucket_of(), "k": F.xxhash64(*history.MOVE_KEY)}).repartition("bucket")
    sides = sides.groupBy("bucket", "k", "finding_id").agg(
        F.max_by(F.struct(*history.FIELDS[1:]), F.coalesce("at", F.lit(-(1 << 63)))).alias("r"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("first_at", "last_at", "previous_ids")], F.collect_list("at").alias("nights"),
    )
    found = sides.select("bucket", "k", "finding_id", "r.*", "first_at", "last_at", "previous_ids", "nights").sortWithinPartitions("bucket", "k")
    texts = [c for c in history.FIELDS if c != "line"]
    kept = found.drop("k", "nights").schema
    arrow = pa.schema([(f.name, pa.string() if f.name in texts else pa.int64() if f.name in ("first_at", "last_at") else pa.int32() if f.name in ("line", "bucket") else pa.list_(pa.string())) for f in kept])
    again = [at for night, at in nights.items() if night == newest]  # what an earlier batch left of this night is looked at again
    out = found.mapInArrow(_replayed(late, again, arrow), kept)
    out = out.withColumns({"first_seen": F.timestamp_micros("first_at"), "last_seen": F.timestamp_micros("last_at")}).select(*NAMES, "bucket")
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={batch_id}")
    return max(newest, *nights)


def write_sightings(rows: DataFrame, folder: str, batch_id: int) -> None:
    """What the batch saw of each day: each finding once, by the row that ``fold_night`` takes of it."""
    names = [f.split()[0] for f in SIGHTING.split(", ")]
    rows.withColumn("day", F.date_format("night", "yyyy-MM-dd")).select("day", *names).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/seen/version={batch_id}")


def _once(rows: DataFrame, day: str = "day") -> DataFrame:
    """The row of the largest mark of every finding of a day."""
    rest = [c for c in rows.columns if c not in (day, "finding_id")]
    return rows.groupBy(day, "finding_id").agg(F.max_by(F.struct(*rest), "mark").alias("r")).select(day, "finding_id", "r.*")


def write_points(spark: SparkSession, folder: str, batch_id: int, seen: list[tuple[str, str, int]], shown: Column) -> None:
    """The points of the days of the sightings ``seen``: all that any batch saw of a day counts, each finding once."""
    days = [p[1] for p in seen]
    names = ["day", *[f.split()[0] for f in SIGHTING.split(", ")]]

    def of(parts: list) -> DataFrame:
        paths = [place(folder, *p) for p in sorted(parts)]
        reader = spark.read.schema(f"{SIGHTING}, version long, day string").option("basePath", f"{folder}/seen")
        return reader.parquet(*paths).select(*names) if paths else spark.createDataFrame([], f"day string, {SIGHTING}")

    rows = of([p for p in seen if days.count(p[1]) == 1]).unionByName(_once(of([p for p in seen if days.count(p[1]) > 1])).select(*names))
    counts = rows.groupBy("day", "rule_id", "server_id").agg(F.count("*").alias("n"), F.count_if(shown).alias("shown"))
    rules = counts.groupBy("day", "rule_id").agg(F.sum("n").alias("n"), F.sum("shown").alias("shown"))
    points = rules.groupBy("day").agg(F.sum("n").alias("findings_found"), F.sum("shown").alias("findings_published"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"))
    points = points.join(counts.groupBy("day").agg(F.count_distinct("server_id").alias("servers_affected")), "day")
    points = points.select(F.col("day").alias("scanned_at"), "findings_found", "findings_published", (F.col("findings_found") - F.col("findings_published")).alias("withheld"), "servers_affected", "by_rule", "day")
    points.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/trend/version={batch_id}")


def not_gated() -> Column:
    return ~F.col("severity").isin(GATED)


def fold_batch(df: DataFrame, folder: str, batch_id: int, shown: Column | None = None) -> None:
    """Fold the rows of one batch into the history and the trend; ``shown`` says which findings the trend counts as published."""
    spark = df.sparkSession
    if committed(spark, folder, batch_id):  # done before, and only its acknowledgement was lost
        return
    before = read_manifest(spark, folder, batch_id - 1).collect()  # a row per part
    rows = _once(df.withColumn("mark", F.xxhash64(*[c for c in df.columns if c != "night"])), "night").persist()  # for its nights, the history and the sightings
    try:
        told = rows.groupBy(bucket_of().alias("bucket"), "night").count().withColumn("at", F.unix_micros(F.col("night").cast("timestamp"))).collect()  # buckets times nights
        touched, nights = sorted({r["bucket"] for r in told}), dict(sorted({(str(r["night"]), r["at"]) for r in told}))
        if not touched:
            return
        newest = fold_history(rows, folder, batch_id, before, touched, nights)
        write_sightings(rows, folder, batch_id)
    finally:
        rows.unpersist()
    seen = [p for p in _parts(before, SEEN) if p[1] in nights] + [(SEEN, night, batch_id) for night in nights]
    write_points(spark, folder, batch_id, seen, not_gated() if shown is None else shown)
    new = [(HISTORY, str(b)) for b in touched] + [(TREND, night) for night in nights]
    kept = [p for p in _parts(before, HISTORY, SEEN, TREND) if (p[0], p[1]) not in new]
    now = kept + [(*k, batch_id) for k in new] + [(SEEN, night, batch_id) for night in nights]
    rows = spark.createDataFrame([(*p, newest) for p in now], "kind string, part string, version long, newest string")
    rows.withColumn("newest", F.col("newest").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={batch_id}")
    # What the manifest before the last one named and both later ones don't.
    for p in set(_parts(read_manifest(spark, folder, batch_id - 2).collect(), HISTORY, TREND)) - set(_parts(before, HISTORY, TREND)):
        _remove(spark, place(folder, *p))
    if batch_id >= 2:
        _remove(spark, f"{folder}/manifest/version={batch_id - 2}")


def fold_stream(spark: SparkSession, landing: str, folder: str, checkpoint: str, files_per_batch: int | None = 1, shown: Column | None = None) -> int:
    """Fold everything that has landed below ``landing``, so many files a batch (None: what is there is one batch).

    Returns the version that ``read_version`` and ``read_trend`` take.
    """
    source = spark.readStream.schema(NIGHT_ROWS)
    rows = (source if files_per_batch is None else source.option("maxFilesPerTrigger", files_per_batch)).parquet(landing)
    last = {"version": 0}

    def batch(df: DataFrame, batch_id: int) -> None:
        fold_batch(df, folder, batch_id, shown)
        last["version"] = batch_id

    stream = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return last["version"]


def merge_stream(spark: SparkSession, landing: str, folder: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Fold everything that has landed below ``landing`` and return the history."""
    return read_version(spark, folder, fold_stream(spark, landing, folder, checkpoint, files_per_batch))
