"""The fold into a history kept in buckets: the same rows as the plain fold, night after night, without a shuffle of the history."""

import random
import re
import uuid

from pyspark.sql import functions as F

from scanledger.operators import history
from scanledger.sources import io

from .test_library import empty_history, finding, rows, ts


def nights(seed):
    r = random.Random(seed)
    for night in range(4):
        moving = [finding(rule="moves", line=10 * night + k) for k in (1, 2)]
        yield moving + [finding(rule=f"r{r.randint(0, 3)}", line=n) for n in sorted(r.sample(range(30), r.randint(0, 14)))]
    yield []


def found(df):
    return sorted((r.finding_id, r.rule_id, r.line, r.first_seen, r.last_seen, tuple(r.previous_ids)) for r in df.collect())


def table(tmp_path):
    return f"h_{uuid.uuid4().hex}", 8, f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_nights_fold_into_buckets_as_they_do_without(spark, tmp_path):
    plain = empty_history(spark)
    kept = io.write_bucketed_history(history.dealt(plain, 8), *table(tmp_path))
    for n, night in enumerate(nights(3)):
        current = rows(spark, *night, finding(rule="none")).where("rule_id <> 'none'")
        now = ts(f"2024-01-0{n + 1}")
        folded = history.nightly_fold(plain, current, now)
        plain = spark.createDataFrame(folded.collect(), folded.schema)
        kept = io.write_bucketed_history(history.fold_into_buckets(kept, current, now, 8), *table(tmp_path))
        assert found(kept) == found(plain)
    assert max(len(r.previous_ids) for r in plain.collect()) == 3


def test_no_shuffle_stands_above_the_history(spark, tmp_path):
    kept = io.write_bucketed_history(history.dealt(empty_history(spark), 8), *table(tmp_path))
    h = history.fold_into_buckets(kept, rows(spark, finding(line=1)), ts("2024-01-01"), 8)
    plan = h._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("+- == Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange", plan)) == 1 and "Bucketed: true" in plan
    # The one exchange is that of tonight's side: the scan of the history stands on the other branch.
    lines = plan.splitlines()
    deep = {name: next(len(x) - len(x.lstrip(" +-:*()0123456789")) for x in lines if name in x) for name in ("Exchange", "FileScan")}
    above = [x for x in lines[: next(i for i, x in enumerate(lines) if "FileScan" in x)] if "Exchange" in x]
    assert not above or deep["Exchange"] >= deep["FileScan"]
    again = io.write_bucketed_history(h, *table(tmp_path))
    assert again.count() == 1 and again.where(F.col("k") != F.xxhash64(*history.MOVE_KEY)).count() == 0
