"""The sign test of many counts."""

import math
import signal
from fractions import Fraction

import pandas as pd

from scanledger.operators import evaluate


def test_the_sign_test_of_millions_takes_moments():
    def late(*_):
        raise TimeoutError("a sign test of millions of counts takes too long")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        pairs = [(1_000_000, 1_002_000), (40_000_000, 40_000_000), (3, 5_000_000), (499_999_000, 500_001_000), (0, 10**9)]
        got = list(evaluate._sign_test(*(pd.Series(x) for x in zip(*pairs, strict=True))))
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    for (a, b), p in zip(pairs, got, strict=True):  # the normal curve, which is exact to 1 / n here
        assert abs(p - min(1.0, math.erfc(max(abs(a - b) - 1, 0) / math.sqrt(2 * (a + b))))) < 1e-6


def test_large_sign_tests_are_exact():
    for a, b in [(500, 501), (501, 500), (1000, 1000), (480, 521), (2400, 2601), (1, 1000), (0, 1001), (3000, 3000), (0, 0), (7, 0)]:
        n, k = a + b, min(a, b)
        want = 1.0 if n == 0 else min(1.0, float(Fraction(sum(math.comb(n, i) for i in range(k + 1)), 1 << (n - 1))))
        assert math.isclose(evaluate._sign_test(pd.Series([a]), pd.Series([b]))[0], want, rel_tol=1e-11, abs_tol=1e-290)


def test_sign_tests_answers_with_large_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    from scanledger.plans import registry

    d, n = f"file://{tmp_path}", 60_000
    doc = spark.range(n).withColumnRenamed("id", "doc_id")
    doc.select("doc_id", F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{d}/documents.parquet")
    doc.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")

    def late(*_):
        raise TimeoutError("sign_tests takes too long")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        row = registry.QUERIES["sign_tests"](spark, d).first()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
        spark.sparkContext.cancelAllJobs()
    more, less = row.more, row.less
    assert more + less > 40_000
    assert abs(row.p_value - min(1.0, math.erfc(max(abs(more - less) - 1, 0) / math.sqrt(2 * (more + less))))) < 1e-4
