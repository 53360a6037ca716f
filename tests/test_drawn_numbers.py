"""The check of random draws counts them without a row for each."""

from pyspark.sql import functions as F

from helmtrace.checks.queries import distinct_numbers


def test_numbers_are_counted_as_bits_with_one_row_a_group(spark):
    rows = [(g, n) for g in range(4) for n in range(1, 101) if n % (g + 1) == 0] + [(0, 7), (1, 64), (1, 64), (5, 63), (5, 64), (6, 127), (7, None), (8, 0)]
    table = spark.createDataFrame(rows, "g int, n int").withColumn("sample", F.col("n"))
    by_bits = table.groupBy("g").agg(distinct_numbers("sample", 127).alias("k"), F.avg("n").alias("a"))
    plain = table.groupBy("g").agg(F.count_distinct("sample").alias("k"), F.avg("n").alias("a"))
    assert sorted(by_bits.collect()) == sorted(plain.collect())
    text = by_bits._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in text.splitlines() if "HashAggregate(" in line]
    assert keys and all(k.startswith("g#") and "," not in k for k in keys)
