"""Names in the JVM against unicodedata, over all of Unicode."""

import sys
import time
import unicodedata

from pyspark.sql import functions as F

from courtside.functions import names


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_all_code_points(spark):
    known = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and c]
    rows = [("a" + "".join(known[i : i + 48]) + "z",) for i in range(0, len(known), 48)]
    rows += [("".join(reversed(known[i : i + 97])),) for i in range(0, len(known), 970)] + [("",), (None,), ("ẹ́x",)]
    got = spark.createDataFrame(rows, "s string").select("s", names.strip_accents(F.col("s")).alias("p")).collect()
    assert len(got) == len(rows)
    assert [r.s for r in got if r.p != (None if r.s is None else plain(r.s))] == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("Jokić",)], "s string").select(names.normalize_name("s").alias("n"), names.names_consistent("s", "s").alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first().n == "jokic"


def test_a_character_of_several_letters_costs_no_search(spark):
    """Looked up one by one among more than a thousand, such names took over 50 times as long as ASCII ones."""
    rows = spark.range(40_000).select(F.concat(F.lit("ﬁnn Çüstômer "), F.col("id")).alias("s")).coalesce(1).cache()
    assert rows.count() == 40_000

    def seconds(c):
        took = []
        for _ in range(2):
            start = time.perf_counter()
            rows.select(c.alias("n")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    assert rows.filter("s like '% 7'").select(names.normalize_name("s")).first()[0] == "finn customer 7"
    assert seconds(names.normalize_name("s")) < 15 * seconds(names.normalize_ascii("s"))
    rows.unpersist()
