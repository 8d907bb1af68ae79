from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import clean
from holdfast.sources import raw
from holdfast.sources.star_schema import StarSchema
from holdfast.streaming import activity


def _plain(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_file_by_file_equals_the_whole_log(spark, tmp_path):
    star = StarSchema(spark, "/root/testdata/sf0.001")
    labels = clean.clean_labels(star.labels()).persist()
    logs = star.user_logs().persist()
    columns = [c.split()[0] for c in raw.USER_LOGS_SCHEMA.split(", ")]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("logs", "out", "checkpoint"))
    # Days are spread over all files, so one day is summed over several triggers.
    files = logs.withColumnRenamed("customer_id", "msno").select(*columns).repartition(6)
    half = F.xxhash64("msno", "date", "total_secs") % 2 == 0
    files.filter(half).write.option("header", True).csv(folder)
    activity.ingest(spark, folder, out, checkpoint, files_per_trigger=2)
    files.filter(~half).write.mode("append").option("header", True).csv(folder)
    activity.ingest(spark, folder, out, checkpoint, files_per_trigger=2)

    # A file with days long before all others comes last, and is not lost.
    late = tmp_path / "late"
    late.mkdir()
    first = logs.first()
    row = {**first.asDict(), "msno": first["customer_id"], "date": 19700305}
    (late / "a.csv").write_text(",".join(columns) + "\n" + ",".join(str(row[c]) for c in columns) + "\n")
    spark.read.option("header", True).csv(str(late)).write.mode("append").option("header", True).csv(folder)
    activity.ingest(spark, folder, out, checkpoint, files_per_trigger=2)
    logs = logs.unionByName(spark.createDataFrame([{**first.asDict(), "date": 19700305}], logs.schema))

    got = activity.monthly_activity(spark, out, labels)
    want = clean.monthly_activity(logs, labels)
    assert _plain(got.select(*want.columns)) == _plain(want)
    assert len({p.name for p in (tmp_path / "out").iterdir()}) >= 4
