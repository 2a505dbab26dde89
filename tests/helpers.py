"""Small builders and plain-Python reference results for the tests."""

import json

from tributary import schemas


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def one(spark, value, column, kind="string"):
    """``column(F.col('v'))`` for a single value."""
    from pyspark.sql import functions as F

    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def change_log(spark, *changes, table="docs"):
    """Rows ``(change_id, code, before, after)``; images are dicts, raw text or None."""

    def image(value):
        return json.dumps(value) if isinstance(value, dict) else value

    rows = [(i, code, table, image(before), image(after)) for i, code, before, after in changes]
    return spark.createDataFrame(rows, schemas.CHANGE_LOG)


def doc(id_, text="t", **more):
    return {"id": id_, "text": text, **more}


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
