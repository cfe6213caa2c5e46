"""Small frames that every operator has to cope with."""

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
