"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

#: Extra columns named like things the operators use inside.
CLASHING = "row long, rec string, key string, fp long, score double, block int, rn int"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, ids=None, clashing=False):
    """One row per text; ids count from 0 unless given."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in zip(ids, texts, langs)]
    if not clashing:
        return spark.createDataFrame(rows, DOCUMENTS)
    return spark.createDataFrame([(*r, 1, "r", "k", 2, 0.5, 3, 4) for r in rows], f"{DOCUMENTS}, {CLASHING}")


def folder_of(tmp_path, **tables):
    """A folder that holds the tables as the queries expect them."""
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def written(df, tmp_path, name="docs"):
    path = f"{tmp_path}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
