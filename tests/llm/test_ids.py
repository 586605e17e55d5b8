import pytest
from helpers import documents, folder_of

IDS = [2**60 + 1, None, -(2**61) - 1, 5, None, 2**53 + 1]
TEXTS = ["the cat sat on the mat and was happy there", "le chat est sur la table avec nous", None, "", "mail a@b.com", "die Katze ist auf dem Tisch und bleibt"]


@pytest.mark.parametrize("name", ["op2_sentencepiece", "op3_lm_scoring", "op4_html_extraction", "op9_pii", "op10_language_id", "op13_packed_ids"])
def test_large_ids_beside_nulls_stay_as_they_are(spark, tmp_path, queries, name):
    """Whole numbers beyond 2^53 in one batch with null ids, which pandas would hold as doubles."""
    docs = documents(spark, TEXTS, ids=IDS, langs=["en", "fr", "en", None, "en", "de"]).coalesce(1)
    pages = docs.selectExpr("doc_id AS page_id", "'http://x' AS url", "concat('<p>', text, '</p>') AS html")
    out = queries[name](spark, folder_of(tmp_path, documents=docs, pages=pages))
    key = "page_id" if name.startswith("op4") else "doc_id"
    assert dict(out.dtypes)[key] == "bigint"
    assert sorted((r[key] for r in out.collect()), key=str) == sorted(IDS, key=str)
