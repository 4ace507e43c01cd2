"""The letter pairs of the secret scan come from all documents."""

from lumenflow.llm import secret_scan


def test_letter_pairs_count_every_document(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 2 = 0, 'ab ba', 'xy') as text")
    assert secret_scan.letter_pairs(docs) == {"ab": 4500, "ba": 4500, "xy": 4500}
