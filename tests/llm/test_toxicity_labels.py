import pytest

from linkweave.llm import toxicity


@pytest.mark.parametrize("kind", ["double", "bigint", "boolean"])
def test_labels_may_be_of_any_type_that_tells_0_from_1(spark, kind):
    docs = spark.createDataFrame([(k, f"stone river {'grumblish' if k % 2 else 'cloud'} number{k}") for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(119)] + [(119, None)], "doc_id long, toxic int")
    plain, other = (toxicity.fit(docs, x) for x in (labels, labels.selectExpr("doc_id", f"cast(toxic AS {kind}) AS toxic")))
    assert plain.emission["grumblish$"] > 0.1
    assert (other.emission, other.link) == (plain.emission, plain.link)
