"""The clause of BSD-3 with long holder lists and names of any script."""

from graphloom.llm import licenses


def test_bsd_3_clause_takes_any_holder(spark):
    many = ", ".join(f"Holder Number {k} of the University" for k in range(12))
    holders = ["the copyright holder", "Universität Zürich", "北京大学", many, many + " and Søren"]
    texts = [f"Neither the name of {h} nor the names of its contributors may be used to endorse or promote products." for h in holders]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.label_documents(df).collect()} == {k: "bsd-3" for k in range(len(texts))}
