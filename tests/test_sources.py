import os
import tempfile


def test_read_documents_text_files(spark):
    """A1: one document per text file, stable 64-bit ids from the path."""
    from countmix.operators import text
    from countmix.sources import read_documents
    d = tempfile.mkdtemp(prefix="countmix-text-")
    bodies = ["Alpha beta gamma.\nBeta again!", "Delta 42 epsilon", "zeta"]
    for i, b in enumerate(bodies):
        with open(os.path.join(d, f"doc{i}.txt"), "w") as f:
            f.write(b)
    docs = read_documents(spark, d, fmt="text")
    rows = docs.collect()
    assert len(rows) == 3 and len({r.doc_id for r in rows}) == 3
    again = {r.doc_id for r in read_documents(spark, d, fmt="text").collect()}
    assert again == {r.doc_id for r in rows}
    toks = {r.term for r in text.tokens(docs).collect()}
    assert toks == {"alpha", "beta", "gamma", "again", "delta", "epsilon", "zeta"}


def test_read_documents_parquet_projects(spark):
    from countmix.sources import read_documents
    df = read_documents(spark, "/root/testdata/sf0.001/documents.parquet", keep=["lang"])
    assert df.columns == ["doc_id", "text", "lang"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
