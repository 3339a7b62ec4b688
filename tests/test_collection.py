from tessellar.operators import segment
from tessellar.sources.collection import Collection, list_collections


def test_life_of_a_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "reports").create()
    assert c.count() == 0 and list_collections(spark, str(tmp_path)) == ["reports"]
    rows = [("a1", "f", "h1", 1, [1.0, 0.0], "one"), ("a2", "f", "h1", 2, [0.0, 1.0], "two"), ("b1", "g", "h2", 1, [0.6, 0.8], "three")]
    cols = "chunk_id string, filename string, file_hash string, page int, embedding array<float>, chunk_text string"
    c.add(spark.createDataFrame(rows, cols).selectExpr("*", "filename as filepath"))
    assert c.count() == 3
    c.add(spark.createDataFrame([("b2", "g", "h3", 1, [0.0, 1.0], "new")], cols).selectExpr("*", "filename as filepath"))
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(c.get()) == ["a1", "a2", "b2"]
    assert ids(c.get({"page": 1})) == ["a1", "b2"] and ids(c.get({"$and": [{"page": {"$eq": 1}}, {"filename": "f"}]})) == ["a1"]
    assert ids(c.get({"$or": [{"page": 2}, {"filename": "g"}]})) == ["a2", "b2"] and ids(c.get(ids=["a1"])) == ["a1"]
    files = spark.createDataFrame([("f", "h1"), ("g", "h9")], "filepath string, file_hash string")
    assert [r["filepath"] for r in c.to_ingest(files).collect()] == ["g"]
    near = c.query(spark.createDataFrame([(7, [0.0, 1.0])], "id bigint, embedding array<float>"), 2).collect()
    assert [r["sim"] for r in sorted(near, key=lambda r: r["rank"])] == [1.0, 1.0]
    plan = c.get({"filename": "f"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(filename" in plan
    c.drop()
    assert list_collections(spark, str(tmp_path)) == []


def test_blocks(spark):
    d = spark.createDataFrame([(1, "ab. cd. efghij"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert [r["block"] for r in segment.blocks(d, 5).orderBy("pos").collect()] == ["ab.", " cd.", " efgh", "ij"]
