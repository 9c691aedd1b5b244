from tidewake.llm import near_join as nj

COMMON = " ".join(f"w{i}" for i in range(60))


def test_rows_that_share_an_identifier_go_one_by_one(spark):
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(2, COMMON), (5, COMMON + " more"), (5, other), (5, other), (7, None), (7, COMMON), (None, COMMON), (8, other + " a"), (8, "short")]
    kept = nj.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, COMMON), (5, other), (5, other), (7, None), (None, COMMON), (8, "short")], key=repr)
