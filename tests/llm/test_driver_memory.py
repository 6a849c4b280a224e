"""Tables that grow with the input are never broadcast, however small Spark takes them for."""

from gridloom.llm import decontam, line_dedup, near_copies, packing, simhash
from gridloom.llm.registry import tokenizer_path


def joins(df):
    """The joins that ran: of each, the line of the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Join" in line]


def broadcast(df):
    found = joins(df)
    assert found
    return [x for x in found if "Broadcast" in x]


def test_keys_of_fingerprints(spark):
    prints = spark.createDataFrame([(1 << i,) for i in range(40)], "print long")
    assert not broadcast(simhash.connecting_links(prints)) and not broadcast(simhash.links(prints))


def test_windows_of_lines(spark):
    text = "\n".join("abcdef")
    docs = spark.createDataFrame([(1, 1, text), (2, 1, text)], "doc_id long, text_hash long, text string")
    assert not broadcast(line_dedup.covered_lines(docs))


def test_elements_of_sets(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(30 + i))) for i in range(4)], "doc_id long, text string")
    sets = near_copies._hashes(docs, near_copies._sets(docs).select("set", "doc_id", "text_hash"))
    found = joins(near_copies._prefixes(sets, sets.selectExpr("set", "set AS root")))
    assert any("SortMergeJoin [element" in x for x in found) and not any("Broadcast" in x and "element" in x for x in found)


def test_shingles_that_documents_hold(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(i, f"{text} more{i}") for i in range(4)], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert any("SortMergeJoin" in x and "shingle" in x for x in joins(decontam.find_items(docs, items)))


def test_units_of_documents(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "a") for i in range(20)], "doc_id long, text string, source string")
    assert any("SortMergeJoin [row" in x for x in joins(packing.pack(docs, tokenizer_path())))
