"""Stems by the published examples; an index kept up to date against a scan; merges run twice."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyquarry.operators import fulltext as ft
from skyquarry.streaming.merge import MergedTable, mirror

#: Examples of the published algorithm.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative form
electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll yes ye yellow yellow a a it it""".split()


def test_stems_of_published_examples(spark):
    words, want = EXAMPLES[::2], EXAMPLES[1::2]
    got = spark.createDataFrame([(words,)], "w array<string>").select(ft.stems(F.col("w"))).first()[0]
    assert dict(zip(words, got, strict=True)) == dict(zip(words, want, strict=True))
    assert spark.createDataFrame([(["ärger", "x1ing", "", "don't"],)], "w array<string>").select(ft.stems(F.col("w"))).first()[0] == ["ärger", "x1ing", "", "don't"]


def test_lexemes_keep_places_and_leave_stop_words(spark):
    got = spark.createDataFrame([("The mapped houses, and a Map!",), (None,), ("the",)], "t string").select(ft.lexemes(F.col("t")).alias("l")).collect()
    assert [[(s.term, s.position) for s in r.l] for r in got] == [[("map", 2), ("hous", 3), ("map", 6)], [], []]


WORDS = "mapping maps mapped the a house houses housing forest forests river running runs of tiles".split()


def test_index_equals_scan_after_updates(spark, tmp_path):
    rng, index, now = random.Random(2), ft.Index(spark, str(tmp_path / "i"), parts=4), {}
    for batch in range(4):
        rows = [(rng.randrange(30), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))) if rng.random() < 0.9 else None, rng.random() < 0.2, k) for k in range(25)]
        df = spark.createDataFrame(rows, "id bigint, text string, gone boolean, k int")
        for _ in range(2):  # a batch that is run again changes nothing
            index.apply(df, batch, F.col("gone"), ["k"])
        for i, text, gone, _ in rows:
            now.pop(i, None) if gone else now.__setitem__(i, text)
        docs = spark.createDataFrame(list(now.items()), "id bigint, text string")
        for query in ("maps", "the house", "running rivers", "forest mapping tiles"):
            got = sorted(r.id for r in index.search(query).collect())
            assert got == sorted(r.id for r in ft.matching(docs, query).collect())
    stemmed = {i: [(s.term, s.position) for s in r] for i, r in docs.select("id", ft.lexemes(F.col("text"))).collect()}
    want = sorted(i for i, at in stemmed.items() if any(("hous", p) in at and ("map", p + 1) in at for p in range(9)))
    assert sorted(r.id for r in index.search("houses mapping", phrase=True).collect()) == want
    assert index.search("the").collect() == [] and index.search("nowhere").collect() == []


def test_stream_of_changes_equals_one_merge(spark, tmp_path):
    rng = random.Random(3)
    table = MergedTable(spark, str(tmp_path / "t"), "id bigint, name string", ["id"], parts=4)
    now, k = {}, 0
    schema = "id bigint, name string, gone boolean, k int"
    for batch in range(3):
        rows = []
        for _ in range(15):
            k += 1
            rows.append((rng.choice([*range(12), None]), f"n{k}", rng.random() < 0.25, k))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for i, name, gone, _ in rows:
            now.pop(i, None) if gone else now.__setitem__(i, name)
        q = table.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), F.col("gone"), ["k"])
        q.awaitTermination(120)
        assert {r.id: r.name for r in table.read().collect()} == now
        last = spark.createDataFrame(rows, schema)
        table.apply(last, batch, F.col("gone"), ["k"])  # as after a failure between the sink and the checkpoint
        assert {r.id: r.name for r in table.read().collect()} == now and table.read().count() == len(now)
    table.vacuum()
    assert {r.id: r.name for r in table.read().collect()} == now


def test_two_way_difference_of_listings(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), "project bigint, file string", ["project", "file"], parts=3)
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "project bigint, file string")
    second = spark.createDataFrame([(1, "b"), (1, "d")], "project bigint, file string")
    assert mirror(table, first, 0, ["project"]) == {"inserted": 3, "deleted": 0}
    for _ in range(2):
        assert mirror(table, second, 1, ["project"]) == {"inserted": 1, "deleted": 1}
        assert sorted(map(tuple, table.read().collect())) == [(1, "b"), (1, "d"), (2, "c")]



def test_no_changes_write_nothing(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), "id bigint, name string", ["id"])
    table.apply(spark.createDataFrame([], "id bigint, name string"), 0)
    assert table.read().collect() == [] and table.versions() == {}


def test_a_partition_is_written_by_several_tasks(spark, tmp_path):
    """A frequent word's postings lie in one partition, which no single task writes."""
    from skyquarry.streaming.merge import MergedTable

    table = MergedTable(spark, str(tmp_path / "t"), "id bigint, v bigint", ["id"], parts=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table.apply(spark.range(500).selectExpr("id", "id * 2 AS v"), 0)
        table.apply(spark.range(400, 600).selectExpr("id", "id * 3 AS v"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "t/data/v=1/part=0").glob("*.parquet"))) > 1
    assert sorted(map(tuple, table.read().collect())) == [(i, i * 2 if i < 400 else i * 3) for i in range(600)]
