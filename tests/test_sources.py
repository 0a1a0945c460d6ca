import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming.resume import append_new


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"custom_id": "x"}\n\n{"custom_id": 5}\n')
    (tmp_path / "b.jsonl").write_text('{"custom_id": "y"}\nbroken\n')
    assert {r[0] for r in readers.read_ids(spark, str(tmp_path)).collect()} == {"x", "y"}
    assert readers.read_jsonl(spark, str(tmp_path), "custom_id string", strict=False).count() == 3
    with pytest.raises(Exception, match="b.jsonl"):
        readers.read_jsonl(spark, str(tmp_path), "custom_id string").collect()
    assert [p[-7:] for p in readers.shards(spark, str(tmp_path), "", ".jsonl")] == ["a.jsonl", "b.jsonl"]


def test_lexicon(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"Bok": ["Rambut", 5], "Tiang": "Aku", "n": 7, "m": {}, "tiang": ["Saya"]}))
    found = {r["word"]: r["translations"] for r in readers.read_lexicon(spark, str(tmp_path / "d.json")).collect()}
    assert found == {"bok": ["rambut"], "tiang": ["saya"], "n": [], "m": []}


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" B \n\na\nb\nB\n")
    assert {r[0] for r in readers.read_word_list(spark, str(tmp_path / "w.txt")).collect()} == {"a", "b"}
    assert [r["line"] for r in readers.read_ordered_lines(spark, str(tmp_path / "w.txt")).collect()] == ["B", "a", "b"]


def test_tsv_and_tree(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("i\tBalinese\tid\n0\ta\tb\n1\t\tc\n")
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "b")]
    for name in ("x/one.txt", "mydict/two.txt", "x/three.txt", "x/four.md"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(("The image " if "three" in name else "") + "word " * 12)
    assert [r["title"] for r in readers.read_tree(spark, str(tmp_path / "tree")).collect()] == ["one"]


def test_corpora(spark, tmp_path):
    spark.createDataFrame([("a",), (" ",), (None,)], "content string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("b", "c")], "x string, y string").write.parquet(str(tmp_path / "q"))
    assert [r[0] for r in readers.read_corpora(spark, [str(tmp_path / k) for k in "pqr"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.read_corpora(spark, [str(tmp_path / "r")])


def test_resolve(spark):
    entries, files = spark.createDataFrame([("a",), ("b",), ("z",)], "entry string"), spark.createDataFrame([("d/a2",), ("d/a",), ("d/b9",), ("d/b1",)], "path string")
    assert {tuple(r) for r in readers.resolve(entries, files).collect()} == {("a", "d/a"), ("b", "d/b1")}


def test_shards(spark, tmp_path):
    writers.save_shards(spark.range(25).withColumn("v", F.col("id") * 2), str(tmp_path / "s"), 10, "id")
    assert {r["shard"]: r["count"] for r in spark.read.text(str(tmp_path / "s")).groupBy("shard").count().collect()} == {1: 10, 2: 10, 3: 5}
    assert [r["rn"] for r in writers.numbered(spark.range(0), "id").collect()] == []


def test_guards(spark, tmp_path):
    writers.save(spark.range(2), str(tmp_path / "k"))
    with pytest.raises(Exception):
        writers.save(spark.range(2), str(tmp_path / "k"))
    writers.save(spark.range(3), str(tmp_path / "k"), overwrite=True)
    writers.save_splits({"train": spark.range(2), "test": spark.range(1)}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 3 and spark.read.parquet(str(tmp_path / "m")).where("split = 'test'").count() == 1
    writers.save_jsonl(spark.range(2), str(tmp_path / "j"))
    writers.save_jsonl(spark.range(2), str(tmp_path / "j"), append=True)
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "id long").count() == 4
    writers.save_document(spark.range(3), str(tmp_path / "doc"), F.desc("id"))
    assert [r["id"] for r in readers.read_json(spark, str(tmp_path / "doc"), "id long").collect()] == [2, 1, 0]
    (part,) = (tmp_path / "doc").glob("part-*")
    assert json.loads(part.read_text()) == [{"id": 2}, {"id": 1}, {"id": 0}]


def test_bad_lines_have_numbers(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n{')
    assert [(r["line"], r["value"]) for r in readers.bad_lines(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()] == [(3, "broken"), (5, "{")]


def test_lexicon_words_of_bad_files(spark, tmp_path):
    (tmp_path / "list.json").write_text("[1, 2]")
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "good.json").write_text('{"Bok": [], "tiang": 5}')
    of = lambda name: {r[0] for r in readers.read_lexicon_words(spark, str(tmp_path / name)).collect()}
    assert of("good.json") == {"bok", "tiang"} and not of("list.json") and not of("broken.json") and not of("missing.json")


def test_resumed_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, v string").write.parquet(source)
    for more in (None, [(2, "again"), (3, "c")]):
        if more:
            spark.createDataFrame(more, "id long, v string").write.mode("append").parquet(source)
        append_new(spark.readStream.schema("id long, v string").parquet(source), sink, "id", state).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_lexicon_entries_are_small(spark, tmp_path):
    """What entries weigh doesn't grow with the file's other words; as variants, each would have the names of all."""
    words = [f"word{i:06d}{'x' * 40}" for i in range(60_000)]
    (tmp_path / "large.json").write_text(json.dumps({w.title(): [w[::-1]] for w in words}))
    assert readers.read_lexicon(spark, str(tmp_path / "large.json")).where("translations[0] = reverse(word)").count() == len(words)
    plan = readers.read_lexicon(spark, str(tmp_path / "large.json"))._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan


def test_lexicons_that_are_odd(spark, tmp_path):
    cases = {
        '{"B": "x", "a": ["Y"], "b": ["z"], "B": "\\u00c4"}': {"b": ["ä"], "a": ["y"]}, ' { } \n': {}, '{"a": 1, "c": null, "d": {"e": ["f"]}, "g": [["h"], "i", 1e5]}': {"a": [], "c": [], "d": [], "g": ["i"]},
        '{"a": 1}x': {}, '{"a": 1': {}, '{"a": 1,}': {}, '{"a" 1}': {}, "[1]": {}, "": {}, '{"a": NaN}': {}, "{": {}, '{"a": "\\ud800"}': {"a": ["?"]}, '{"a": ' + "9" * 5000 + "}": {"a": []}, "{1: 2}": {}, '{"a": ' + "[" * 100_000: {},
    }
    for i, (text, wanted) in enumerate(cases.items()):
        (tmp_path / f"{i}.json").write_text(text)
        assert {r[0]: r[1] for r in readers.read_lexicon(spark, str(tmp_path / f"{i}.json")).collect()} == wanted, text[:50]
