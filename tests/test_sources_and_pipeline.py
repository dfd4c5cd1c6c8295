"""Readers, schema, sinks, the stage graph and streams."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.operators import filters as fl
from folioscope.plans.pipeline import Pipeline, Settings
from folioscope.sources import registry, sinks
from folioscope.streaming import streams


@pytest.fixture
def lines(tmp_path):
    rows = [{"title": f" T{i} ", "update": f"20{i % 10:02d}-01-15", "abstract": "cats run with wolves and bears " * 3 + f"word{'x' * (i % 3 + 1)}",
             "authors": [["Roe", "Ann"], ["Doe", f"Bob{'b' * (i % 4)}"]], "categories": "cs.AI math.X"} for i in range(40)]
    rows += [{"title": "bad date", "update": "nonsense", "abstract": "x", "authors": [["A", "B"]]}, {"title": "no date", "abstract": "y", "authors": [["A", "B"]]}]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    return str(path)


MAPPING = {"update": "date", "abstract": "raw_text"}


def test_load(spark, lines):
    docs = registry.load(spark, lines, MAPPING)
    assert docs.columns == [*schema.COLUMNS, "is_valid"] and docs.count() == 41
    first = docs.orderBy("title").first()
    assert first.title == "T0" and first.author_names == ["ANN, ROE", "BOB, DOE"] and first.categories == ["cs.AI", "math.X"]
    assert registry.invalid(docs).count() == 1 and registry.valid(docs).count() == 40
    some = registry.load(spark, lines, MAPPING, {"date_range": {"start": "2003-01-01", "end": "2004-12-31"}, "categories": ["cs.AI"], "custom": lambda d: F.length("title") > 1})
    assert some.count() == 8
    with pytest.raises(ValueError):
        registry.load(spark, ["a.json", "b.csv"])
    with pytest.raises(ValueError):
        fl.apply_filters(docs, {"nope": 1})


def test_registry():
    assert {".json", ".jsonl", ".parquet", ".csv"} <= registry.supported_extensions()
    assert registry.compatible(["JSON", ".jsonl"]) and not registry.compatible([]) and registry.reader_for("zip") is None
    with pytest.raises(ValueError):
        registry.register_reader("json")(lambda spark, paths: None)


def test_author_shapes(spark):
    for value, ddl, want in [(["a b ", "c"], "array<string>", ["A B", "C"]), ([("x y",)], "array<struct<name:string>>", ["X Y"]), ("a; b;", "string", ["A", "B"]), ("solo", "string", ["SOLO"])]:
        df = spark.createDataFrame([(value,)], f"authors {ddl}")
        assert schema.to_schema(df).first().author_names == want


def test_pipeline(spark, lines, tmp_path):
    p = Pipeline.from_files(spark, lines, Settings(months=60, docs_per_topic=10, rounds=3, high=1.0, low=0), mapping=MAPPING)
    assert p.get("network").count() >= 1
    assert p.get("author_scores").count() >= 2 and p.get("doc_scores").count() == 40
    assert p.get("models.metrics").count() >= 2 and p.get("tree.clusters").count() >= 4
    assert p.status()["models"] and "tree" in p.downstream("models")
    p.configure(months=24)
    assert not p.status()["models"] and p.status()["network"]
    with pytest.raises(ValueError):
        p.configure(nothing=1)
    p.export(str(tmp_path / "out"), ("parquet", "csv"))
    assert spark.read.parquet(str(tmp_path / "out/parquet/network")).count() == p.get("network").count()


def test_graph_files(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src bigint, dst bigint")
    sinks.write_pairs(e, str(tmp_path / "pairs"))
    assert spark.read.csv(str(tmp_path / "pairs"), sep="\t").count() == 2
    sinks.write_graphml(e, str(tmp_path / "g.graphml"))
    assert {tuple(r) for r in registry.read_graph(spark, str(tmp_path / "g.graphml")).collect()} == {(1, 2), (1, 3)}


def test_streams(spark, tmp_path):
    ev = spark.sql("SELECT timestamp'2020-01-01 10:00:00' + make_interval(0,0,0,0,0,id*10) AS ts, id % 2 AS user_id, 'c' AS kind, 1.5D AS value FROM range(20)")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    read = lambda: streams.read_events(spark, str(tmp_path / "ev"), "*.parquet", ev.schema)
    q = streams.windowed_counts(read(), "ts", ["kind"], "value").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("win").collect()] == [(20, 30.0)]
    q = streams.session_counts(read(), "ts", "user_id").writeStream.format("memory").queryName("ses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.table("ses").collect()) == [(0, 10), (1, 10)]
    papers = spark.createDataFrame([(1, [1, 2]), (2, [2, 1, 3])], "paper_id bigint, author_ids array<bigint>")
    papers.write.parquet(str(tmp_path / "pp"))
    live = streams.read_events(spark, str(tmp_path / "pp"), "*.parquet", papers.schema)
    assert {tuple(r) for r in streams.incremental_edges(live, str(tmp_path / "e"), str(tmp_path / "c")).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}


def test_pipeline_to_the_end_and_back(spark, lines, tmp_path):
    folder = str(tmp_path / "run")
    settings = Settings(months=60, docs_per_topic=10, rounds=3, high=1.0, low=0, cut=0.5, smallest_cluster=1, alpha=0.2, eta=0.1)
    p = Pipeline.from_files(spark, lines, settings, folder, MAPPING)
    topics = p.get("models.phi").select("topic").distinct().count()
    assert p.get("embedding").count() == topics and p.get("tree.closure").where(f"node = {2 * topics - 2}").count() == topics
    cells = {r.node for r in p.get("links.cells").collect()}
    table = {(r.i, r.j): r.p for r in p.get("links.table").collect()}
    assert set(table) == {(a, b) for a in cells for b in cells} and all(abs(table[a, b] - table[b, a]) < 1e-12 for a, b in table)
    assert p.get("links.scores").count() == p.get("network").count()
    assert p.get("diffused_docs").select("doc_id").distinct().count() == 40 and p.get("doc_scores").count() == 40
    p.get("documents")
    assert p.get("network.yearly").agg(F.sum("cnt")).first()[0] == 40 and p.get("vocabulary").count() == len({w for r in p.get("tokens").collect() for w in r.tokens})
    again = Pipeline.restore(spark, folder)
    assert again.settings == settings and again.status()["links"] and again.get("network").count() == p.get("network").count()
    again.configure(cut=0.9)
    assert not again.status()["tree"] and again.status()["models"] and not (tmp_path / "run/tree_linkage").exists() and (tmp_path / "run/models_phi").exists()
    assert Pipeline.restore(spark, folder).settings.cut == 0.9
    with pytest.raises(Exception):
        Pipeline.restore(spark, str(tmp_path / "nothing"))


def test_files_of_a_folder(spark, lines, tmp_path):
    e = spark.createDataFrame([(2, 1), (3, 1)], "src bigint, dst bigint")
    (tmp_path / "graphs").mkdir()
    (tmp_path / "graphs/a.graphml").write_text("\n".join(r.value for r in sinks.graphml_lines(e).collect()))
    folder = str(tmp_path / "graphs")
    assert sinks.convert_graphs(spark, folder) == ["viz_a.graphml"] and sinks.convert_graphs(spark, folder) == []
    sinks.graph_to_pairs(spark, f"{folder}/viz_a.graphml", str(tmp_path / "pairs"))
    assert spark.read.csv(str(tmp_path / "pairs"), sep="\t").count() == 2
    assert registry.discover(spark, str(tmp_path)) == [lines] and registry.discover(spark, str(tmp_path / "none")) == []


def test_relevant_tokens_and_filter_counts(spark, lines):
    p = Pipeline.from_files(spark, lines, Settings(relevance_topics=2, relevance_terms=2, rounds=2, high=1.0, low=0, filters={"date_range": {"start": "2003-01-01", "end": "2006-12-31"}, "categories": ["cs.AI"]}), mapping=MAPPING)
    assert {w for r in p.get("tokens").collect() for w in r.tokens} <= {r.term for r in p.get("vocabulary").collect()} and p.get("vocabulary").count() <= 4
    assert [(r.step, r["filter"], r.rows) for r in p.filter_counts().orderBy("step").collect()] == [(0, None, 40), (1, "date_range", 16), (2, "categories", 16)]
    days = [r.date for r in registry.valid(registry.load(spark, lines, MAPPING), by_date=True).collect()]
    assert days == sorted(days)


def test_models_by_name(spark):
    from folioscope.operators import topic_models as tp

    docs = spark.createDataFrame([(i, ["a", "b", "c"][: i % 3 + 1]) for i in range(12)], "d int, t array<string>")
    fitted = tp.fit_topics(docs, "t", 3, rounds=2, alpha=0.3, eta=0.2, first_topic=5)
    got = fitted.parameters()
    assert got["topics"] == 3 and got["vocabulary"] == 3 and got["eta"] == pytest.approx(0.2) and {r.topic for r in fitted.phi(docs).collect()} == {5, 6, 7}
    with pytest.raises(ValueError):
        tp.fit_topics(docs, "t", 3, kind="none")
    with pytest.raises(ValueError):
        tp.register_model("lda")(lambda *a: None)
