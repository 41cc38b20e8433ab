"""Readers, writers, the service boundary and the stream on temporary files."""

import json
import time

import pytest

from blockwise.operators import sinks
from blockwise.sources import files, service
from blockwise.streaming import responses as stream


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_documents(spark, tmp_path):
    raw = put(tmp_path / "raw.json", {"a": ["p2", "p1"], "b": []})
    assert [tuple(r) for r in files.read_block_index(spark, raw).orderBy("record_index").collect()] == [("a", 0, "p2"), ("a", 1, "p1")]
    pub = put(tmp_path / "pub.json", {"p1": {"title": "T", "authors": [{"name": "N", "org": "O"}]}, "p2": {}})
    p = {r.id: r for r in files.read_publications(spark, pub).collect()}
    assert p["p1"].authors[0].name == "N" and p["p2"].title is None
    put(tmp_path / "x_example.json", {"a": [["p1"], ["p2"]]})
    t = files.truth_path(str(tmp_path))
    assert sorted(map(tuple, files.read_truth(spark, t, "list").collect())) == [("a", "0", "p1"), ("a", "1", "p2")]
    put(tmp_path / "x_ground_truth.json", {"a": {"k": ["p1", "p2"]}})
    assert files.truth_path(str(tmp_path)).endswith("_ground_truth.json")
    assert files.read_truth(spark, files.truth_path(str(tmp_path))).count() == 2
    with pytest.raises(Exception, match="JSON map"):
        files.read_block_index(spark, put(tmp_path / "bad.json", "nothing")).collect()


def test_predictions(spark, tmp_path):
    flat = put(tmp_path / "flat.json", {"wei_0": ["p1"], "wei_1": ["p2", "p3"]})
    assert sorted(map(tuple, files.read_predictions(spark, flat, "flat").collect())) == [("wei", 0, 0, "p1"), ("wei", 1, 0, "p2"), ("wei", 1, 1, "p3")]
    lines = put(tmp_path / "l.jsonl", '{"name":"a","clusters":[["p1"]]}\n\n{"name":"a","clusters":[["p2"],["p1"]]}\n')
    assert files.read_prediction_lines(spark, lines).count() == 2
    many = put(tmp_path / "many.jsonl", "".join(json.dumps({"name": f"n{i % 7}", "clusters": [[f"p{i}"]]}) + "\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    assert {(r.name, r.paper_id) for r in files.read_prediction_lines(spark, many).collect()} == {(f"n{i % 7}", f"p{i}") for i in range(3993, 4000)}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="bad record in .*m.jsonl"):
        files.read_prediction_lines(spark, put(tmp_path / "m.jsonl", '{"name":"a","clusters":[]}\n{"name":"b"}')).collect()
    assert files.result_folder(["title"]) == "single_field/title" and files.result_folder(["a", "b"]) == "2_fields/a+b"


def test_sinks_round_trip(spark, tmp_path):
    cl = spark.createDataFrame([("a", 0, "x", 0, "p1"), ("a", 1, "y", 0, "p2"), ("a", 1, "y", 1, "p3")], "name string, cluster_index int, label string, pos int, paper_id string")
    sinks.write_prediction_lines(cl, str(tmp_path / "pred"))
    back = files.read_prediction_lines(spark, str(tmp_path / "pred"))
    assert sorted(map(tuple, back.collect())) == [("a", 0, 0, "p1"), ("a", 1, 0, "p2"), ("a", 1, 1, "p3")]
    truth = spark.createDataFrame([("a", "p1", "t"), ("a", "p2", "t"), ("a", "p3", "u")], "name string, paper_id string, label string")
    blocks = truth.select("name", "paper_id")
    ann = sinks.annotated_results(cl, truth, blocks)
    assert sorted(map(tuple, files.truth_from_annotated(ann, blocks).collect())) == [("a", "t", "p1"), ("a", "t", "p2"), ("a", "u", "p3")]
    with pytest.raises(Exception, match="does not fit"):
        sinks.annotated_results(cl.where("pos = 0"), truth, blocks).collect()
    sinks.write_csv(truth, str(tmp_path / "csv"), ["label", "name"])
    assert files.read_rows(spark, str(tmp_path / "csv"), "label string, name string").count() == 3
    sinks.write_csv(truth.where("false"), str(tmp_path / "none"), ["label"])
    assert not (tmp_path / "none").exists()
    assert "N/A" in sinks.markdown_table(spark.createDataFrame([("a", None)], "name string, x double"))


def test_markdown_table_writes_all_rows(spark):
    df = spark.range(306).selectExpr("concat('n', lpad(305 - id, 3, '0')) as name", "id / 2 as x").repartition(5)
    lines = sinks.markdown_table(df).split("\n")
    assert len(lines) == 308 and lines[2:] == sorted(lines[2:])
    assert sinks.markdown_table(df, 200).endswith("106 further rows are left out.")


def test_service(spark):
    with pytest.raises(TimeoutError):
        service.with_deadline(0.05, time.sleep, 1)
    q = spark.createDataFrame([(1, "good"), (2, "bad")], "request_id long, prompt string")

    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r.request_id: (r.content, r.error) for r in service.remote(q, call, 5).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "ValueError: no")}


def test_stream_keeps_latest(spark, tmp_path, data):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = "(1L, 7L, 'old', 'stop', timestamp'2024-01-01 00:00:00'), (1L, 7L, 'old', 'stop', timestamp'2024-01-01 00:00:00')"
    cols = "t(response_id, request_id, content, finish_reason, received_at)"
    spark.sql(f"select * from values {part} as {cols}").write.parquet(src)
    stream.keep_latest(stream.response_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    spark.sql(f"select * from values (2L, 7L, 'new', 'stop', timestamp'2024-01-01 01:00:00') as {cols}").write.mode("append").parquet(src)
    stream.keep_latest(stream.response_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    assert [(r.request_id, r.response_id, r.content) for r in stream.read_latest(spark, out).collect()] == [(7, 2, "new")]
    # a version without a pointer, as a crash leaves it, is not read
    spark.sql(f"select * from values (3L, 7L, 'lost', 'stop', timestamp'2025-01-01 01:00:00') as {cols}").write.parquet(out + "/data/v=99/part=0")
    assert [r.response_id for r in stream.read_latest(spark, out).collect()] == [2]
    spark.sql(f"select * from values (4L, 8L, 'x', 'stop', timestamp'2024-01-02 01:00:00'), (5L, 7L, 'older', 'stop', timestamp'2024-01-01 00:30:00') as {cols}").write.mode("append").parquet(src)
    stream.keep_latest(stream.response_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.request_id, r.response_id) for r in stream.read_latest(spark, out).collect()) == [(7, 2), (8, 4)]


def folder(tmp_path):
    """A data folder of two blocks with two authors each, and a prediction that is right for the first one only."""
    raw, pub, truth, pred = {}, {}, {}, {}
    for k, name in enumerate(("ada byron", "bo derek", "cy young", "di moss", "ed poe", "flo hyde", "gil frost")):
        ids = [f"{k}p{i}" for i in range(8)]
        raw[name] = ids
        truth[name] = {"x": ids[:4], "y": ids[4:]}
        pred[name] = [ids[:4], ids[4:]] if k % 2 == 0 else [ids[:2], ids[2:]]
        for i, p in enumerate(ids):
            pub[p] = {"title": f"waves {'deep' if i < 4 else 'graph'} {i}", "authors": [{"name": name.title(), "org": "Ox" if i < 4 else "Cam"}, {"name": f"N{i // 4}", "org": ""}]}
    put(tmp_path / "sna_valid_raw.json", raw)
    put(tmp_path / "sna_valid_pub.json", pub)
    put(tmp_path / "sna_valid_ground_truth.json", truth | {"di moss": [raw["di moss"][:4], raw["di moss"][4:]]})
    return str(tmp_path), put(tmp_path / "pred.json", pred), raw


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from blockwise import cli

    data, pred, raw = folder(tmp_path)
    per, totals = cli.evaluate(spark, data, pred)
    f1 = {r.name: r.pairwise_f1 for r in per.collect()}
    assert f1["ada byron"] == 1.0 and f1["bo derek"] < 1.0 and totals["blocks"] == 7
    assert cli.evaluate(spark, data, pred, partial=True)[1]["evaluated"] == 7
    dry = cli.cluster(spark, data, "ada byron")
    assert dry["papers"] == 8 and dry["authors"] == 2 and dry["with_coauthors"] == 8 and dry["prompt_tokens"] > 0
    good = put(tmp_path / "answer.txt", "```json\n" + json.dumps({"assignments": {str(i): str(i // 4) for i in range(8)}, "labels": {"0": "a"}}) + "\n```")
    assert cli.cluster(spark, data, "ada byron", good)["pairwise_f1"] == 1.0
    with pytest.raises(ValueError, match="missing"):
        cli.cluster(spark, data, "ada byron", put(tmp_path / "short.txt", {"assignments": {"0": "0"}}))
    with pytest.raises(ValueError, match="invalid"):
        cli.cluster(spark, data, "ada byron", put(tmp_path / "bad.txt", "no answer"))
    with pytest.raises(ValueError, match="unknown names"):
        cli.cluster(spark, data, "nobody")
    rows = cli.sweep(spark, data, 2)
    assert rows.where("field_combination = 'title+organization' or field_combination = 'organization+title'").count() == 7
    monkeypatch.setattr("sys.argv", ["blockwise-evaluate", "--data", data, "--prediction", pred, "--output", str(tmp_path / "csv")])
    cli.evaluate_main()
    assert json.loads(capsys.readouterr().out)["blocks"] == 7
    assert files.read_rows(spark, str(tmp_path / "csv"), per.schema).count() == 7


def test_router_command_writes_a_model_that_gives_the_same_probabilities(spark, tmp_path):
    from blockwise import cli
    from blockwise.operators import router as rt

    data, pred, _ = folder(tmp_path)
    got = {r.name: r.predicted_probability for r in cli.router(spark, data, pred, str(tmp_path / "model")).collect()}
    assert len(got) == 1
    model, settings = sinks.read_model(spark, str(tmp_path / "model"))
    assert settings["target"] == "reliable_085" and 0 < settings["threshold"] < 1
    blocks, cards, _ = cli.load(spark, data)
    again = {r.name: r.predicted_probability for r in rt.predict(model, rt.block_features(cards, blocks)).collect()}
    assert all(again[n] == pytest.approx(p) for n, p in got.items())
    assert rt.importance(model).count() == len(rt.FEATURES)


def test_settings():
    from blockwise.sources.settings import Settings, model_of

    s = Settings("/d", "/r")
    assert s.data_dir == "/d/NA_Demo/SND/valid" and s.refinement_root("/x/title/") == "/r/intra_cluster/NA_Demo/title"
    assert model_of("deepseek") == "deepseek-v4-flash" and model_of("other") == "deepseek-chat" and model_of("other", "m") == "m"


def test_truth_of_neither_shape_fails(spark, tmp_path):
    good = put(tmp_path / "t.json", {"a": {"k": ["p1"]}, "b": [["p2"], ["p3"]]})
    assert sorted(map(tuple, files.read_truth(spark, good, "auto").collect())) == [("a", "k", "p1"), ("b", "0", "p2"), ("b", "1", "p3")]
    with pytest.raises(Exception, match="truth must map"):
        files.read_truth(spark, put(tmp_path / "u.json", {"a": "p1"}), "auto").collect()


def test_result_folders_and_latest_files(spark, tmp_path):
    for c, n in (("single_field/title", "a"), ("2_fields/title+org", "a"), ("2_fields/title+org", "b")):
        (tmp_path / "res" / c).mkdir(parents=True, exist_ok=True)
        put(tmp_path / "res" / c / f"{n}.json", {"name": n, "paper_count": 3})
    rows = files.read_results(spark, str(tmp_path / "res"), "name string, paper_count int")
    assert sorted(r.name for r in rows.collect()) == ["a", "a", "b"] and rows.where("source_file like '%single_field%'").count() == 1
    newest = {r.key: r.path for r in files.latest_files(spark, str(tmp_path / "res"), r"([^/]+)\.json$").collect()}
    assert set(newest) == {"a", "b"}
