import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() >= 200


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and "identify" in queries


def test_it_works_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lexiloom.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "lexiloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import lexiloom

    monkeypatch.delattr(lexiloom, "llm", raising=False)
    made = importlib.reload(entry)
    assert "identify" in made.queries() and not [n for n in made.queries() if n.startswith("op") and n[2].isdigit()]
    monkeypatch.undo()
    importlib.reload(entry)


def test_command_line_usage():
    from lexiloom.cli import main

    assert main([]) == 2 and main(["--nonsense", "x"]) == 2


def test_command_line(spark, monkeypatch, capsys):
    import io
    import json
    import types

    from lexiloom import cli

    monkeypatch.setattr(cli, "SparkSession", types.SimpleNamespace(builder=spark.builder))
    assert cli.main(["fresh", "bread"]) == 0
    assert json.loads(capsys.readouterr().out)["normalizedText"] == "fresh bread"
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b"fresh bread\r\nold fish\n\xff\xfe\nnot read\n")))
    assert cli.main(["--pretty", "-"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out)["normalizedText"] == "fresh bread old fish" and out.count("\n") > 5
    assert cli.main(["--model", "/no/such/model", "x"]) == 2
    monkeypatch.setattr(cli, "identify", lambda *a, **b: 1 / 0)
    assert cli.main(["x"]) == 1
