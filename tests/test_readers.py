"""Readers of point files and evaluations: layouts, gaps and empty files."""

import json

import pytest

from icewake.sources import ais

P = {"mmsi": 3, "LAT": 76.0, "lng": "21", "time": "2024-01-15 11:00:00"}


def test_headers_without_a_known_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,my_lat_deg,pos_long,other_lat\n1,70.5,20,9\n2,,20,9\n3,x,20,9\n")
    assert [(r["mmsi"], r["lat"], r["lon"]) for r in ais.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, 70.5, 20.0)]
    assert tuple(ais.csv_totals(spark, str(tmp_path / "a.csv")).first()) == (3, 1)
    (tmp_path / "b.csv").write_text("mmsi,lat,lon\n")
    assert tuple(ais.csv_totals(spark, str(tmp_path / "b.csv")).first()) == (0, 0)


def test_folders_prefer_json_only_if_it_has_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,lat,lon\n1,70.5,20\n")
    (tmp_path / "b.json").write_text("[]")
    ids = lambda prefer: sorted(r["mmsi"] for r in ais.read_folder(spark, str(tmp_path), prefer).collect())
    assert ids(False) == ids(True) == [1]
    (tmp_path / "c.json").write_text(json.dumps([P]))
    assert ids(False) == [1] and ids(True) == [3]


def test_nested_records(spark, tmp_path):
    layouts = [[P], {"data": [P, {"code": 1}]}, [[[P]], []], [{"data": [P]}, P, 7, None, "x"], {"data": {"no": "list"}}, [{"data": [[P]]}]]
    for k, x in enumerate(layouts):
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "empty.json").write_text("")
    rows = ais.read_json_records(spark, f"{tmp_path}/*.json").collect()
    assert len(rows) == 6 and {(r["mmsi"], r["lat"], r["lon"]) for r in rows} == {(3, 76.0, 21.0)}
    (tmp_path / "deep.json").write_text(json.dumps([[[[[[P]]]]]]))
    with pytest.raises(Exception, match="nested deeper"):
        ais.read_json_records(spark, f"{tmp_path}/deep.json").collect()
    assert ais.read_json_records(spark, f"{tmp_path}/deep.json", depth=6).count() == 1


def test_lines_of_a_month(spark, tmp_path):
    lines = [json.dumps(P | {"time": f"2024-0{m}-15 11:00:00"}) for m in (1, 1, 2)] + ["{bad", "", "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    count = lambda *a: ais.read_json_lines(spark, str(tmp_path / "a.jsonl"), *a)[0].count()
    assert (count(), count("202401"), count("202401", 1), count("202403")) == (3, 2, 1, 0)
    assert ais.read_json_lines(spark, str(tmp_path / "a.jsonl"), "202403")[1].first()[0] == 1


def test_evaluations_go_out_and_come_in(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ('say "b", c', None, "x")], "s string, delta double, t string")
    ais.write_csv(rows, f"file://{tmp_path}/e", ["t", "delta", "s", "more"])
    back = ais.read_evaluation(spark, f"file://{tmp_path}/e", ["Delta"])
    assert back.columns == ["t", "delta", "s", "more"] and dict(back.dtypes)["delta"] == "double"
    assert {(r["s"], r["delta"], r["t"], r["more"]) for r in back.collect()} == {("a", 1.5, None, None), ('say "b", c', None, "x", None)}
    with pytest.raises(Exception):
        ais.write_csv(rows, f"file://{tmp_path}/e")
