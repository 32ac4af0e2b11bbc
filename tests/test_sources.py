import codecs
import json

import pytest
from pyspark.sql import functions as F

from slotlake.schema import BOOKING_RECORD, columns
from slotlake.sources import delimited, payload

SCHEMA = columns("id INT, name STRING, price DOUBLE")


def write(path, text, encoding):
    path.mkdir()
    bom = codecs.BOM_UTF16_LE if encoding == "utf-16-le" else b""
    (path / "part.csv").write_bytes(bom + text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding, option", [("utf-16", "UTF-16"), ("utf-16-le", "UTF-16LE"), ("utf-8", "UTF-8")])
def test_tab_separated_text(spark, tmp_path, encoding, option):
    text = "id\tname\tprice\n1\t餐廳\t2.5\n2\ttoo\t1\tmany\n3\tshort\n4\tbad\tx\n"
    path = write(tmp_path / "raw", text, encoding)
    good, bad = delimited.split_bad_lines(delimited.read_delimited(spark, path, SCHEMA, encoding=option))
    assert sorted((r["id"], r["name"], r["price"]) for r in good.collect()) == [(1, "餐廳", 2.5), (3, "short", None), (4, "bad", None)]
    assert bad.count() == 1
    assert good.select("id").count() == 3


def test_rejected_lines_are_kept_and_counted(spark, tmp_path):
    path = write(tmp_path / "raw", "id\tname\tprice\n1\ta\t2.5\n2\ttoo\t1\tmany\n", "utf-8")
    with pytest.warns(UserWarning, match="1 malformed"):
        assert delimited.read_raw(spark, path, SCHEMA, encoding="UTF-8", rejects=str(tmp_path / "rejects")).count() == 1
    assert "too" in spark.read.parquet(str(tmp_path / "rejects")).first()["_corrupt_record"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.0), (2, None, None)], SCHEMA)
    delimited.write_delimited(df, str(tmp_path / "out"))
    back = delimited.read_raw(spark, str(tmp_path / "out"), SCHEMA, sep=",", encoding="UTF-8")
    assert sorted(map(tuple, back.collect())) == [(1, "a,b", 2.0), (2, None, None)]


def request(columns, index, data):
    return json.dumps({"input_data": {"columns": columns, "index": index, "data": data}}, ensure_ascii=False)


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([
        ("names", request(["reservation_hour", "dining_purpose", "lat", "unknown"], [7, 9], [[12, "生日\"慶祝", 25.05, 1], [None, None, None, 2]])),
        ("positions", request([18, 0, 1], None, [[19, 2, "a"]])),
        ("ragged", request(["a", "b"], [0], [[1]])),
        ("index", request(["a"], [0, 1], [[1]])),
        ("broken", "{not json"), ("position", request([18, 99], [0], [[19, 2]])), ("null row", request(["a"], [0, 1], [[1], None])),
        ("empty", request(["a"], [], [])),
    ], "request_id string, payload string")


def test_payload_validation(requests):
    got = {r["request_id"]: r["problem"] for r in payload.parse_payloads(requests).collect()}
    assert got == {"names": None, "positions": None, "ragged": "row width", "index": "index length", "broken": "unreadable",
                   "position": "column position", "null row": "row width", "empty": None}


def test_payload_rows(requests):
    valid, rejected = payload.split_payloads(requests)
    got = {(r["request_id"], r["row_label"]): r for r in payload.payload_rows(valid, BOOKING_RECORD).collect()}
    assert got[("names", 7)]["reservation_hour"] == 12 and got[("names", 7)]["dining_purpose"] == '生日"慶祝'
    assert got[("names", 7)]["lat"] == 25.05 and got[("names", 7)]["party_size"] is None
    assert got[("names", 9)]["reservation_hour"] is None
    assert got[("positions", 0)]["reservation_hour"] == 19 and got[("positions", 0)]["party_size"] == 2
    assert rejected.count() == 5


def test_emitted_documents(spark):
    df = spark.createDataFrame([("r", 1, 11, None, 'say "hi"', 0.5), ("r", 0, 10, 39, None, None), ("r", 2, 12, 1, "x", 1.0)],
                               "request_id string, position int, row_label bigint, slot int, text string, p double")
    whole = payload.emit_payloads(df, ["slot", "text", "p"]).collect()
    assert json.loads(whole[0]["document"]) == {"predictions": {
        "columns": ["slot", "text", "p"], "index": [10, 11, 12], "data": [[39, None, None], [None, 'say "hi"', 0.5], [1, "x", 1.0]]}}


def test_every_request_is_answered_once(spark):
    many = spark.range(10_001).selectExpr("'long' AS request_id", "id AS position", "id AS row_label", "id % 48 AS slot")
    asked = spark.createDataFrame([("long",), ("empty",)], "request_id string")
    got = {r["request_id"]: json.loads(r["document"])["predictions"] for r in payload.emit_payloads(many, ["slot"], requests=asked).collect()}
    assert got["long"]["index"] == list(range(10_001)) and got["empty"] == {"columns": ["slot"], "index": [], "data": []}


def test_record_validation(spark):
    df = spark.createDataFrame([(1, "12", "a"), (2, "noon", None)], "id int, reservation_hour string, dining_purpose string")
    wanted = type(BOOKING_RECORD)([f for f in BOOKING_RECORD if f.name in ("reservation_hour", "dining_purpose")])
    got = {r["id"]: (r["reservation_hour"], r["problem"]) for r in payload.validate_records(df, wanted).collect()}
    assert got == {1: (12, None), 2: (None, "reservation_hour,dining_purpose")}


def test_record_has_26_fields():
    assert len(BOOKING_RECORD) == 26


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(request(["reservation_hour"], [0], [[12]]), encoding="utf-8")
    (tmp_path / "two.json").write_text(request(["reservation_hour"], [0], [[13]]), encoding="utf-8")
    parsed = payload.parse_payloads(payload.read_payload_files(spark, str(tmp_path)))
    assert parsed.count() == 2 and parsed.filter(F.col("problem").isNull()).count() == 2
