"""The command-line jobs, end to end on a few hundred raw lines."""

import json

import pytest

from slotlake.jobs import etl, score, train


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")

    def write(name, lines):
        (folder / name).write_bytes("\n".join("\t".join(map(str, line)) for line in lines).encode("utf-16"))

    bookings = [["booking_id", "member_id", "cdate", "restaurant_id", "datetime", "people", "purpose", "gender",
                 "status", "is_required_prepay_satisfied", "return90"]]
    for i in range(390):
        hour, minute = 11 + i % 13, 30 * (i % 2)
        bookings.append([i, f"m{i % 9}", "7/24/2013,,11:30:00,AM", f"r{i % 5}",
                         f"7/{25 + i % 6}/2013,,{(hour - 1) % 12 + 1}:{minute:02d}:00,{'AM' if hour < 12 else 'PM'}",
                         1 + i % 2, ["Friends", "請選擇", "慶生"][i % 3], "MF"[i % 2], "ok", 0, 0])
    write("train.csv", bookings)
    write("member.csv", [["id", "is_vip", "gender", "birthdate", "city", "has_google", "has_yahoo", "has_weibo", "cdate"]]
          + [[f"m{i}", 0, "M", "1980-05-06" if i else "0000-00-00", "0", 0, 0, 0, "4/1/2012 0:30"] for i in range(8)])
    write("restaurant_revised.csv", [["id", "is_hotel", "country", "currency", "city", "cityarea", "name", "abbr", "tel",
                                      "opening_hours", "good_for_family", "accept_credit_card", "parking", "outdoor_seating",
                                      "wifi", "wheelchair_accessible", "price1", "price2", "lat", "lng", "timezone", "locale", "cdate"]]
          + [[f"r{i}", 0, "tw", "TWD", "%", "請選擇", "n", "a", "t", "o", 1, 0, 1, 0, 1, 0, 100.0, 200.0, 25.0, 121.0,
              "Asia/Taipei", "zh_TW", "4/1/2012 0:30"] for i in range(4)])
    return folder


def test_from_raw_text_to_predictions(spark, raw, tmp_path):
    out = str(tmp_path / "lake")
    etl.main([str(raw), out])
    features = spark.read.parquet(f"{out}/features_ready")
    assert len(features.columns) == 35 and features.count() == 390
    assert features.filter("lead_time is null").count() == 0
    assert features.filter("age is null").count() > 0  # an invalid birthdate, a member without a row
    bundle = str(tmp_path / "bundle")
    train.main([f"{out}/features_ready", bundle, "--size", "3"])
    assert spark.read.parquet(f"{bundle}-metrics/summary").count() == 3
    metrics = lambda name: spark.read.parquet(f"{bundle}-metrics/{name}")
    assert all(metrics(f"cross_validation/{band}").count() == 1 for band in ("lunch", "afternoon", "dinner"))
    assert metrics("report/dinner").count() >= 6 and metrics("confusion").count() > 3
    requests = tmp_path / "requests"
    requests.mkdir()
    (requests / "a.json").write_text(json.dumps({"input_data": {
        "columns": ["reservation_hour", "party_size"], "index": [0, 1], "data": [[12, 2], [4, 2]]}}))
    (requests / "b.json").write_text("nothing")
    score.main([bundle, str(requests), str(tmp_path / "answers")])
    document = json.loads(spark.read.json(str(tmp_path / "answers/predictions")).first()["document"])
    assert [row[2] for row in document["predictions"]["data"]] == ["lunch", "_unmatched"]
    assert spark.read.json(str(tmp_path / "answers/rejected")).first()["problem"] == "unreadable"
    score.main([bundle, f"{out}/features_ready", str(tmp_path / "streamed"), "--stream"])
    assert spark.read.parquet(str(tmp_path / "streamed")).count() == 390
    score.main([bundle, f"{raw}/train.csv", str(tmp_path / "scored"), "--lake", out, "--encoding", "UTF-16"])
    scored = spark.read.parquet(str(tmp_path / "scored"))
    assert scored.count() == 390 and scored.filter("subset <> '_unmatched' and reservation_half_hour is null").count() == 0
