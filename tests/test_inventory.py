from __future__ import annotations

from rillstone.sources import inventory
from tests.conftest import rows

TEXT = "\n".join(
    [
        "# comment",
        "# another",
        "",
        "site_no\tstation_nm \tstate_cd\tsite_type\tstatus\tparm_cd",
        "15s\t50s\t2s\t7s\t8s\t5s",
        "1\tUpper\tCO\tST\tactive\t00060",
        "2\tLower\t\tST\tinactive\t00060",
        "3\tShort\tCO",
        "4\tLong\tCO\tST\tactive\t00060\tx",
        "5\t\tCO\tST\tactive\t00060",
        "6\tWell\tUT\tGW\tactive\t00060",
        "7\tOther\tUT\tST\tactive\t00065",
        "",
    ]
)
COLUMNS = ["site_no", "station_nm", "state_cd", "site_type", "status", "parm_cd"]


def read(spark, tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.rdb").write_text(text)
    return inventory.read_inventory_lines(spark, str(tmp_path))


def test_parse_drops_bad_lines(spark, tmp_path):
    lines = read(spark, tmp_path, a=TEXT, b="# only\nsite_no\tstation_nm\n", c="")
    parsed = inventory.parse_inventory(lines, COLUMNS)
    assert [r[0] for r in rows(parsed.select("site_no"))] == ["1", "2", "5", "6", "7"]
    assert parsed.filter("station_nm = 'Upper'").count() == 1
    reject = {r["file"][-5:]: (r["n_lines"], r["n_rejected"]) for r in inventory.inventory_rejects(lines).collect()}
    assert reject == {"a.rdb": (7, 2)}


def test_windows_line_ends_and_missing_columns(spark, tmp_path):
    lines = read(spark, tmp_path, a=TEXT.replace("\n", "\r\n"))
    parsed = inventory.parse_inventory(lines, ["site_no", "altitude", "parm_cd"])
    assert rows(parsed.select("site_no", "altitude", "parm_cd"))[0] == ("1", None, "00060")


def test_labels(spark, tmp_path):
    parsed = inventory.parse_inventory(read(spark, tmp_path, a=TEXT, b=TEXT), COLUMNS)
    assert rows(inventory.site_labels(parsed)) == [
        ("Lower (2)", "2"),
        ("Other, UT (7)", "7"),
        ("Upper, CO (1)", "1"),
        ("Well, UT (6)", "6"),
    ]


def test_discovery(spark, tmp_path):
    parsed = inventory.parse_inventory(read(spark, tmp_path, a=TEXT), COLUMNS)

    def found(*a, **k):
        return [r[0] for r in rows(inventory.discover_sites(parsed, *a, **k).select("site_no"))]

    assert found([" co ", "ut", ""]) == ["1", "5", "7"]
    assert found(["CO", "UT"], variables=["00060"]) == ["1", "5"]
    assert found(["UT"], status="active") == ["7"]


def test_catalog_fallback_and_labelled_readings(spark):
    assert inventory.catalog_from_mapping(spark, {" ": "1", "x": ""}).count() == len(inventory.DEFAULT_SITES)
    assert inventory.catalog_from_mapping(spark, None).count() == 3
    catalog = spark.createDataFrame([("A", "1"), (" ", "2"), ("C", " ")], "label string, site_no string")
    readings = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], "site_no string, v double")
    assert rows(inventory.label_readings(readings, catalog)) == [("1", 1.0, "A")]
    assert len(rows(inventory.label_readings(readings, catalog, "left"))) == 3
