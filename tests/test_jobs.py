"""File-to-file jobs (CSV in, CSV out), like the reference's batch commands."""

import csv
import glob

from canvass.plans.jobs import enrich_file, enrich_web_file, generate_file, search_file


def _read_csv_dir(path):
    out = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            out.extend(csv.DictReader(f))
    return out


def _places(spark):
    return spark.createDataFrame(
        [("p1", "Alpha Dental", "123 Main St, Austin", 4.8, 52, "https://m/?cid=1", "dentist",
          30.27, -97.74, "https://alpha.example"),
         ("p2", "Beta Smiles", "456 Oak Ave, Austin", 4.5, 9, "https://m/?cid=2", "dentist",
          30.30, -97.70, None)],
        "place_id string, name string, address string, rating double, review_count bigint, "
        "maps_url string, category string, lat double, lng double, website string")


def test_enrich_file_keeps_extra_columns_and_writes_errors(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('Business Name,Business Address,Contact Email,Google Review Rating\n'
                   '"Alpha Dental","123 Main St, Austin",a@x.com,\n'
                   ',"Nowhere",b@x.com,\n'
                   '"Zeta","1 Far Rd",c@x.com,N/A\n', encoding="utf-8")
    out, err = str(tmp_path / "out"), str(tmp_path / "err")
    summary = enrich_file(spark, str(src), out, _places(spark), errors_path=err)
    assert summary == {"total": 3, "skipped_complete": 0, "url_only_fetched": 0,
                       "full_fetched": 2, "failed": 2, "successful": 1}
    rows = _read_csv_dir(out)
    assert [r["Contact Email"] for r in rows] == ["a@x.com", "b@x.com", "c@x.com"]
    assert rows[0]["Google Review Rating"] == "4.8" and rows[0]["Google Maps URL"] == "https://m/?cid=1"
    assert "plan_state" not in rows[0] and "error" not in rows[0] and "row_id" not in rows[0]
    errs = _read_csv_dir(err)
    assert [(e["row"], e["error"]) for e in errs] == [
        ("3", "Missing business name or address"), ("4", "Business not found on Google Maps")]


def test_search_file_append_and_web_and_generate(spark, tmp_path):
    places = _places(spark)
    ds = str(tmp_path / "leads")
    assert search_file(spark, places, "dentist austin", ds, append=True) == 2
    assert search_file(spark, places, "dentist", ds, append=True) == 0
    assert search_file(spark, places, "bakery", str(tmp_path / "none")) == 0
    near = search_file(spark, places, "dentist", str(tmp_path / "near"), location="30.27,-97.74",
                       radius_miles=1)
    assert near == 1
    pages = spark.createDataFrame([("https://alpha.example", "<title>Alpha</title><p>Teeth.</p>")],
                                  "url string, html string")
    web = str(tmp_path / "web")
    enrich_web_file(spark, ds, web, pages, fmt="parquet")
    briefs = sorted(r["research_brief"] for r in spark.read.parquet(web).collect())
    assert briefs == ["Alpha Dental: Teeth.", "No website available"]
    mail = str(tmp_path / "mail")
    generate_file(spark, web, mail, lambda s: [p.upper() for p in s], "P",
                  template="Hi {company_name}: {research_brief}", fmt="parquet")
    texts = sorted(r["generated_email"] for r in spark.read.parquet(mail).collect())
    assert texts == ["HI ALPHA DENTAL: ALPHA DENTAL: TEETH.", "HI BETA SMILES: NO WEBSITE AVAILABLE"]
