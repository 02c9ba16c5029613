"""Pages of the registry hold a fixed number of entries."""

from scanledger.plans import registry
from scanledger.sources import io


def test_pages_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id as page_id", "concat('https://h/', id) as url").write.parquet(f"file://{tmp_path}/pages.parquet")
    parse, pages = io.parse_registry_pages, []
    monkeypatch.setattr(io, "parse_registry_pages", lambda df: pages.append(df) or parse(df))
    got = registry.QUERIES["registry_pages"](spark, f"file://{tmp_path}").collect()
    assert sorted(int(r.name) for r in got) == list(range(5000)) and pages[0].count() == 50
