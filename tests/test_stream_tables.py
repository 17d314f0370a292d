import pytest

from webgleaner.catalog.streams import QUERIES


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("folder", [False, True])
def test_tables_of_one_file_or_a_folder(spark, tmp_path, files, folder):
    if files > 1 and not folder:
        pytest.skip("one file only")
    page = "<main><p>" + "words of a page " * 20 + '<a href="/next">next</a></p></main>'
    rows = [(i, f"https://a.example/p{i}", page) for i in range(6)]
    made = str(tmp_path / ("pages.parquet" if folder else "parts"))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(files).write.parquet(made)
    if not folder:
        next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    # A neighbour with a similar name is not read.
    spark.createDataFrame([(9, "https://b.example/", page)], "page_id bigint, url string, html string").write.parquet(
        str(tmp_path / "more_pages.parquet")
    )
    arrived = QUERIES["t1_page_arrival"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.fetch_method, r.links_found) for r in arrived) == [(i, "httpx", 1) for i in range(6)]
    new = QUERIES["t2_new_urls"](spark, str(tmp_path)).collect()
    assert sorted(r.norm_url for r in new) == [f"https://a.example/p{i}" for i in range(6)]
