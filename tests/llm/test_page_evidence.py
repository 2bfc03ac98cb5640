from ledgermark.llm.language_query import page_evidence


def test_every_page_and_the_whole_tag_count(spark):
    long = "<html class='" + "x" * 3_000 + "' lang='fr-CA'>"
    rows = [
        (1, "https://a.example/1", "<p>none</p>"), (2, "https://b.example/1", "<html lang=de>"), (3, "https://c.example/1", '<HTML LANG="en-GB">'), (4, "https://c.example/1", "<html lang=en>"),
        (5, "https://a.example/2", long), (6, "https://a.example/3", "<html><p lang=de>"), (7, "https://a.example/4", "<html><html lang=es>"),
        (8, "https://a.example/5", "<html lang=fr>"), (9, "https://a.example/5", "<html lang=de>"), (10, "https://a.example/6", None),
    ]
    got = page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["doc_id"]: r["markup"] for r in got} == {1: "en", 2: "fr", 3: None, 4: "es", 5: "fr", 6: None}
    assert {(r["url"], r["site"]) for r in got if r["doc_id"] == 1} == {("https://a.example/1", "a.example")}


def test_many_open_tags_take_linear_time(spark):
    rows = [(1, "https://a.example/1", "<html lang" * 200_000)]
    assert page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).first()["markup"] is None
