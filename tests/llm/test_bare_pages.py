"""Text outside every container belongs to the page's body."""

from sparkloom.llm import html_extract


def test_top_level_text_is_scored_and_extracted(spark):
    long = "a long article of many words " * 20
    pages = {
        1: (f"<h1>T</h1><p>{long}</p><div>short note</div>", ["T", long.strip(), "short note"]),
        2: (f"<html><body><div>short note</div></body></html><p>{long}</p>", ["short note", long.strip()]),
        3: (f"{long}<br><div>short note</div>", [long.strip(), "short note"]),
        4: ("<p>only this</p>", ["only this"]),
    }
    df = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, (h, _) in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert got == {i: "\n".join(want) for i, (_, want) in pages.items()}
    assert html_extract.winning_paths(df).where("host = 'h1.org'").first()["paths"] == ["body"]
