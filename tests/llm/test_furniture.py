"""Furniture of a few small hosts, with and without the votes of their links."""

from __future__ import annotations

from weblattice.llm.furniture import classed_links, furniture_lines, main_text

PAGES = "id long, run_id long, fetch_id long, url string, title string, h1 string, headings array<struct<level:int,text:string>>, body_text string, labels int"
LINKS = "id long, run_id long, source_fetch_id long, anchor_text string, dom_region string, dom_path string, template_signature string"


def site(spark, noisy=()):
    pages, links, k = [], [], 0
    for host in range(4):
        for n in range(12):
            f = host * 100 + n
            title = f"Story {'abcdefghijkl'[n]} of the valley {'wxyz'[host]}"
            text = "\n".join(["Home", "Products", title, f"Once a {'abcdefghijkl'[n] * 3} walked over {'wxyz'[host] * 4} hills and nobody saw it.", "Terms"])
            pages.append((f, host, f, f"https://site{host}.test/{n}", title, None, None, text, 1))
            for anchor, region, path in (("Home", "nav", "html > body > nav > a"), ("Products", "nav", "html > body > nav > a"), ("Terms", "footer", "html > body > footer > a")):
                k += 1
                links.append((k, host, f, anchor, "main" if n in noisy else region, path, None))
    pages += [(900, None, 900, None, None, None, None, "Alone here.", 1), (901, 0, 901, None, None, None, None, None, 1)]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(links, LINKS)


def test_menu_and_footer_lines_win(spark):
    pages, links = site(spark)
    got = {tuple(r) for r in furniture_lines(pages, links).collect()}
    assert got == {(host * 100 + n, line) for host in range(4) for n in range(12) for line in (1, 2, 5)}
    kept = {r.page_id: r for r in main_text(pages, links).collect()}
    assert kept[900].main_text == "Alone here." and 901 not in kept and kept[0].removed_lines == 3


def test_wrong_regions_are_outvoted_by_the_path(spark):
    pages, links = site(spark, noisy=(0, 1, 2))
    assert {r.c for r in classed_links(links).where("anchor_text != 'Terms'").collect()} == {"nav"}
    assert furniture_lines(pages, links).count() == 144


def test_empty_tables(spark):
    pages, links = site(spark)
    assert furniture_lines(pages.limit(0), links.limit(0)).collect() == []
    assert {r.page_id for r in main_text(pages, links.limit(0)).collect()} >= {0, 900}
