from codeloom.llm import html_extract as X
from codeloom.llm.labelled_pages import TRAINING, labelled_pages


def best_by_force(scores):
    sums = [(sum(a + b for a, b in scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    return max([s for s, _, _ in sums] + [0.0])


def test_linear_scan_finds_the_greatest_sum():
    import random

    rng = random.Random(1)
    for _ in range(200):
        scores = [(0.0, rng.uniform(-3, 3)) for _ in range(rng.randrange(0, 12))]
        i, j = X.best_region(scores)
        assert abs(sum(a + b for a, b in scores[i:j]) - best_by_force(scores)) < 1e-9


def test_all_maximal_regions():
    """Against the definition: regions whose every proper part scores less, and that no such region holds."""
    import random

    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        whole = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        good = [(i, j) for (i, j), s in whole.items() if s > 0 and all(whole[a, b] < s for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j))]
        want = [(i, j) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good)]
        assert sorted((i, j) for _, i, j in X.maximal_regions(x)) == sorted(want)


def words_kept(pages):
    """(recall, precision) by blocks, weighed by words."""
    hit = want = got = 0
    for page, content in pages:
        kept = X.extract(page).split("\n\n")
        n = lambda texts: sum(len(t.split()) for t in texts)
        hit, want, got = hit + n(t for t in kept if t in content), want + n(content), got + n(kept)
    return hit / want, hit / got


def test_labelled_pages():
    recall, precision = words_kept(labelled_pages(TRAINING))
    assert recall > 0.99 and precision > 0.97, (recall, precision)


def test_held_out_pages_of_all_layouts():
    pages = labelled_pages(range(500, 540))
    recall, precision = words_kept(pages)
    assert recall > 0.98 and precision > 0.97, (recall, precision)
    recall, precision = words_kept([p for p in pages if "<article" not in p[0] and "<main" not in p[0]])
    assert recall > 0.98 and precision > 0.96, (recall, precision)


def test_nothing_of_an_article_is_lost():
    links = "".join(f"<li><a href={i}>An older story {i}</a></li>" for i in range(30))
    body = "The council met on Monday and decided to close the lower bridge for the winter."
    got = X.extract(f"<body><article><p>{body}</p><ul>{links}</ul><p>Closing remark here.</p></article></body>")
    assert got.startswith(body) and got.endswith("Closing remark here.")
    got = X.extract(f"<body><div><p>{body}</p><ul>{links}</ul><p>Closing remark here.</p></div></body>")
    assert got.startswith(body) and got.endswith("Closing remark here.")
    nav = "".join(f"<a href={i}>Page {i}</a> " for i in range(50))
    assert X.extract(f"<body><div><p>short one</p></div><nav>{nav}</nav><div><p>second part of the article body</p></div></body>") == "short one\n\nsecond part of the article body"


def test_names_with_words_of_their_own_are_no_boilerplate():
    for name in ("share-price", "social-history", "related-work", "comment-on-law", "sharePrice"):
        page = f"<body><article><h1>Title of it</h1><p>Some prose comes first here.</p><div class='{name}'><p>This belongs to the article.</p></div></article></body>"
        assert X.extract(page) == "Title of it\n\nSome prose comes first here.\n\nThis belongs to the article.", name


def test_no_markup_is_left():
    assert X.extract('<p title="oops>text of it</p>') == "text of it"
    assert X.extract('<p title="oops>text of it <a href="x">and a link</a> ends.</p>') == "text of it and a link ends."
    assert X.extract("<p title='a > b' class=\"c\">text</p>") == "text"
    assert X.extract("<p title=it's>text <b class='x'>bold</b></p>") == "text bold"


def test_a_form_around_the_page_is_no_boilerplate():
    assert X.extract("<body><form id=f><p>The whole page stands in one form, as some servers do it.</p><p>Second part of it.</p></form></body>") == "The whole page stands in one form, as some servers do it.\n\nSecond part of it."


def test_articles_of_own_tables(spark, sf):
    import html
    import re

    from codeloom.llm.queries import op9_html_extraction

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op9_html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(w for w in want if w) and r.n_chars == len(r.text)


def test_regions_by_name():
    page = (
        "<body class='has-comments'><div class='site-header'>Brand</div><div id='sidebar-left'><p>Read more of this.</p></div><article class='post comments-open'>"
        "<header class='entry-header'><h1>Title &amp; more</h1></header><p>First  part<br>of it, long enough to be prose.</p><div class='ad-slot'>Buy</div><p>Second part, after the advert.</p></article>"
        "<article class='comment'><p>Nice one.</p></article><section id='comments'><p>I think so too.</p></section><div class='cookie-bar'>We use cookies.</div></body>"
    )
    assert X.extract(page) == "Title & more\n\nFirst part of it, long enough to be prose.\n\nSecond part, after the advert."


def test_short_lead_before_long_regions_in_an_article():
    lead, rest = "lead " * 30 + "ends.", "rest " * 200 + "ends."
    links = "".join(f"<li><a href={i}>An older story to read</a></li>" for i in range(60))
    for noise in (f"<aside><p>{'more ' * 150}</p></aside>", f"<div class='related'><ul>{links}</ul></div>", f"<form>{'<div><img></div>' * 300}<p>Your mail</p>{'<div><img></div>' * 300}</form>"):
        for holder in ("article", "main"):
            for first, last in ((lead, rest), (rest, lead)):
                page = f"<body><nav>Home News</nav><{holder}><h1>Title</h1><p>{first}</p>{noise}<p>{last}</p></{holder}><footer>All rights reserved.</footer></body>"
                assert X.extract(page) == f"Title\n\n{first}\n\n{last}"


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "plain  words\nonly &amp; more"), (5, "u", "<p>cut off <b>here"), (6, "u", "<script>x<p>no</p>"), (7, "u", "<nav>a b c</nav>"), (8, "u", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = {r.page_id: r.text for r in X.main_texts(df).collect()}
    assert [got[i] for i in (1, 2, 4, 5, 6, 7)] == ["", "", "plain words only & more", "cut off here", "", ""]
    assert len(got[8]) == 199_999
    assert X.main_texts(df.limit(0)).count() == 0
    twice = sorted((r.page_id, r.text) for r in X.main_texts(df.union(df)).collect())
    assert twice == sorted([*got.items(), *got.items()])
