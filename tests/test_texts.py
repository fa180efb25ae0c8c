"""Stored pages as articles and claim sentences against plain loops."""

import json
import random
import re

from tidewire.functions import texts as X
from tidewire.sources import scans


def test_pages_as_articles(spark):
    """Every source of a title, lists of JSON-LD, broken JSON, and bodies of any length."""
    article = {"@type": "NewsArticle", "headline": "From data", "description": "Told by data", "datePublished": "2024-01-02", "publisher": {"name": "The Data"}}
    script = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    body = "".join(f"<p class='x'>Paragraph {i} &amp; more</p>" for i in range(30))
    plain = "\n".join(f"Paragraph {i} & more" for i in range(30))
    head = "<title>The title</title><meta property='og:title' content='Open title'><meta name=\"description\" content=\"Described\"><meta property='og:locale' content='fr_FR'>"
    pages = {
        1: (script(article) + head + body, ("From data", "Told by data", plain, "2024-01-02", "The Data", "fr")),
        2: (script({"@type": "Organization", "headline": "No"}) + script([{"@type": "WebSite"}, {"@type": "Report", "headline": "Second"}]) + head, ("Second", "Described", "", None, "www.a.example", "fr")),
        3: (script("{broken") + script([]) + head + body, ("Open title", "Described", plain, None, "www.a.example", "fr")),
        4: ("<title> Only\n a title </title><pre>no</pre>" + body, ("Only a title", " ".join(plain[:400].split()), plain, None, "www.a.example", None)),
        5: ("", (None, None, "", None, "www.a.example", None)),
        6: (None, (None, None, "", None, "www.a.example", None)),
        7: (script({"@type": "Article", "headline": ""}) + "<meta name='twitter:title' content='Short'><script>var p = '<p>not this</p>'</script><p>one<p>two</article>", ("Short", "one two", "one\ntwo", None, "www.a.example", None)),
    }
    rows = spark.createDataFrame([(i, "https://www.a.example/x?y", h, "t") for i, (h, _) in pages.items()], "page_id int, url string, html string, title string")
    got = {r.page_id: (r.title, r.description, r.body, r.published_at, r.source, r.language) for r in scans.page_articles(rows).collect()}
    host = lambda v: tuple("a.example" if x == "www.a.example" else x for x in v)
    assert got == {i: host(v) for i, (_, v) in pages.items()}
    assert scans.page_articles(rows, 12).filter("page_id = 4").first().body == "\n".join(plain.split("\n")[:12])


def claims_by_loop(title, text):
    words = lambda s: list(dict.fromkeys(w for w in re.findall(r"[a-z][a-z\-]{2,}", s.lower()) if w not in X.CLAIM_STOPWORDS))
    mark = lambda s: " ".join(sorted(words(s))[:12])
    norm = lambda s: re.sub(r"\s+", " ", s).strip(" ")
    head = norm(title or "")
    good = [s for s in map(norm, re.split(r"(?<=[.!?])\s+|(?<=:)\s+", text or "")) if len(s) >= 35 and len(words(s)) >= 4 and (any(v in s.lower() for v in X.CLAIM_VERBS) or head == "" or s == head)]
    four = (([head] if head and len(words(head)) >= 4 and head not in good else []) + good)[:4]
    return [s for i, s in enumerate(four) if mark(s) and mark(s) not in [mark(x) for x in four[:i]]]


def test_claims(spark):
    rng = random.Random(3)
    verbs = list(X.CLAIM_VERBS)
    word = lambda: rng.choice(["minister", "border", "troops", "talks", "the", "of", "market", "inflation", "said", "aid-convoy", "3,000", "rising", "rates", rng.choice(verbs)])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 14))) + rng.choice([".", "!", "?", ":", ";"])
    rows = [(i, rng.choice([None, "", sentence()]), rng.choice([None, "", "  "]) if rng.random() < 0.1 else rng.choice([" ", "\n", "  "]).join(sentence() for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    rows += [(200, rows[5][1], (rows[5][2] or "") * 2)]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, title string, body string").select("id", X.claims("title", "body").alias("c")).collect()}
    assert got == {i: claims_by_loop(t, b) for i, t, b in rows}
    assert sum(map(len, got.values())) > 100
