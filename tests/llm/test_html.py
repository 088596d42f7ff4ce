import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tracemark.llm import html_extract as H
from tracemark.llm.html_extract import extract, main_text

BODY = " ".join(["It is in the nature of a page that the words of the text are many, and that those of the menu are few and far from it."] * 2)


def test_main_text_of_a_page():
    body = "This is the text of the article, and it is long enough to be told from what stands around it by its words. " * 2
    page = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <script>var a = "</p>";</script><div class="cookie-notice">We use cookies, and this is the notice of that fact.</div><!-- <p>no</p> -->
    <article><h1>Head &eacute; &#x41;</h1><p>{body}</p><p>Short.<br>line</p><p><a href=x>Read more about all the other things</a></p><aside>Related</aside>
    <form><input value="q"><button>Go</button></form><p>{body}<b>un<i>closed</p><table><tr><td>a</td><td>b</td></tr></table>
    <section class="comments"><article><p>{body}</p></article></section></article><div class=sidebar><p>{body}</p></div><footer>&copy; 2020</footer></body></html>"""
    flat = " ".join(body.split())
    assert main_text(page) == "\n\n".join(["Head é A", flat, "Short. line", "Read more about all the other things", flat + " unclosed", "a b"])


def test_a_link_block_does_not_outvote_an_article():
    link = "<p><a href=x>Read more about all of the other things here</a></p>"
    short = ["The harbour opens at six and the first boats leave for the islands soon after that.", "Tickets are sold on board.", "In winter there are none."]
    other = ["Satama avataan kuudelta, ja ensimmäiset laivat lähtevät saarille pian sen jälkeen. " * 3, "Liput myydään laivalla."]
    for paragraphs in (short, other):
        for at in range(len(paragraphs) + 1):
            inside = "".join(f"<p>{p}</p>" for p in paragraphs[:at]) + link + "".join(f"<p>{p}</p>" for p in paragraphs[at:])
            page = f"<body><div><a href=y>Menu</a></div><article>{inside}</article><div>Outside of it</div></body>"
            assert main_text(page).split("\n\n") == [p.strip() for p in (*paragraphs[:at], "Read more about all of the other things here", *paragraphs[at:])]


def test_main_text_without_an_article():
    body = "It is in the nature of a page that the words of the text are many, and that those of the menu are few and far from it. " * 2
    page = f"<body><div><a href=1>One</a> | <a href=2>Two</a></div><div>{body}</div><p>And so on.</p><div>{body}</div><div><a href=3>Terms</a> <a href=4>Imprint</a></div>"
    assert main_text(page).split("\n\n") == [" ".join(body.split()), "And so on.", " ".join(body.split())]
    assert main_text("<p>hello</p>") == "hello" and main_text("a < b & c") == "a < b & c"


def test_pages_that_are_odd(spark):
    pages = [(1, None), (2, ""), (3, "<<<>>>"), (4, "<p"), (5, "<p>x</p>" * 5000), (6, "<script>no end <p>x</p>"), (7, "<div class='a" + "x" * 1000), (8, "&nbsp; &#0; &bogus;"), (9, "<nav>menu <article><p>text of it</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(df).collect()}
    assert len(got) == 9 and got[1] == got[2] == ("", 0) and got[5][0].count("x") == 5000 and got[6][0] == ""
    assert extract(df.limit(0)).isEmpty()


def test_markup_is_a_prior_only():
    menu = "<nav><ul><li><a href=a>First thing</a></li><li><a href=b>Second thing</a></li></ul></nav>"
    # names that would take the whole page
    assert main_text(f'<body><div class="layout-sidebar-right">{menu}<div><p>{BODY}</p><p>More.</p></div></div>') == f"{BODY}\n\nMore."
    assert main_text(f'<body>{menu}<article class="legal"><h1>Terms</h1><p>{BODY}</p></article><footer>c</footer>') == f"Terms\n\n{BODY}"
    assert main_text(f'<form action=x>{menu}<div><p>{BODY}</p></div><div class=sidebar>Side of it</div></form>') == BODY
    # a name with a part of its own, inside
    assert main_text(f'<main><h1>Head</h1><p>{BODY}</p><section id="social-impact"><h2>Impact</h2></section></main>') == f"Head\n\n{BODY}\n\nImpact"
    assert main_text(f'<main><p>{BODY}</p><div class="social-links">Tell all</div><div class="ad-box-2">{BODY}</div></main>') == BODY
    # comments are longer than the article
    assert main_text(f'<article><p>Short one.</p></article><section class="comments"><p>{BODY}</p><p>{BODY}</p></section>') == "Short one."


def test_labels_are_not_membership_of_an_article():
    # links before the text are a menu, a list among the text is text; and a page whose text is outside of what it marks
    menu = "".join(f"<li><a href={i}>Another of the pages</a>" for i in range(4))
    assert main_text(f"<article><h1>Head</h1><ul>{menu}</ul><p>{BODY}</p><p>The end.</p></article>") == f"Head\n\n{BODY}\n\nThe end."
    assert main_text(f"<article><p>{BODY}</p><ul>{menu}</ul></article>") == "\n\n".join([BODY, *["Another of the pages"] * 4])
    assert main_text(f"<article><h2>Teaser</h2></article><div><p>{BODY}</p><p>{BODY}</p></div>") == f"Teaser\n\n{BODY}\n\n{BODY}"
    assert main_text(f"<article><p>{BODY}</p><p><a href=x>One whole link as a paragraph</a></p><p>{BODY}</p></article>").count("\n\n") == 2


NAMED = ("reader-comments", "article-comments", "commentlist", "commentSection", "user-comments-thread", "discussion", "responses", "reader_replies", "siteNotice",
         "cookie-law-info", "toc", "comment-list", "disqus_thread", "CookieBanner", "tableOfContents")


def test_comments_and_notices_of_any_name_in_any_place():
    other = "So this is what I have to say of it, and it is as long as the text of the article, which is not at all what it should be. " * 2
    for name in NAMED:
        for how in ("class", "id"):
            box = f"<div {how}='{name}'><p>{other}</p><p>Yes.</p></div>"
            for page in (f"<article><p>{BODY}</p><p>{BODY}</p>{box}</article>", f"<article>{box}<p>{BODY}</p><p>{BODY}</p></article>", f"<article><p>{BODY}</p><p>{BODY}</p></article>{box}",
                         f"<div><p>{BODY}</p><p>{BODY}</p></div>{box}", f"{box}<div><p>{BODY}</p><p>{BODY}</p></div>"):
                assert main_text(f"<body>{page}</body>") == f"{BODY}\n\n{BODY}", (name, page)
    # states, parts of other words, and what holds the whole text
    for name in ("has-comments", "comments-open", "responsive", "commentary", "noticeable", "toccata", "replay"):
        assert main_text(f"<article class='{name}'><div class='{name}'><p>{BODY}</p></div></article>") == BODY, name
    assert main_text(f"<body><div class='discussion'><p>{BODY}</p><p>{BODY}</p></div><footer>c</footer></body>") == f"{BODY}\n\n{BODY}"


def test_languages_without_a_list():
    russian = "Это текст статьи, и в нём много слов, которые не стоят в меню, а говорят о том, что было на самом деле. " * 2
    finnish = "Satama avataan kuudelta, ja ensimmäiset laivat lähtevät saarille pian sen jälkeen. Liput myydään laivalla. " * 2
    chinese = "港口六点开放，第一批船随后很快开往各个岛屿。船票在船上出售。冬天没有船。" * 6
    for body, menu, short in ((russian, "Главная Новости", "Коротко."), (finnish, "Etusivu Uutiset", "Lyhyesti."), (chinese, "首页 新闻", "简短。")):
        body = body.strip()
        page = f"<body><div><a href=1>{menu}</a></div><div>{menu}</div><div><a href=2>{menu}</a></div><div><p>{body}</p><p>{short}</p></div><div><p>{body}</p></div><div><a href=3>{menu}</a></div>"
        assert main_text(page).split("\n\n") == [body, short, body]


# slow and plain: another parser, and the rules one block at a time with searches over the whole page
class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.text, self.n = [], [], [], 0

    def close_block(self):
        whole = " ".join("".join(t for t, _ in self.text).split())
        if whole:
            linked = sum(len(" ".join(t.split())) for t, a in self.text if a)
            regions = tuple(r for _, r in self.stack if r)
            self.out.append((whole, min(1.0, linked / len(whole)), any(t in ("article", "main") for t, _ in self.stack), regions))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK:
            self.close_block()
        inside = any(t in ("article", "main") for t, _ in self.stack)
        is_region = tag in ("nav", "footer", "aside", "form") or tag == "header" and not inside or any(v in ("ad", "sidebar", "comments") for k, v in attrs if k == "class")
        self.n += is_region
        self.stack.append((tag, self.n if is_region else 0))

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.close_block()
        self.stack.pop()

    def handle_data(self, data):
        self.text.append((data, any(t == "a" for t, _ in self.stack)))


def plain_label(blocks):
    n = range(len(blocks))
    first = []
    words = [re.findall(r"[^\W\d_]+", b[0].lower()) for b in blocks]
    stop = [sum(w in H.STOP for w in ws) for ws in words]
    known = sum(stop[i] for i in n if blocks[i][1] <= 0.5) >= 0.08 * sum(len(words[i]) for i in n if blocks[i][1] <= 0.5)
    for i in n:
        size, links = len(blocks[i][0]), blocks[i][1]
        share = (stop[i] / len(words[i]) if words[i] else 0) if known else 0.2 * bool(re.search("[.!?…。！？।؟]", blocks[i][0]))
        first.append("bad" if links > 0.5 else ("bad" if links else "short") if size < 60 else ("good" if size >= 160 else "near") if share >= 0.2
                     else "near" if share >= 0.12 else "bad" if links else "short")
    void = set()
    weight = [len(b[0]) * (1 - b[1]) for b in blocks]
    for r in sorted({r for b in blocks for r in b[3]}):
        outside = [i for i in n if not set(blocks[i][3]) - void]
        if 2 * sum(weight[i] for i in n if r in blocks[i][3]) > sum(weight) and not any(blocks[i][2] or first[i] == "good" for i in outside):
            void.add(r)
    off = [bool(set(b[3]) - void) for b in blocks]
    inside = [blocks[i][2] and not off[i] for i in n]
    texty = [i for i in n if not off[i] and first[i] != "bad"]
    article = any(inside) and sum(weight[i] for i in texty if inside[i]) >= 0.25 * sum(weight[i] for i in texty)
    begin = min((i for i in n if inside[i] and first[i] in ("good", "near")), default=len(blocks))
    for i in n:
        a = b = i
        while a > 0 and inside[a - 1] and blocks[a - 1][1] > 0.5:
            a -= 1
        while b < len(blocks) - 1 and inside[b + 1] and blocks[b + 1][1] > 0.5:
            b += 1
        if off[i] or article and not inside[i]:
            first[i] = "bad"
        elif article and first[i] == "bad" and not (blocks[i][1] > 0.5 and b - a + 1 >= 3 and i < begin):
            first[i] = "short"
    places = [i for i in n if inside[i] or not article]
    good = []
    for i in n:
        if first[i] in ("good", "bad"):
            good.append(first[i] == "good")
            continue
        at = places.index(i)
        marks = [(abs(at - k), first[j]) for k, j in enumerate(places) if first[j] == "good" or first[j] == "bad" and not article]
        left = min(((d, f) for (d, f), k in ((m, k) for k, m in enumerate(marks)) if k < sum(first[j] == "good" or first[j] == "bad" and not article for j in places[:at])), default=None)
        right = min(((d, f) for k, (d, f) in enumerate(marks) if k >= sum(first[j] == "good" or first[j] == "bad" and not article for j in places[:at])), default=None)
        sides = [s for s in (left, right) if s]
        if not sides or {f for _, f in sides} == {"good"}:
            good.append(True)
        elif {f for _, f in sides} == {"bad"}:
            good.append(False)
        else:
            good.append(first[i] == "near" or left[0] == right[0] or min(left, right)[1] == "good")
    return good


def random_page(rng):
    prose = "the cat and the harbour of a town are in it for that is as with by this from at an not have which but water boats lead early".split()

    def text():
        out = " ".join(rng.choice(prose if rng.random() < 0.7 else ["Home", "News", "Login", "Xylo"]) for _ in range(rng.choice((1, 3, 8, 15, 40))))
        return out + rng.choice(("", ".")) if rng.random() < 0.7 else f"<a>{out}</a> " + rng.choice(("", out))

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{text()}</p>"
        tag = rng.choice(("div", "div", "section", "article", "nav", "aside", "footer", "header", "form", "main", "div class=ad", "div class=sidebar", "section class=comments"))
        return f"<{tag}>" + "".join(node(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"
    return "<body>" + "".join(node(3) for _ in range(rng.randint(1, 5))) + "</body>"


def test_against_brute_force():
    rng, full, mixed = random.Random(4), 0, 0
    for _ in range(1500):
        page = random_page(rng)
        plain = Plain()
        plain.feed(page)
        plain.close_block()
        kept = plain_label(plain.out)
        assert main_text(page) == "\n\n".join(b[0] for b, k in zip(plain.out, kept, strict=True) if k), page
        full += any(kept)
        mixed += any(b[2] and not k for b, k in zip(plain.out, kept, strict=True))
    assert full > 1000 and mixed > 100  # in many pages a label is not that of the article


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, f"<p>{BODY}</p>")] * 3 + [(2, f"<p>{BODY} {'so it is. ' * 200_000}</p>")], "page_id long, html string")
    got = extract(df).collect()
    assert len(got) == 4 and {r["text"] for r in got if r["page_id"] == 1} == {BODY} and max(r["n_chars"] for r in got) > 1_900_000
