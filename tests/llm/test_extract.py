import html as entities
import re

import pytest
from helpers import folder_of

from docketflow.llm import extract

LONG = "This is the long text of the article and it is here for the reader to see what is in it."


@pytest.mark.parametrize(("page", "blocks"), [
    (None, []), ("", []), ("<p", []), ("<article>&eacute; &amp;amp; x</article>", ["é &amp; x"]),
    (f"<article><h1>T</h1><p>{LONG}<p>Short<br>line\n two</article><footer>{LONG}</footer>", ["T", LONG, "Short line two"]),
    (f"<nav>{LONG}</nav><aside>{LONG}</aside><form>{LONG}</form><header>{LONG}</header><main><p>{LONG}</main>", [LONG]),
    (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><div id=comments><p>{LONG}</div><article><p>{LONG}</article><p>End</article>", [LONG, "End"]),
    (f"<div class='has-sidebar content'><article><script>var t='</p><p>{LONG}';</script><style>p{{}}</style><p>{LONG}<!-- <p>no</p> --></article></div>", [LONG]),
    (f"<body><div class=cookie-notice>{LONG}</div><div><p>{LONG}</p><p>ok</p><p>{LONG} {LONG} {LONG}</p></div><p><a href=x>{LONG}</a></p>", [LONG, "ok", f"{LONG} {LONG} {LONG}"]),
    (f"<article><p>{LONG}<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><p title='a > b'>{LONG}</article>", [LONG, LONG]),
    (f"<article><p>{LONG} <span class='ad'>buy <b>now</b></span>So it ends. <em class=lead>Yes</em></p><p><span id=share>Share <p>{LONG}</article>", [f"{LONG} So it ends. Yes", LONG]),
    (f"<article><p>{LONG}</p><!-- never closed <p>{LONG}</p>", [LONG]), (f"<article><p>{LONG}</p><script>{LONG}", [LONG]),
])
def test_pages(page, blocks):
    assert extract.main_blocks(page) == blocks


def test_open_blocks_inherit():
    p, off = extract.PAGE, extract.OFF
    good, bad, open_ = extract.GOOD, extract.BAD, extract.OPEN
    assert extract.second_pass([p] * 5, [good, open_, open_, open_, bad]) == [True, True, False, False, False]
    assert extract.second_pass([p, off, p], [good, bad, open_]) == [True, False, False]
    assert extract.second_pass([p] * 3, [bad, open_, bad]) == [False] * 3
    assert extract.second_pass([extract.ARTICLE] * 3, [bad, open_, open_]) == [False, True, True]


def test_test_data_against_the_article_element(spark, queries):
    folder = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries["op4_html_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_tables(spark, tmp_path, queries):
    deep = "<div>" * 20_000 + "</p></li></b>" * 20_000 + f"<article><p>{LONG}</p></article>"
    pages = [(1, "u", None), (1, None, ""), (None, "u", f"<article>{LONG}"), (4, "u", deep), (5, "u", "<" * 50_000), (6, "u", "<a b='" * 2000)]
    df = spark.createDataFrame([(*p, "t", 5) for p in pages], "page_id long, url string, html string, text string, key int")
    rows = queries["op4_html_extraction"](spark, folder_of(tmp_path, pages=df)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, len(LONG)), (1, 0), (1, 0), (4, len(LONG)), (5, 0), (6, 0)]
    assert extract.extract(df.limit(0)).count() == 0


PROSE = f"{LONG} {LONG} {LONG}"
CODES = "zx81 qk4 plm " * 20


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<main><p>{PROSE}</p></main><article class='teaser'><h3>Next story</h3></article>", [PROSE]),
    (f"<main><p>{LONG}</p><p>{LONG}</p></main><article><h3>Next story</h3></article><article><h3>More</h3></article>", [LONG, LONG]),
    (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><article class=teaser><p>{LONG}</p></article>", [PROSE, PROSE, LONG]),
    (f"<main><p>{PROSE}</p><article><p>{PROSE}</p><p>{PROSE}</p></article><p>Next story</p></main>", [PROSE] * 3),
    (f"<article><p>{PROSE}</p></article><div><p>{LONG}</p></div>", [PROSE]),
    (f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div>", [LONG]),
    (f"<article><p><a href=x>{LONG}</a><p>{CODES}<p><a href=y>{LONG}</a></article><article><p>{PROSE}</article>", [PROSE]),
])
def test_elements_are_evidence_only(page, blocks):
    assert extract.main_blocks(page) == blocks


GOOD = "This is the main text of the page and it is long enough to be seen as the text that the reader came for, with all of the words that are needed in it. " * 2
MORE = "Another part of the story that was written by the same people and is as long as it has to be for this test of the reader, and more of it. " * 2
MENU = "<nav>Home About</nav><div><a href=x>Link one</a> <a href=y>Link two</a></div>"
SIGN_UP = "<form><p>Please sign up for the letter that we send to all of the readers of this page each week.</p><input></form>"


@pytest.mark.parametrize("page, texts", [
    (f"<body><form>{MENU}<main><p>{GOOD}</p></main><button>Go</button></form></body>", [GOOD]),  # a form around the page
    (f"<body><article><p>{GOOD}</p>{SIGN_UP}<p>{MORE}</p></article>{SIGN_UP}</body>", [GOOD, MORE]),
    (f"<body><svg/><p>{GOOD}</p><svg><text>chart</text></svg><p>{MORE}</p></body>", [GOOD, MORE]),
    (f"<body><button>Menu<p>{GOOD}</p><button>OK</button><p>{MORE}</p></body>", [GOOD, MORE]),  # never closed
    (f"<body><div><select><option>One</div><p>{GOOD}</p></body>", [GOOD]),
    (f"<article><h1>Book</h1><article><p>{GOOD}</p></article><article><p>{MORE}</p></article></article>", ["Book", GOOD, MORE]),  # chapters
    (f"<article><p>{GOOD}</p><article><p>{MORE}</p></article></article>", [GOOD]),  # a comment
    (f"<body><div class='search-wrapper'>{MENU}<p>{GOOD}</p></div></body>", [GOOD]),
    (f"<body><p>{GOOD}</p><p>{GOOD}</p><div id='comments'><p>{MORE}</p></div></body>", [GOOD, GOOD]),
])
def test_what_wraps_or_breaks_a_page_does_not_lose_its_text(page, texts):
    assert extract.main_text(page) == "\n\n".join(t.strip() for t in texts)


@pytest.mark.parametrize("text", [
    "Il governo ha presentato ieri la nuova legge di bilancio, che prevede investimenti per le scuole. I sindacati chiedono interventi maggiori e annunciano una protesta nazionale nelle prossime settimane.",
    "Правительство представило вчера новый закон о бюджете, который предусматривает вложения в школы. Профсоюзы требуют большего и объявляют о протесте по всей стране в ближайшие недели. Ответ ожидается завтра.",
    "政府昨天公布了新的预算法案，其中包括对学校的投资。工会要求采取更多措施，并宣布在未来几周内举行全国性抗议活动。政府预计将于明天作出回应，届时将公布更多细节。专家认为，这项法案可能会影响许多家庭的生活。",
    "ทางการได้เผยแพร่ร่างกฎหมายงบประมาณฉบับใหม่เมื่อวานนี้ ซึ่งรวมถึงการลงทุนในโรงเรียน. สหภาพแรงงานเรียกร้องให้มีมาตรการเพิ่มเติมและประกาศการประท้วงทั่วประเทศในสัปดาห์หน้า. รัฐบาลจะตอบพรุ่งนี้.",
    "قدمت الحكومة أمس مشروع الموازنة الجديد الذي يتضمن استثمارات في المدارس. وتطالب النقابات بإجراءات أكبر وتعلن عن احتجاج وطني في الأسابيع المقبلة. ومن المتوقع أن ترد الحكومة غدا.",
    "Η κυβέρνηση παρουσίασε χθες τον νέο νόμο για τον προϋπολογισμό, που προβλέπει επενδύσεις για τα σχολεία. Τα συνδικάτα ζητούν περισσότερα και ανακοινώνουν διαμαρτυρία σε όλη τη χώρα τις επόμενες εβδομάδες.",
])
def test_pages_without_articles_in_languages_whose_stop_words_are_not_listed(text):
    page = f"<html><body>{MENU}<div><p>{text}</p><p>{text}</p></div><div>Copyright 2024</div><footer>{text}</footer></body></html>"
    assert extract.main_text(page) == f"{text}\n\n{text}"
