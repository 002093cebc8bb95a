"""Chat formatting, URL filters, decontamination, language, HTML, quality: brute force and edge cases."""

import hashlib
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultline.llm import chat_format, decontaminate, html_text, lang_id, quality
from faultline.llm.url_filters import judge_urls

CONV = "conv_id long, turn long, role string, text string, formatted string"
DOC = "doc_id long, text string, lang string, source string, n_words string"


# --- chat formatting -------------------------------------------------------------------------------------------------

def rows_of(df):
    return {r.conv_id: r for r in df.collect()}


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[SAYS]", "[/ROLE]", "<~/s>", "[~~INST]", "~", "[", "<", "]", "a\n", " ", "é🙂", "\\"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "[SAYS]x", None])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))])
            rows.append((conv, turn, role, text, "clash"))
    out = chat_format.format_conversations(spark.createDataFrame(rows, CONV))
    said = rows_of(chat_format.read_back(out))
    for conv, r in rows_of(out).items():
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert r.round_trip and r.n_turns == len(mine)
        assert [(t.role, t.text) for t in said[conv].turns] == mine
        assert said[conv].loss_text == "".join(t for role, t in mine if role == "assistant")
        spans = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert len(spans) == sum(role == "assistant" for role, _ in mine)
        for role, text in mine:  # no control string of a text stays as it is
            assert r.formatted.count("<s>") == sum(role == "assistant" for role, _ in mine)


def test_chat_escapes_only_conflicts(spark):
    rows = [(1, 0, "user", "plain [x] <b> text", ""), (1, 1, "assistant", "see </s> there", ""), (2, 0, "user", "<~/s>", "")]
    out = rows_of(chat_format.format_conversations(spark.createDataFrame(rows, CONV)))
    assert out[1].formatted == "[INST]plain [x] <b> text[/INST]<s>see <~/s> there</s>"
    assert (out[1].escaped_turns, out[1].escape_passes) == (1, 1)
    assert out[2].formatted == "[INST]<~~/s>[/INST]"


def test_chat_nulls_ties_repeats_empty(spark):
    rows = [(None, 0, "user", "a", ""), (3, None, "user", "first", ""), (3, 1, "user", "b", ""), (3, 1, "assistant", "c", ""), (3, 1, "user", "b", "")]
    out = rows_of(chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, CONV))))
    assert [(t.role, t.text) for t in out[3].turns] == [("user", "first"), ("assistant", "c"), ("user", "b"), ("user", "b")]
    assert len(out[None].turns) == 1
    assert chat_format.format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_chat_very_long_text(spark):
    text = "word [ < ~ " * 200_000 + "</s>"
    out = chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", text, "")], CONV))
    said = chat_format.read_back(out).first()
    assert said.loss_text == text


# --- URL filters -----------------------------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("a.b", "", "block"), ("b", "/x", "allow"), ("B", "/x", "block"), (None, "/", "block"), ("c", None, "block")]


def judge(url):
    """The rule by trying all of them."""
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = {}
    for h, p, v in RULES:
        if h is not None and p is not None:
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits[h, p] = max(v, fits.get((h, p), v))
    if not fits:
        return host, path, None, "allow"
    h, p = max(fits, key=lambda x: (len("".join(x)), len(x[0])))
    return host, path, h + p, fits[h, p]


URLS = [None, "", "no scheme", "http://", "://com/", "http://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "http://x.www.example.com/en/a",
        "http://example.com", "http://example.com?/en/", "https://a.net/es/1", "https://a.net/ES/1", "ftp://q.a.b", "ftp://q.a.b/x/y", "http://b/x", "http://zcom/",
        "http://É.com/é", "http://a.b/" + "p/" * 5000, "http://" + "l." * 5000 + "com/", "http://user@example.com:80/en/", "http://x.com/a://b.net/es/",
        "http://example.com/\n/en", "http://com."]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls_against_all_rules(spark, limit):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(judge_urls(pages, rules, keep=("page_id",), broadcast_bytes=limit).collect())
    assert [tuple(r)[1:] for r in got] == [judge(u) for u in URLS + URLS]


def test_urls_empty_tables(spark):
    pages = spark.createDataFrame([("http://a.com/",)], "url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in judge_urls(pages, rules).collect()] == [("a.com", "/", None, "allow")]
    assert judge_urls(pages.limit(0), rules).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == w[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add("null" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part", [4_000_000, 200])
def test_benchmark_hits_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", part)
    rng = random.Random(3)
    vocab = ["a", "b", "été", "x1", "Q", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!\n", "-"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 13, 14, 30]))) for i in range(20)] + [(7, say(20)), (None, "the null item"), (99, None), (98, "...")]
    docs = [(i, say(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + say(5), "en", "s", "clash") for i in range(40)]
    docs += [(100, None, None, None, None), (101, "", "en", "s", ""), (101, "", "en", "s", ""), (None, "xTHE\0null ITEM", "en", "s", "")]
    found = decontaminate.find_benchmark(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    for r in found.collect():
        n, hit, ids = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.item_ids) == (n, hit, ids)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(len(words_of(r.text[s.start:s.end])) for s in r.spans) == hit


def test_benchmark_bounds_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", "")], DOC)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.find_benchmark(docs, items, max_benchmark_bytes=5)
    assert not decontaminate.find_benchmark(docs, items.limit(0)).first().contaminated
    assert decontaminate.find_benchmark(docs.limit(0), items).count() == 0


# --- language --------------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    tongues = {"aa": "ka to mi ne so".split(), "bb": "zu wö pel gra dri".split(), "cc": "ши мо ка ту".split()}
    say = lambda t, n=40: " ".join("".join(rng.choice(tongues[t]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(t := rng.choice(list(tongues))), t, "s", "") for i in range(150)] + [(900, "x", None, "s", "")]
    prototypes = lang_id.learn(spark.createDataFrame(rows, DOC))
    assert sorted(prototypes) == ["aa", "bb", "cc"]
    tests = [(i, say(t := rng.choice(list(tongues))), t, "s", "") for i in range(60)]
    odd = [(70, None, "aa", "", ""), (71, "", "aa", "", ""), (72, "12 !? _", "aa", "", ""), (73, say("aa", 100_000), "aa", "", ""), (73, say("aa"), "aa", "", "")]
    got = {r.doc_id: r for r in lang_id.identify(spark.createDataFrame(tests + odd, DOC).withColumn("score", F.lit("clash")), prototypes).collect()}
    assert all(got[i].lang_pred == t for i, _, t, _, _ in tests)
    assert [got[i].lang_pred for i in (70, 71, 72, 73)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[70].score == 0


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", "")], DOC)
    assert lang_id.learn(docs) == {}
    assert lang_id.identify(docs, {}).first().lang_pred == "und"
    assert lang_id.identify(docs.limit(0), {}).count() == 0


def test_language_blocks_add_up(monkeypatch):
    text = "ein langer text " * 200
    whole = lang_id.Space().bundle(text)
    monkeypatch.setattr(lang_id, "_BLOCK", 100)
    assert (lang_id.Space().bundle(text) == whole).all()


# --- HTML ------------------------------------------------------------------------------------------------------------

W = {"word:p": 3.0, "word:h1": 3.0, "word:furniture": -3.0, "tag:p": -0.05, "tag:div": -0.2}


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a<b>b</b> &nbsp; c<br>d<p>e", "ab c d\ne"),
    ("<script>no</script><style>no</style><!-- no --><p>yes</p><!-- open", "yes"),
    ("<nav>m m m</nav><article><h1>T</h1><p>x &lt;i&gt;</p><aside>no</aside><form>no</form><p>y</p></article><footer>f f</footer>", "T\nx <i>\ny"),
    ("<article><p>one</p><div class='ad-slot'>" + "no " * 300 + "</div><p>two</p><section id=comments><p>no</p></section></article>", "one\ntwo"),
    ("<div class='sidebar'><p>no</p></div><div><p>a b c</p><ul><li>d<li>e</ul></div>", "a b c\nd\ne"),
    ("<main><p>in</p></main><p>out out out out</p>", "in"),
    ("<p title=\"a>b\">x</p><p title=\"open>y", "x\ny"), ("a < b <3 </ >c", "a < b <3 c"),
    ("<div class=with-sidebar><nav>m</nav><p>x y</p></div>", "x y"), ("<article class=has-comments><p>x</p><div class=comments>no</div></article>", "x"), ("<TITLE>no</TITLE><P>X</P>", "X")])
def test_main_text(page, text):
    assert html_text.extract(page, W) == text


BODY = "<p>" + "body text of the page " * 6 + "</p><p>" + "and its second part " * 5 + "</p>"
READ = html_text.extract(BODY, W)


@pytest.mark.parametrize("page, text", [
    (f"<div>{BODY}</div><article class=teaser><p>read this next</p></article>", READ),
    (f"<main>{BODY}</main><article class='card promo'><p>read this next</p></article>", READ),
    (f"<main>{BODY}</main><article><p>read this next</p></article>", READ),
    (f"<article class=comment><p>I agree</p></article><div>{BODY}</div><article class=comment><p>me too</p></article>", READ),
    (f"<div>{BODY}</div><article><p>a part without a name</p></article>", f"{READ}\na part without a name"),
    (f"<article><h1>T</h1>{BODY}</article><article>{BODY}</article>", f"T\n{READ}\n{READ}"),
    (f"<article>{BODY}<article class=comment><p>I agree</p></article></article>", READ),
    (f"<p>beside</p><main><p>home</p><article>{BODY}</article><p>more</p></main>", READ),
    (f"<nav>m</nav><article class=notice>{BODY}</article>", READ), (BODY, READ)])
def test_articles_do_not_hide_the_main_text(page, text):
    assert READ.count("\n") == 1 and html_text.extract(page, W) == text


@pytest.mark.parametrize("start", [
    '<p title="the hidden cost of x">', '<p title="Hidden gems">', '<p data-state="hidden">', "<p title='a class=ad b'>", "<p data-x=' style=display:none'>",
    '<p data-hidden title="aria-hidden=true">', '<section id="related-work">', '<section id="discussion">', '<h2 id="search-algorithms">', '<h2 id="comments">',
    '<section id="in-search-of-time">', '<div class="social-science">', '<p class=text class=ad>', '<div id=feedback-loops>', '<p title="hidden"class=x>'])
@pytest.mark.parametrize("within", ["article", "main", "div"])
def test_only_attributes_that_name_furniture_drop_text(start, within):
    end = "</" + re.match("<([a-z0-9]+)", start)[1] + ">"
    assert html_text.extract(f"<{within}><p>one</p>{start}kept{end}<p>two</p></{within}>", W) == "one\nkept\ntwo"


@pytest.mark.parametrize("start", [
    "<div hidden>", '<div HIDDEN="">', "<div aria-hidden = 'true'>", '<div style="color:red; display : none">', "<div title='x'class=ad>", "<div class='x ad y'>",
    '<div class="ad-slot-2">', '<div id="site-footer">', "<div id=comments-list>", '<div class="related-posts">', '<div id="related-posts">', "<div class=topNav>",
    '<section class="c-newsletter-signup">', '<div role="search">', "<div data-a=b/ class=sidebar>", '<div class="&#97;d">'])
def test_attributes_that_name_furniture(start):
    assert html_text.extract(f"<article><p>one</p>{start}no</{re.match('<([a-z]+)', start)[1]}><p>two</p></article>", W) == "one\ntwo"


def test_attributes_are_read_in_linear_time():
    for raw in ("a=" * 100_000, " id='" * 50_000, " class" * 50_000, '"' * 100_000 + "id", " a = " * 50_000 + "class", "/" * 100_000 + "id", " class=" + "ad-x " * 50_000):
        html_text._furniture("p", raw)


def test_place_weights_are_learned(spark):
    """The same marks weigh less where they stand beside the words that contexts choose."""
    learn = lambda page: html_text.learn(spark.createDataFrame([(page,)] * 20, "html string"))
    agree = learn(f"<ul><li>{'x ' * 9}</ul><article>{BODY}</article>")
    assert agree["place:within"] > 2 and agree["place:beside"] < -2
    plain = f"<article><p>{'one two ' * 5}</p></article>"
    mixed = [(f"<ul><li>{'x ' * 9}</ul><article>{BODY}</article>",)] * 20 + [(f"<main>{plain}</main><div>{BODY}</div>",)] * 4
    got = html_text.learn(spark.createDataFrame(mixed, "html string"))
    assert agree["place:beside"] < got["place:beside"]


def test_main_text_is_linear_on_broken_pages():
    for page in ("<p a='" * 50_000, "<" * 200_000, "<div>" * 50_000 + "x", "<!--" * 50_000, "</p><p>" * 50_000 + "x", "<script>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000,
                 "<p><td>" + "<span>" * 50_000 + "<div>x</div>" * 50_000, "<li><ul>" + "<b>" * 50_000 + "<li>x</li>" * 50_000,
                 "<p " + ("a" + " " * 30 + "'") * 20_000 + ">x", "<p " + " " * 200_000 + "'>x"):
        began = time.perf_counter()
        html_text.extract(page, W)
        assert time.perf_counter() - began < 10, page[:40]  # about a second each; hours if quadratic


@pytest.mark.parametrize("depth", [0, 11, 12, 200])
def test_context_does_not_depend_on_depth(depth):
    page = "<h1><a href=x>" + "<span>" * depth + "linked" + "</span>" * depth + "</a>plain" + "<i>" * depth + "deep</h1>"
    said = {t.text: t.context for t in html_text.tokens(page) if t.text}
    assert said.pop("linked") == "link" and set(said.values()) == {"h1"}


def test_quotes_after_any_blanks():
    for blanks in ("", " ", "\n\t " * 40):
        assert html_text.extract(f"<p title={blanks}'a > b'>kept</p>", W) == "kept"
        assert html_text.extract(f"<p title{blanks}'a > b'>kept</p>", W) == "b'>kept"


def test_region_is_the_best_of_all_stretches():
    rng = random.Random(12)
    tags = ["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<nav>", "</nav>", "<article>", "</article>", "<li>", "<h1>", "</h1>", "<br>"]
    places = {"within": 1.5, "beside": -1.5, "minor": -0.5}
    for _ in range(150):
        weight = {f"word:{c}": rng.uniform(-3, 3) for c in ("p", "div", "link", "li", "h1", "body", "furniture")} | {f"tag:{t}": rng.uniform(-2, 0.2) for t in ("p", "div", "a", "br")}
        seq = html_text.tokens("".join(rng.choice(tags) if rng.random() < 0.6 else "word " * rng.randint(1, 4) for _ in range(rng.randint(0, 30))))
        scope = html_text.marked_scope(seq)
        scores = [html_text.score(t, scope, weight, places) for t in seq]
        start, stop = html_text.region(seq, scope, weight, places)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1))])
        assert sum(scores[start:stop]) == pytest.approx(best, abs=1e-9)


def test_html_learns_and_extracts_in_spark(spark):
    page = "<html><body><nav>{0} {0}</nav><div class=ad>{0}</div>{1}<h1>Head {0}</h1><p>Text {0} &copy;</p><p>more</p>{2}<footer>{0}</footer></body></html>"
    marked = [(i, page.format(i, "<article>", "</article>"), "u") for i in range(30)]
    weight = html_text.learn(spark.createDataFrame(marked, "page_id long, html string, text string"))
    assert weight["word:p"] > 0 > weight["word:furniture"] and all(v < 0 for k, v in weight.items() if k.startswith("tag:"))
    rows = spark.createDataFrame([(1, page.format("z", "", ""), "clash"), (2, None, "clash"), (2, None, "clash")], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(rows, weight).collect())
    assert got == [(1, "Head z\nText z ©\nmore"), (2, ""), (2, "")]
    assert html_text.learn(rows.limit(0)) == {} and html_text.main_text(rows.limit(0), {}).count() == 0


def test_html_text_equals_article_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_text(pages, html_text.learn(pages)).collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


# --- quality ---------------------------------------------------------------------------------------------------------

def test_quality_rules(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice("the cat sat on a mat and ate some fish".split()) for _ in range(rng.randint(5, 60))).capitalize() + "."
    bad = lambda: " | ".join(rng.choice("home shop cart login".split()) for _ in range(rng.randint(5, 60)))
    rows = [(i, good() if i % 3 else bad(), "en", "s", "") for i in range(400)] + [(1000, None, "", "", ""), (1001, "", "", "", ""), (1001, "", "", "", "")]
    rows += [(1002, "a fine long text, " * 100_000, "", "", "")]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (5000, 1), (None, 1), (3, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert model.rules and all(set(c[0] for c in r.conditions) <= set(quality.STATISTICS) for r in model.rules)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(300, 400))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == 403


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", "", "", "")], DOC)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.classify(docs, quality.learn(docs, labels.limit(0))).first().predicted == 1
    assert quality.classify(docs, quality.learn(docs, labels)).first().predicted == 0
    assert quality.classify(docs.limit(0), quality.learn(docs, labels)).count() == 0


def test_statistics(spark):
    row = quality.with_statistics(spark.createDataFrame([("Aa aa aa | b1!\n",)], "text string")).first()
    assert row.repeat_share == pytest.approx(1 / 5) and row.pipe_share == pytest.approx(1 / 5) and row.line_words == pytest.approx(5 / 2)
    assert row.upper_share == pytest.approx(1 / 15) and row.digit_share == pytest.approx(1 / 15)


def test_sha_of_registered_chat_query(spark):
    from faultline.llm.queries import QUERIES
    r = QUERIES["op1_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.loss_chars == len(text)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
