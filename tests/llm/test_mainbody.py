import random
import re

import pytest

from quillspan.llm import mainbody
from quillspan.llm.layout import CUT, blocks_of, render, tags_of
from quillspan.llm.mainbody import Corpus, Usual, bodies_of, fit_usual, judge, keyword_pages, language_of, learn_corpus, line_counts, line_form, line_forms, main_pieces, main_text, page_lines

SENTENCES = [f"The {a} {n} {v} that {n2} after the {e}, and {n} number {i} stayed where it was." for i, (a, n, v, n2, e) in enumerate([("old", "mill", "needs", "harbour", "flood"), ("damp", "kiln", "faces", "ferry", "sale"), ("late", "bridge", "slowed", "orchard", "survey"), ("bright", "bakery", "lost", "museum", "frost"), ("heavy", "lantern", "feeds", "quarry", "summer")])]


def article(i):
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}{'xyz'[k]}" for k in range(3)]
    body = "".join(f"<p>{s[:-1]} {words[k % 3]}.</p>\n" for k, s in enumerate(SENTENCES))
    return f"<html><head><title>T{words[0]} | Site</title><script>x</script></head><body><ul><li><a href=/a>Home</a></li><li><a href=/b>Press</a></li></ul><h1>Title {words[0]}</h1>{body}<div>Share this page</div><ol><li>One {words[1]} thing.<li>Two <b>bold {words[0]}</b> things {words[1]}.</ol><h4>Most read</h4><p><a href=/c>A link {words[2]} here</a></p><footer>© Site. All rights reserved.</footer></body></html>"


def spam(i):
    return f"<html><body><ul><li><a href=/a>Home</a></li></ul><h1>Cheap {i}</h1><p>{' '.join(f'buy lamp{i} cheap tag{k % 4}' for k in range(60))}</p><footer>© Site. All rights reserved.</footer></body></html>"


def rows():
    return [(i, "site.test", article(i), 7) for i in range(40)] + [(100 + i, "site.test", spam(i), 7) for i in range(6)] + [(200, "site.test", None, 7), (201, None, "", 7), (202, "x.test", "just a line", 7)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), "crawl_id long, host string, page string, piece_no int")


def pieces(page):
    return [x.strip() for x in CUT.split(page) if x.strip()]


def test_main_pieces(pages):
    got = {}
    for r in main_pieces(pages, ["crawl_id", "piece_no"]).collect():
        got.setdefault(r["crawl_id"], []).append(r["piece_no"])
    assert set(range(40)) <= set(got) and not any(100 <= k < 202 for k in got)
    p = pieces(article(3))
    text = [p[k] for k in sorted(got[3])]
    assert text[0] == "Title wadx" and "bold wadx" in text and "things wady." in text
    assert not {"Home", "Share this page", "Most read", "A link wadz here", "Twadx | Site", "x"} & set(text)
    assert sum(t.startswith("The ") for t in text) == 5


def test_main_text(pages):
    got = {r["crawl_id"]: r["main"] for r in main_text(pages, ["crawl_id"]).collect()}
    assert len(got) == 49 and got[200] is None and got[201] is None and got[101] is None
    assert "1. One wady thing.\n2. Two bold wadx things wady." in got[3]


def test_keyword_pages(pages):
    got = {r["crawl_id"]: r for r in keyword_pages(pages, ["crawl_id"]).collect()}
    assert {k for k, r in got.items() if r["keywords_only"]} == {100 + i for i in range(6)}
    assert keyword_pages(pages.limit(0), ["crawl_id"]).count() == 0


def copied(i):
    """A copy of one article in its own frame, one of its lines edited in some."""
    lines = [f"The {n} of the valley was mended by hand after the last {e} of that year." for n, e in (("weir", "storm"), ("barn", "thaw"), ("chapel", "fair"), ("sluice", "harvest"), ("kennel", "blaze"), ("cellar", "drought"), ("belfry", "plague"))]
    if i % 3 == 0:
        lines[i % 7] = f"An edited line number {i} stands here in place of what was written before."
    body = "".join(f"<p>{x}</p>" for x in lines)
    return f"<html><body><ul><li><a href=/a>Home</a></li></ul><h1>The copied valley</h1>{body}<footer>© Site. All rights reserved.</footer></body></html>"


def copied_spam():
    return "<html><body><table>" + "".join(f"<tr><td>cheap lamp{k}</td><td>buy tag{k % 9} now</td></tr>" for k in range(40)) + "</table><footer>© Site. All rights reserved.</footer></body></html>"


def test_copies_of_one_article_are_one_body(spark):
    rows = [(i, "site.test", article(i)) for i in range(40)] + [(100 + i, "site.test", copied(i)) for i in range(30)] + [(200 + i, "site.test", copied_spam()) for i in range(20)]
    df = spark.createDataFrame(rows, "crawl_id long, host string, page string").repartition(3)
    known = learn_corpus(df).furniture
    assert {"Home", "© 0. All rights reserved.", "Share this page"} <= known
    assert not any("valley" in f or "lamp" in f for f in known)
    got = {r["crawl_id"]: r["main"] for r in main_text(df, ["crawl_id"]).collect()}
    assert all("The copied valley" in got[100 + i] and got[100 + i].count("\n") >= 7 for i in range(30))
    assert {r["crawl_id"] for r in keyword_pages(df, ["crawl_id"]).where("keywords_only").collect()} == {200 + i for i in range(20)}


def test_words_with_digits_are_masked():
    rng = random.Random(7)
    for _ in range(3000):
        line = "a b c d " + "".join(rng.choices("a_é1٣²½0 -.9Ⅷ一b", k=9))
        assert line_form(line, []) == re.sub(r"\b[^\W\d]*\d\w*", "0", line)


def told(name, extra=""):
    """A small page: four lines of its own article, and further lines."""
    return f"<html><body><h1>{name}</h1>" + "".join(f"<p>In {name} the {x} was seen by all of them on that day.</p>" for x in ("mill", "barn", "weir", "kiln")) + f"{extra}</body></html>"


def test_lines_of_few_rows_are_held_against_bodies(spark):
    """Where most rows are copies, a hundredth of all different bodies is less than a thousandth of the rows."""
    rows = [("site.test", told("Aston")) for _ in range(2960)] + [("site.test", told(f"Place{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}", "<div>Told by a friend</div>" if i in (3, 30) else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, page string")
    assert learn_corpus(df.repartition(1)).furniture == learn_corpus(df.repartition(7)).furniture == {"Told by a friend"}


def test_small_groups_of_copies_are_one_body_each(spark):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:03}") for i in range(100)]
    copies = [("site.test", told(f"Copy{n}")) for n in names[:50] for _ in range(5)]
    own = [("site.test", told(f"Own{n}", "<div>Told by a friend</div>" if k < 22 else "")) for k, n in enumerate(names[50:])]
    df = spark.createDataFrame(copies + own, "host string, page string").repartition(3)
    assert learn_corpus(df, 0.2).furniture == {"Told by a friend"}


def test_line_counts_are_whole_however_rows_are_dealt(spark):
    rows = [("site.test", told(f"Place{'abcdefghij'[i % 10]}", "<div>Told by a friend</div>" if i % 1000 == 0 else "")) for i in range(4000)]
    df = spark.createDataFrame(rows, "host string, page string")
    for parts in (1, 9):
        got = sorted(r["n"] for r in line_counts(page_lines(df.repartition(parts))).collect())
        assert got == [4] + [400] * 50


def test_bodies_of_many_lines_are_found_in_tables(spark):
    edges = spark.createDataFrame([(1, 2), (5, 6), (2, 3), (9, 8), (8, 3)], "a long, b long")
    for limit in (0, 100):
        groups = {}
        for r in bodies_of(edges, limit).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 8, 9], [5, 6]]


def test_repeated_and_long_pages(spark):
    long = "<p>" + SENTENCES[0] * 4000 + "</p>"
    df = spark.createDataFrame([(1, "a", long), (1, "a", long)], "crawl_id long, host string, page string")
    assert [r["piece_no"] for r in main_pieces(df, ["crawl_id"]).collect()] in ([0, 0], [])
    assert learn_corpus(df).furniture == frozenset()


def test_layout_implied_tags_and_visibility():
    page = "<ul><li>a<li>b <i>c</i></ul><p>one<p>two<br>three<div style='display:none'>no</div><table><tr><td>x<td>yy<tr><td>long<td>z</table><a href=x>l<a href=y>m</a><noscript>n</noscript>tail < 3"
    b = blocks_of(page).blocks
    assert [x.text for x in b] == ["a", "b c", "one", "two", "three", "x", "yy", "long", "z", "l m", "tail < 3"]
    assert "x     yy\nlong  z" in render(b)
    assert [p for x in b for p in x.pieces] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 14]


def test_plain_text_lines():
    j = judge("Menu\r\nA title\r\n" + " ".join(SENTENCES) + "\nlast", None, Corpus(frozenset({"Menu", "last"})))
    assert [p for b in j.main for p in b.pieces] == [1, 2]


@pytest.mark.parametrize("page", ["<", ">", "<>", "</p></p>", "<a><a><a>", "<a hidden>x<a>y</a>", "<td>x", "<script>", "&lt;" * 10, "<p " * 50])
def test_broken_pages(page):
    judge(page, "h", Corpus())


NOUNS = "mill kiln ferry bridge orchard museum quarry lantern harbour bakery cellar barn chapel tower garden meadow press archive".split()
VERBS = "needs faces slowed lost feeds survived replaced surrounds repaired doubled delayed hides".split()
SMALL = "the of and to in a is that it for was on with as by at from this".split()
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se") for b in ("ld", "nt", "rk", "ss", "v", "p") for c in ("er", "ing", "ed", "y", "on")]


def sentence(rng):
    words = [rng.choice(SMALL) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(rng.randint(7, 19))]
    commas = {rng.randrange(3, 19) for _ in range(rng.randint(0, 2))}
    return " ".join(w + "," * (k in commas and k < len(words) - 1) for k, w in enumerate(words)).capitalize() + rng.choice("...?!")


def long_article(i):
    """An article of fourteen sentences of its own."""
    rng = random.Random(i)
    return f"<html><body><ul><li><a href=/a>Home</a></li></ul><h1>About {rng.choice(VOCABULARY)} {i}</h1>" + "".join(f"<p>{' '.join(sentence(rng) for _ in range(rng.randint(2, 4)))}</p>" for _ in range(5)) + "</body></html>"


def probe(body):
    return f"<html><body><ul><li><a href=/a>Home</a></li></ul><h1>A heading</h1>{body}</body></html>"


_KEYS = [f"{a} {b}" for a, b in zip("cheap best fast top free new deal buy".split(), NOUNS, strict=False)]
STRUNG = {
    "two long sentences above forty links": "<p>" + " ".join(SENTENCES[:2]) + "</p>" + "".join(f"<a href=/{k}>{NOUNS[k % 18]} {VERBS[k % 12]}</a> " for k in range(40)),
    "thirty links of one word": "<ul>" + "".join(f"<li><a href=/{k}>{NOUNS[k % 18]}</a></li>" for k in range(30)) + "</ul>",
    "tags with colons": "<ul>" + "".join(f"<li>Colour: {NOUNS[k % 18]}</li>" for k in range(60)) + "</ul>",
    "bare urls": "\n".join(f"<p>http://{NOUNS[k % 18]}.test:80/{VERBS[k % 12]}/{k}</p>" for k in range(35)),
    "keywords with full stops": "<p>" + " ".join(f"{_KEYS[(k * k + k // 3) % 8]}{'.' if k % 5 == 4 else ''}" for k in range(120)) + "</p>",
    "one sentence again and again": "<p>" + "This lamp is very cheap. " * 60 + "</p>",
    "keywords in the guise of sentences": "<p>" + " ".join(f"{_KEYS[k * k % 8].title()} lampshade {_KEYS[(k + 3) % 8]} lampshade, {_KEYS[k * 5 % 8]} lampshade {NOUNS[k % 18]}." for k in range(24)) + "</p>",
    "hash tags": "<p>" + " ".join(f"#{NOUNS[k * k % 7]}{VERBS[k % 3]}" for k in range(70)) + "</p>",
    "keywords in bars": "<p>" + " | ".join(_KEYS[(k * k + k // 5) % 8] for k in range(90)) + "</p>",
}
WHOLE = {
    "article above a list of links": long_article(901).replace("</body>", "") + "<ul>" + "".join(f"<li><a href=/{k}>{NOUNS[k % 18]} {VERBS[k % 12]}</a></li>" for k in range(40)) + "</ul>",
    "article with one topic": probe("<p>" + " ".join(sentence(random.Random(k)).replace("ba", "the old lamp ba", 2) for k in range(14)) + "</p>"),
    "a line": "just a line",
    "an empty frame": probe(""),
}


def test_kinds_of_strung_pages(spark):
    rows = [(k, "site.test", long_article(k)) for k in range(120)]
    rows += [(1000 + k, "s.test", probe(b)) for k, b in enumerate(STRUNG.values())] + [(2000 + k, "s.test", b) for k, b in enumerate(WHOLE.values())]
    got = {r["crawl_id"]: r for r in keyword_pages(spark.createDataFrame(rows, "crawl_id long, host string, page string"), ["crawl_id"]).collect()}
    missed = [name for k, name in enumerate(STRUNG) if not got[1000 + k]["keywords_only"]]
    wrong = [name for k, name in enumerate(WHOLE) if got[2000 + k]["keywords_only"]] + [k for k in range(120) if got[k]["keywords_only"]]
    assert (missed, wrong) == ([], [])


def test_language_needs_frequent_words():
    assert language_of("the mill of the valley was in the hands of a miller") == "en"
    assert language_of("cheap lamp best lamp the lamp top lamp free lamp fast lamp new lamp old lamp big lamp red lamp") == "latin"
    assert language_of("дом лес река поле гора мост сад") == "other"
    assert language_of("") == "other"


def test_usual_is_a_line_through_many_texts():
    rows = [("en", c, 200, [0.48 - 0.02 * (c - 40), 0.5 - 0.02 * (c - 40), 0.52 - 0.02 * (c - 40)]) for c in range(34, 46)] + [("en", 50, 21, [0.1, 0.1, 0.1]), ("en", 52, 3, [0.9, 0.9, 0.9])]
    usual = fit_usual(rows)
    assert abs(usual.redundancy("en", 40, 0.5)) < 1
    assert usual.redundancy("en", 46, 0.1) > 9
    assert Usual().redundancy("en", 40, 0.56) == 0


def test_late_titles_and_long_notices(spark):
    """The title is sought on the whole page, and a notice may be of any length."""
    notice = "We keep small files on your device for the purposes named in our long policy, " * 5 + "as ever."
    page = lambda i: f"<html><head><script>{'x' * 9000}</script><title lang=en>T{i} | Some Name</title></head><body>" + long_article(i)[12:].replace("</body></html>", "") + f"<p>{notice}</p><div>Some Name is read by many. All rights reserved.</div></body></html>"
    df = spark.createDataFrame([(i, f"host{i}.test", page(i)) for i in range(60)], "crawl_id long, host string, page string")
    known = learn_corpus(df).furniture
    assert any(len(f) > 100 or "\0" in f for f in known) and "0 is read by many. All rights reserved." in known
    assert not any("small files" in r["main"] or "rights" in r["main"] for r in main_text(df, ["crawl_id"]).collect())


def test_an_article_goes_on_behind_a_box_of_links():
    boxed = "<div class=a><h1>Head</h1><p>" + SENTENCES[0] + "</p><div class=b><a href=/1>One link here</a> <a href=/2>Other link there</a></div><p>" + " ".join(SENTENCES[1:]) + "</p></div><div class=c><p>A comment is no part of it.</p></div>"
    main = " ".join(b.text for b in judge(boxed, None, Corpus()).main)
    assert all(x in main for x in SENTENCES) and "link" not in main


def test_lines_of_a_page_are_masked_at_once(monkeypatch):
    """Line by line, pages took over a tenth more CPU time."""
    calls = []
    masked = mainbody._masked
    monkeypatch.setattr(mainbody, "_masked", lambda s: calls.append(s) or masked(s))
    judge(article(3), "site.test", Corpus())
    assert len(calls) == 1
    mainbody._visible_lines(article(3), "site.test")
    assert len(calls) == 2


def test_forms_made_at_once_are_those_of_single_lines():
    rng = random.Random(11)
    parts = ["Home", "Site", "a1", "٣ab", "½", "7", "é9", " ", " ", " ", "  ", "word", "-", ".", "日3"]
    for k in range(2000):
        lines = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 9))] + ["a\nb 1 c d e"] * (k % 50 == 0)
        for names in ([], ["Site", "Home"], ["word\nHome", "a"], [""]):
            assert line_forms(lines, names) == [line_form(x, names) for x in lines]


def test_every_decimal_digit_is_masked():
    for c in map(chr, range(0x110000)):
        if c.isdecimal():
            assert line_form(f"a b c x{c}y é", []) == "a b c 0 é"


def test_tags_are_the_cuts_of_a_page():
    rng = random.Random(5)
    for _ in range(3000):
        page = "".join(rng.choices(["<", ">", "<p>", "</p>", "<a href=x>", "\n", "\r", "text", " "], k=rng.randint(0, 14)))
        shown = "\n".join(x for _, _, x in tags_of(page)).replace("\r", "\n").split("\n")
        assert [x for x in shown if x.strip()] == [x for x in CUT.split(page) if x.strip()]
        assert "".join(f"<{tag}{end}{x}" for tag, end, x in tags_of(page))[1:] == page


def test_long_furniture_is_known_by_its_form():
    long = "We keep 7 small files for the purposes named here " + "and there " * 30 + "as ever."
    corpus = Corpus(frozenset({mainbody._key(line_form(long, [])), "Home"}))
    assert corpus.holds(line_form(long.replace("7", "81"), [])) and corpus.holds("Home")
    assert not corpus.holds(line_form(long.replace("named", "told"), [])) and not corpus.holds(" " * 300)
