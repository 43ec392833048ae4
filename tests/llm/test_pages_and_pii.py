import re

import pytest
from adloom.llm.html import extract_text, main_text, marks, tree
from adloom.llm.pii import entities, luhn, pseudonymised, replaced, surrogate, surrogates

PAGE = """<html><body class="no-sidebar"><header class="site-header"><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
<div class=content><main><article class="post"><header><h1>T &amp; x&#8217;s</h1></header><div class="share">Share</div>
<p>One <i>two</i><br>three<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>end &nbsp; x<script>if(a<b){"</p>"}</script>
<div class="promo-box">buy</div><form>f</form></article><section id="comments"><article class="comment"><p>me</p></article>
</section></main></div><aside>s</aside><footer>f</footer>"""


def text_of(html, template=frozenset()):
    return main_text(tree(html), set(template)).split("\n\n")


def test_main_text():
    assert text_of(PAGE) == ["T & x’s", "One two three", "a", "b", "c d", "end x"]


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("", [""]),
        ("just text", ["just text"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<div>x</span></p>y</div>", ["xy"]),
        ("<nav>n</nav><div><p>a</p></div><!-- c --><footer>f", ["a"]),
        ("<main><p>a</p><aside>b</aside></main><p>out</p>", ["a"]),
        ("<article>a</article><article>b</article>", ["a", "b"]),
        ("<p>&eacute;&#233;&#xe9;&am &lt;b&gt;</p>", ["ééé&am <b>"]),
        ("<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p>d</p>", ["d"]),
        ("<title>t</title><style>p{}</style><noscript>n</noscript><p>x</p><iframe>i</iframe>", ["x"]),
    ],
)
def test_markup(html, blocks):
    assert text_of(html) == blocks


def test_deep_and_long_pages():
    assert text_of("<div>" * 30_000 + "deep") == ["deep"]
    assert text_of("<article>" + "<p>w</p>" * 20_000) == ["w"] * 20_000


def test_prose_of_an_article_is_never_template():
    root = tree("<body><div>box</div><article><p>said</p><div>more</div></article></body>")
    assert len(marks(root)) == 2
    assert main_text(root, marks(root) | {c.mark for c in root.children}) == "said"


def test_site_templates(spark):
    page = "<div><p>top line</p></div><div><p>text {}</p></div><div>bottom</div>"
    rows = [(k, f"http://H.org/{k}", page.format(k)) for k in range(12)] + [(99, "http://other.org/", page.format(99))]
    rows += [(20 + k, "http://h.org/same", f"<article><p>quoted often</p><p>own {k}</p></article>") for k in range(12)]
    rows += [(None, None, None), (None, "", ""), (7, "http://h.org/7", page.format(7))]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, _n int")
    got = extract_text(df).collect()
    assert len(got) == len(rows) and {r._n for r in got} == {1}
    for r in got:
        if r.html is None or r.html == "":
            want = ""
        elif r.page_id == 99:
            want = "top line\n\ntext 99\n\nbottom"
        elif "<article>" in r.html:
            want = f"quoted often\n\nown {r.page_id - 20}"
        else:
            want = f"text {r.page_id}"
        assert r.text == want
    assert extract_text(df.limit(0)).collect() == []


def test_all_main_elements_are_read():
    assert text_of("<main><p>a</p><div role=main>b</div></main><p>out</p><div role=main>c</div>") == ["a", "b", "c"]


def test_copies_are_no_template(spark):
    body = "<div class=body><div>said</div><ul><li>one</li></ul><table><tr><td>two</td></tr></table></div>"
    copy = f"<div>site</div><article><h1>title</h1>{body}</article>"
    rows = [(f"http://h.org/{k}", copy) for k in range(40)]
    rows += [(f"http://h.org/n{k}", f"<div>site</div><article><h1>title {k}</h1>{body}</article>") for k in range(12)]
    rows += [(f"http://h.org/o{k}", f"<div>site</div><div>own {k}</div>") for k in range(12)]
    rows += [(f"http://h.org/p{k}", "<div>site</div><div>plain copy</div>") for k in range(40)]
    got = extract_text(spark.createDataFrame(rows, "url string, html string"))
    for r in got.collect():
        end = r.url.removeprefix("http://h.org/")
        title = {"n": f"title {end[1:]}", "o": f"own {end[1:]}", "p": "plain copy"}.get(end[0], "title")
        assert r.text.split("\n\n") == [title, *(["said", "one", "two"] if end[0] not in "op" else [])]


def test_blocks_that_recur_inside_articles_go(spark):
    box = "<div>read more of <b>us</b></div>"
    page = f"<article><h1>title {{0}}</h1><div class=body>own {{0}} words{box}and {{0}} more<ul><li>quoted</li></ul><p>said often</p><hr></div></article>"
    rows = [(f"http://h.org/{k}", page.format(k)) for k in range(12)]
    rows += [(f"http://h.org/m{k}", f"<main><h2>main {k}</h2><section>{box}<p>in a box</p></section><p>of {k} a b c d</p></main>") for k in range(12)]
    rows += [("http://rare.org/", page.format(0)), ("http://h.org/b", f"<article>{box}</article>")]
    got = {r.url: r.text.split("\n\n") for r in extract_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    for k in range(12):
        assert got[f"http://h.org/{k}"] == [f"title {k}", f"own {k} words", f"and {k} more", "said often"]
        assert got[f"http://h.org/m{k}"] == [f"main {k}", f"of {k} a b c d"]
    assert got["http://rare.org/"] == ["title 0", "own 0 words", "read more of us", "and 0 more", "quoted", "said often"]
    assert got["http://h.org/b"] == ["read more of us"]


def test_a_page_holds_what_any_copy_of_it_holds(spark):
    said = "<article><p>said on {}</p></article>"
    rows = [(f"http://h.org/{k}", f"<div>{bar} bar</div>{said.format(k)}") for k in range(6) for bar in ("old", "new")]
    rows += [("http://h.org/plain", "<div>old bar</div><div>new bar</div><div>own</div>")]
    got = extract_text(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [r.text for r in got if r.url.endswith("plain")] == ["own"]


TEXT = (
    "Mr. John Smith wrote to Mrs Smith and Herr Müller: Bob.X@Mail.co.uk, +1 (988) 555-2485, 988-555-2485, 42.144.35.254, "
    "4111 1111 1111 1111, 4785380592391139, DE89 3704 0044 0532 0130 00, 123-45-6789, Госпожа Анна Иванова, Κύριος Νίκος"
)
KINDS = (
    "given_m family family family email phone phone ip card card iban ssn given_f family family"
).split()


def test_entities():
    assert [kind for *_, kind, _ in entities(TEXT)] == KINDS
    for clean in ("4785380592391138", "999.1.1.1", "1.2.3.4.5", "version 3.10", "a@b", "12-34", "the year 1999", "", None):
        assert entities(clean) == []


@pytest.mark.parametrize(
    "text, found",
    [
        ("4111111111111111 123", ["card 4111111111111111"]),
        ("4111111111111111 12/26", ["card 4111111111111111"]),
        ("12 4111111111111111", ["card 4111111111111111"]),
        ("4111111111111111 5 times", ["card 4111111111111111"]),
        ("item 12 4111-1111-1111-1111 123", ["card 4111-1111-1111-1111"]),
        ("123456 12 4111 1111 1111 1111 7", ["card 4111 1111 1111 1111"]),
        ("1234 5678 9012 3450 4111 1111 1111 1111", ["card 4111 1111 1111 1111"]),
        ("378282246310005 1234 4222222222222", ["card 378282246310005", "card 4222222222222"]),
        ("988-555-2485 123-45-6780", ["phone 988-555-2485", "ssn 123-45-6780"]),
        ("1 123-45-6789 4111111", ["ssn 123-45-6789"]),
        ("4111111111111112 123", []),
    ],
)
def test_cards_beside_other_numbers(text, found):
    assert [f"{kind} {text[a:b]}" for a, b, kind, _ in entities(text)] == found
    made = replaced(text, {(kind, value): surrogate(kind, value, 0, b"k") for *_, kind, value in entities(text)})
    assert not [x for x in found if x.split(" ", 1)[1] in made]


def test_surrogates_keep_type_and_format():
    known = {(kind, value): surrogate(kind, value, 0, b"k") for *_, kind, value in entities(TEXT)}
    made = replaced(TEXT, known)
    assert [kind for *_, kind, _ in entities(made)] == KINDS
    shape = lambda t: re.sub(r"\d", "9", "".join(t[a:b] for a, b, k, _ in entities(t) if k not in ("given_m", "given_f", "family", "email", "iban")))
    assert shape(made) == shape(TEXT)
    assert not set(known) & {(k, v) for *_, k, v in entities(made)}
    for kind, value in known:
        if kind == "card":
            assert luhn(known[kind, value]) % 10 == 0
    iban = known["iban", "DE89370400440532013000"]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert surrogate("email", "a@x.org", 0, b"k").partition("@")[2] == surrogate("email", "b@x.org", 0, b"k").partition("@")[2]
    assert surrogate("ip", "1.2.3.4", 0, b"k") != surrogate("ip", "1.2.3.4", 0, b"other")


def test_surrogates_never_collide(spark):
    # Single-digit parts leave few addresses, so offers meet each other and the data again and again.
    values = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("family", f"nam{c}") for c in "abcdefghij"]
    got = surrogates(spark.createDataFrame(values * 2, "kind string, value string"), b"k").collect()
    assert len(got) == len(values) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(values)
    assert surrogates(spark.createDataFrame([], "kind string, value string"), b"k").collect() == []


def test_surrogates_of_full_formats(spark):
    # Every address of four digits, every short phone number with +1 and every local part of two domains is taken.
    values = [("ip", ".".join(f"{k:04d}")) for k in range(10_000)] + [("phone", f"1{k:04d}") for k in range(10_000)]
    values += [("email", f"{chr(97 + k)}@{host}.org") for k in range(26) for host in "abcdefghijklmnopqrstuvwxyz"]
    got = surrogates(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert {(r.kind, r.value) for r in got} == set(values)
    assert len(got) == len(values) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(values)
    for r in got:
        if r.kind == "ip":
            assert [(kind, value) for *_, kind, value in entities(r.surrogate)] == [("ip", r.surrogate)]
    said = "call +1 22-22 or a@x.org from 1.2.3.4"
    made = replaced(said, {("phone", "12222"): "1345678", ("email", "a@x.org"): "xyz@q.org", ("ip", "1.2.3.4"): "200.1.30.4"})
    assert made == "call +1 34-5678 or xyz@q.org from 200.1.30.4"


def test_pseudonymised(make_docs, texts):
    rows = [*enumerate([*texts, TEXT, "again BOB.X@MAIL.CO.UK"]), (None, TEXT), (1, TEXT), (1, TEXT), (1, "bob.x@mail.co.uk")]
    got = pseudonymised(make_docs(rows).withColumnRenamed("words", "pii")).collect()
    assert len(got) == len(rows)
    out = {}
    for r in got:
        out.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        if k != 1:
            assert out[k][0].text == text and out[k][0].pii == {}
    whole = [r for r in got if r.pii.get("card") == 2]
    assert len(whole) == 4 and len({r.text for r in whole}) == 1
    (mail,) = [m for *_, kind, m in entities(whole[0].text) if kind == "email"]
    assert {r.text for r in got if r.text and "@" in r.text} - {whole[0].text} == {f"again {mail.upper()}", mail}
    assert not {(k, v) for *_, k, v in entities(TEXT)} & {(k, v) for *_, k, v in entities(whole[0].text)}
    assert pseudonymised(make_docs([])).collect() == []


def test_names_said_again_follow_their_entity():
    text = "Mr John Smith came. Later Smith left, and John too; smith and Smithson did not. x@smith.org Smith"
    found = entities(text)
    assert [text[a:b] for a, b, kind, _ in sorted(found) if kind == "family"] == ["Smith", "Smith", "Smith"]
    assert [text[a:b] for a, b, kind, _ in sorted(found) if kind == "given_m"] == ["John", "John"]
    made = replaced(text, {(kind, value): f"Q{kind}" for *_, kind, value in found})
    assert "Smith " not in made and "smith and Smithson" in made and entities("Later Smith left") == []


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("mail a@b.de tel ٠٣٠-٤٥٦-٧٨٩٠", ["email"]),
        ("०३०-४५६-७८९० and ४१११ ११११ ११११ ११११", []),
        ("call +123456 now", ["phone"]),
        ("call +12233", ["phone"]),
    ],
)
def test_digits_of_other_scripts_and_short_numbers(spark, text, kinds):
    assert [kind for *_, kind, _ in entities(text)] == kinds
    got = pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted(got.pii) == kinds and (got.text == text) == (not kinds)


def test_first_look_hides_no_entity_and_random_texts_do_not_crash(spark):
    """Random strings of every kind's letters: what has entities is a likely text, and is rewritten alike in Spark."""
    import random

    from adloom.llm.pii import HINT

    rng = random.Random(9)
    bits = [*"+-.() @0123456789", "12", "4111111111111111", "192.168.0.1", "DE89", "Mr ", "Frau ", "Κύριος ", "Smith", "Иван", "é", "٣", "a", "\n",
            "555-123-4567", "123-45-6789", "x@y.org"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    likely = {r[0] for r in df.filter(df.text.rlike(HINT)).collect()}
    some = [k for k, t in enumerate(texts) if entities(t)]
    assert len(some) > 500 and set(some) <= likely
    for r in pseudonymised(df).collect():
        own = entities(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not own)
        assert sum(r.pii.values()) == len({(kind, value) for *_, kind, value in own})
        left = {(kind, value) for *_, kind, value in entities(r.text)}
        assert not left & {(kind, value) for *_, kind, value in own if kind in ("email", "phone", "card", "iban")}


def test_boxes_are_told_by_class_tokens():
    for names in ("entry-content no-sidebar", "post-body has-comments", "with-newsletter", "is-related"):
        assert text_of(f"<article><h1>T</h1><div class='{names}'><p>said here</p></div></article>") == ["T", "said here"]
    assert text_of("<article><h1>T</h1><p>a b c d</p><div class='related-posts'>x</div></article>") == ["T", "a b c d"]
    assert text_of("<article><h1>T</h1><div class='content-share'><p>one two three four</p></div></article>") == ["T", "one two three four"]
    assert text_of("<p>The value is <math>x=2</math> here</p>") == ["The value is x=2 here"]


def test_nested_elements_take_linear_time():
    import time

    start = time.process_time()
    for page in ("<div>" * 100_000, "<p><table><td>" + "<div>" * 100_000, "<article>" + "<p><span>" * 50_000, "<ul><li>" * 50_000):
        assert text_of(page + "deep") == ["deep"]
    assert time.process_time() - start < 40
