"""Look-alikes, wrong decodings and residue."""

import random
import unicodedata

import numpy as np
import pytest

from canopyq.llm import boilerplate, consistency, lookalike, mojibake, residue

FORM = lookalike.Rewriter().form


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("Ｈｏｍｅ", "Home"),
        ("Cont­act", "Contact"),
        ("H​e⁠l﻿p‎", "Help"),
        ("a b c　d", "a b c d"),
        ("hand‑made", "hand-made"),
        ("été", "été"),
        ("한", "한"),
        ("ﾍﾙﾌﾟ", "ヘルプ"),
        ("ﬁnal", "final"),
        ("Lоgіn", "Login"),
        ("Новoсти", "Новости"),
        ("Μikrο text", "Mikro text"),
        ("Аіԁе", "Aide"),
        ("Іnісіо", "Inicio"),
    ],
)
def test_forms(dirty, clean):
    assert FORM(dirty) == clean
    assert FORM(clean) == clean


@pytest.mark.parametrize("text", ["", "plain", "а б в", "x² + ½ № 5", "👩‍🔬", "می‌رساند", "，。「」！", "क्‍ष", "Wi-Fi роутер", "αβγ", "Ångström – “quoted” …", "Þór", "AT&T-style пелушка"])
def test_usual_forms_stay(text):
    assert FORM(text) == text


def test_forms_are_stable():
    rng = random.Random(2)
    bits = ["a", "а", "α", "ａ", "é", "‍", " ", "ﾊﾟ", "が", "ﬂ", "x", " ", "и", "ł", "한", "가"]
    for _ in range(500):
        once = FORM("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))))
        assert FORM(once) == once and unicodedata.normalize("NFC", once) == once


def test_classes_are_transitive():
    c = lookalike.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "d")):
        c.join(a, b)
    assert c.members() == [["a", "b", "c", "d"]]
    group = next(m for m in lookalike.classes() if "a" in m)
    assert {"а", "α", "ａ"} <= set(group)


def test_frequency_chooses():
    usual = lookalike.Rewriter({"ア": 100, "ｱ": 1})
    assert usual.form("ｱア") == usual.form("アｱ") == "アア"
    narrow = lookalike.Rewriter({"ア": 1, "ｱ": 100})
    assert narrow.form("ｱア") == narrow.form("アｱ") == "ｱｱ" and "ア" in narrow.odd


def test_ascii_is_the_form_of_its_class_whatever_the_counts():
    r = lookalike.Rewriter({"ĳ": 100, "ij": 1, "ａ": 100, "a": 1, "ﬁ": 9})
    for text, want in (("ĳs en Ĳssel", "ijs en IJssel"), ("ijs en IJssel", "ijs en IJssel"), ("ａ", "a"), ("ﬁn", "fin")):
        assert r.form(text) == want == r.form(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [("օld", "old"), ("Ꭺrchive", "Archive"), ("ɡood", "good"), ("Henry Ⅳ", "Henry IV"), ("ⅼist", "list"), ("ᴄool", "cool"), ("Բարեւ օր", "Բարեւ օր"), ("ᎠᏂᏴᏫᏯ", "ᎠᏂᏴᏫᏯ"), ("½ of №", "½ of №")],
)
def test_letters_of_other_scripts(text, want):
    assert FORM(text) == want and FORM(want) == want


def test_members_are_counted_whatever_their_letters(spark):
    texts = spark.createDataFrame([("ijs ij",), ("ĳ ǆ dž",), ("ffi ﬃ",), (None,), ("",)], "v string")
    got = lookalike.member_counts(texts)
    assert got["ij"] == 2 and got["ĳ"] == 1 and got["ǆ"] == 1 and got["dž"] == 1 and got["ffi"] == 1 and got["ﬃ"] == 1


CLEAN = ["Nach der Prüfung führt die schöne Brücke über den Fluss", "La journée énorme précède la théière à côté", "Każda łąka śledzi tę żółtą książkę", "Сегодня старая долина снова несёт книгу", "人们说安静的花园正在测量风门", "朝になると静かな図書館を開きます", "오래된 등대 옆의 다리 이 길을 지킨다", "plain words – and “quotes” here"]


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.pair_counts(CLEAN * 400).astype(np.float32))


@pytest.mark.parametrize("assumed", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850"])
@pytest.mark.parametrize("k", range(7))
def test_utf8_read_as_one_byte_is_restored(repairer, k, assumed):
    try:
        garbled = CLEAN[k].encode("utf-8").decode(assumed)
    except UnicodeDecodeError:
        pytest.skip("not all bytes have a character")
    assert repairer.repair(garbled) == CLEAN[k]
    assert repairer.garbled(garbled)


@pytest.mark.parametrize(("k", "meant", "assumed"), [(0, "cp1252", "cp437"), (1, "cp1252", "mac_roman"), (3, "cp1251", "cp1252"), (3, "koi8_r", "cp1251"), (4, "gb18030", "latin-1"), (6, "euc_kr", "cp1252")])
def test_other_pairs_are_restored(repairer, k, meant, assumed):
    assert repairer.repair(CLEAN[k].encode(meant).decode(assumed)) == CLEAN[k]


MORE = ["It’s a long sentence about the harbour – and it’s one that nobody has read before", "Привет, как дела", "καλημέρα", "für Größe", "שלום לכולם"]


@pytest.fixture(scope="module")
def more():
    return mojibake.Repairer(mojibake.pair_counts([*CLEAN, *MORE, *(f"{t} plain words " for t in MORE)] * 400).astype(np.float32))


@pytest.mark.parametrize("assumed", ["gb18030", "cp932", "big5", "euc_kr"])
@pytest.mark.parametrize("text", MORE)
def test_utf8_read_as_east_asian_is_restored_at_every_length(more, text, assumed):
    try:
        garbled = text.encode().decode(assumed)
    except UnicodeDecodeError:
        pytest.skip("not all bytes have a character")
    assert garbled != text and more.repair(garbled) == text
    assert more.repair(f"{garbled} {'plain words ' * 9}") == f"{text} {'plain words ' * 9}"


@pytest.fixture(scope="module")
def spaceless():
    rng = random.Random(3)
    texts = [t.replace(" ", "") for t in CLEAN[4:7]]
    texts.append(texts[0].encode("big5", "ignore").decode("big5"))
    texts.append(texts[1].encode("euc_jp", "ignore").decode("euc_jp"))
    rare = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))  # a corpus has rare pairs
    return mojibake.Repairer(mojibake.pair_counts([*texts * 400, rare]).astype(np.float32))


@pytest.mark.parametrize(("k", "meant"), [(4, "gb18030"), (4, "big5"), (5, "cp932"), (5, "euc_jp"), (6, "euc_kr")])
def test_spans_beside_what_does_not_fit_are_restored(spaceless, k, meant):
    clean = CLEAN[k].replace(" ", "").encode(meant, "ignore").decode(meant)
    data = clean.encode(meant)
    assert spaceless.repair(data.decode("latin-1")) == clean
    cut = spaceless.repair((data + data[:1]).decode("latin-1"))
    assert cut.startswith(clean[:-1]) and spaceless.garbled((data + data[:1]).decode("latin-1"))
    assert spaceless.repair(data.decode("latin-1") + "😀") == clean + "😀"
    assert spaceless.repair("园" + data.decode("latin-1")) == "园" + clean


def test_half_width_and_four_byte_characters_do_not_stop_a_span(spaceless):
    zh, one = (t.replace(" ", "") for t in CLEAN[4:6])
    for text, meant in ((f"{one}ｱ{one}", "cp932"), (f"{zh}\U00020000{zh}", "gb18030")):
        assert spaceless.repair(text.encode(meant).decode("latin-1")) == text


def test_sound_texts_stay(repairer):
    for text in [*CLEAN, "", "ascii", "€ 24,90", "4 × 6 cm", "±3 °C", "Ângela", "Þór", "Lоgіn", "Ｈｏｍｅ"]:
        assert repairer.repair(text) == text and not repairer.garbled(text)


def test_twice_and_lost(repairer):
    assert repairer.repair(CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")) == CLEAN[0]
    assert repairer.garbled("l�mpada") and repairer.garbled("锟斤拷") and repairer.garbled("a\x93b")


def test_character_operators(spark):
    rows = [(1, k, "text", t, "s") for k, t in enumerate(CLEAN * 60)]
    rows += [(2, 1, "text", CLEAN[0].encode().decode("cp1252"), "s"), (2, 2, "text", None, "s"), (2, 3, "text", "", None), (2, 4, "attribute", "Lоgіn", "s"), (2, 5, "text", "x" * 100_000 + "​", "s")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, kind string, value string, restored string")
    twice = nodes.unionByName(nodes)
    assert [(r.doc_id, r.node_id, r.restored, r.lost) for r in mojibake.garbled_nodes(twice).collect()] == [(2, 1, CLEAN[0], False)]
    assert sorted((r.doc_id, r.node_id) for r in consistency.lookalike_nodes(twice).collect()) == [(2, 4), (2, 5)]
    assert mojibake.garbled_nodes(nodes.limit(0)).collect() == [] and consistency.lookalike_nodes(nodes.limit(0)).collect() == []
    forms = {r.node_id: r.form for r in lookalike.consistent(nodes.filter("doc_id = 2"), ["node_id"], "value").collect()}
    assert len(forms) == 5 and forms[2] is None and forms[3] == "" and forms[4] == "Login"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Hello {{ user.name }}", "placeholder"), ("${city}", "placeholder"), ("<%= x %>", "placeholder"), ("%user_name% x", "placeholder"), ("*|NAME|*", "placeholder"), ("[[title]]", "placeholder"),
        ("__headline__", "placeholder"), ("[insert city here]", "placeholder"), ("{name}", "placeholder"), ("Lorem ipsum dolor sit amet", "filler"), ("Your text here...", "filler"), ("TBD", "filler"),
        ("Hier steht Ihr Text", "filler"), ("404 page not found", "message"), ("HTTP 503 - the service is temporarily unavailable", "message"), ("Access denied. Ray 7f3c-02", "message"),
        ("Fatal error: undefined variable in /a/b.php on line 3", "message"), ("Ошибка 404: страница не найдена", "message"), ("Please enable JavaScript in your browser to continue.", "scripts"),
        ("このページの表示には JavaScript が必要です。", "scripts"), ("Plеase enable JavaScript in your browser.", "scripts"), ("Dummy title – site.example", "filler"),
        ("", ""), ("needs {salt, water}", ""), ("a set {0, 1}", ""), ("JavaScript counts as one of the skills we teach.", ""), ("Access to the ferry was forbidden in winter.", ""), ("Error rates rose to 404 after the change.", ""),
        ("The lorem-seed recipe needs two eggs.", ""), ("100%", ""), ("Please enable the pump before the test run.", ""), ("[1]", ""), ("The 404 page was redesigned in May.", ""), ("price $5 and $6", ""),
    ],
)
def test_residue_rules(text, kind):
    assert residue.whole(FORM(text)) == kind


def node_rows(doc, site, html):
    from canopyq.html import tree

    return [(doc, *r, site) for r in tree.rows(tree.build(html, "close"))]


def page(k, side=True):
    nav = '<div class="m"><a href="/a">Home</a><a href="/b">News</a></div>'
    tail = f'<section class="x"><h3>Read also</h3><p class="t">Other story number {k}.</p></section>' if side else ""
    return f"<html><head><title>Story {k}</title></head><body>{nav}<div class=\"c\"><h1>Story {k}</h1><p>By A B · 2024-01-0{k % 9}</p><p>Unique words {k} of the story <b>bold</b>.</p><p>{{{{x}}}}</p></div>{tail}<footer>© 2024 site</footer></body></html>"


SCHEMA = "doc_id long, node_id int, parent_id int, kind string, kind_rank byte, name string, value string, only_whitespace boolean, level int, last_desc int, attrs map<string,string>, site string"


def test_page_operators(spark):
    rows = [r for k in range(6) for r in node_rows(k, "one", page(k))] + node_rows(50, None, page(50)) + node_rows(51, "two", "<html><body></body></html>")
    nodes = spark.createDataFrame([(*r[:11], r[11]) for r in rows], SCHEMA)
    twice = nodes.unionByName(nodes)
    value = {(r[0], r[1]): r[6] for r in rows}
    got = boilerplate.main_text_nodes(twice).collect()
    assert len(got) == len({(r.doc_id, r.node_id) for r in got})
    assert {value[r.doc_id, r.node_id] for r in got if r.doc_id == 3} == {"Story 3", "Unique words 3 of the story ", "bold", "."}
    assert {r.doc_id for r in got} == {*range(6), 50}
    found = residue.residue_nodes(twice).collect()
    assert {(value[r.doc_id, r.node_id], r.kind) for r in found} == {("{{x}}", "placeholder")} and len(found) == 7
    assert boilerplate.main_text_nodes(nodes.limit(0)).collect() == [] and residue.residue_nodes(nodes.limit(0)).collect() == []


def test_residue_in_code_is_none(spark):
    rows = node_rows(1, "s", "<html><body><pre>{{ x }}<b>{{ y }}</b></pre><code>{{ z }}</code><p>{{ w }}</p></body></html>")
    found = residue.residue_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [dict(zip([r[1] for r in rows], [r[6] for r in rows], strict=True))[f.node_id] for f in found] == ["{{ w }}"]


def test_residue_of_a_text_does_not_hang_on_others_with_its_mask(spark):
    placeholders = ["https://x.test/{{slug}}", "See https://x.test/{{id}}", "__USER__@x.test", "{x12}"]
    sound = ["https://a.test/a", "https://x.test/~", "See https://a.test/a", "See https://y.test/z", "a@x.test", "zoe@x.test", "{x1,2}"]
    rows = [(k, 1, f"s{k % 3}", t) for k, t in enumerate(placeholders + sound)]
    texts = spark.createDataFrame(rows, "doc_id long, node_id int, site string, value string")
    assert {(rows[r.doc_id][3], r.kind) for r in residue.residue(texts).collect()} == {(t, "placeholder") for t in placeholders}


APACHE = "Not Found. The requested URL /a/b.html was not found on this server. Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request. Please contact the server administrator at admin@a.test and tell them when it happened."
NOTICE = "This site needs JavaScript to show its pages. Please enable JavaScript in your browser settings to continue. In some browsers you have to open the menu of settings and allow scripts there. In others you need to turn on JavaScript under privacy. Then reload this page and the scripts are allowed to start as they should."
TRACE = "Uncaught Error: Call to undefined function f() in /srv/a.php:12 Stack trace: " + " ".join(f"#{k} /srv/part{k}.php({k}): f{k}()" for k in range(30))
PROSE = "JavaScript was written in ten days. It came with a browser that few people use today. Many pages required it soon. " + "The harbour town where its author lived has a library and a market. " * 6


@pytest.mark.parametrize(("text", "kind"), [(APACHE, "message"), (NOTICE, "scripts"), (TRACE, "message"), (PROSE, ""), ("Not found. " + PROSE, "")])
def test_messages_of_any_length(text, kind):
    assert len(text) > 240 and residue.whole(FORM(text)) == kind


def test_bodies_in_boxes_stay(spark):
    words = "harbour lantern meadow orchard tunnel bridge kettle valley mill garden ferry market".split()

    def piece(rng):
        return " ".join(rng.choice(words) for _ in range(40)) + "."

    def html(k, body):
        return f'<html><body><h1>Story {words[k]}</h1>{body}<div class="m"><h3>Read also</h3><p>Get our letter every week.</p></div></body></html>'

    rng = random.Random(5)
    copied = f"<div><p>{piece(rng)}</p><p>{piece(rng)}</p></div>"
    rows = []
    for doc, (site, k, kind) in enumerate([(s, k, kind) for s in ("one", "two", "three") for k in range(4) for kind in ("div", "chapters", "copied")]):
        body = {
            "div": f'<div class="b"><p>{piece(rng)}</p><p>{piece(rng)}</p></div>',
            "chapters": f"<section><h2>Introduction</h2><p>{piece(rng)}</p></section><section><h2>Summary</h2><p>{piece(rng)}</p></section>",
            "copied": copied if k == 0 else f"<div><p>{piece(rng)}</p></div>",  # one article on three hosts
        }[kind]
        rows += node_rows(doc, site, html(k, body))
    got = {(r.doc_id, r.node_id) for r in boilerplate.main_text_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = {(r[0], r[1]) for r in rows if r[3] == "text" and r[6] not in ("Read also", "Get our letter every week.")}
    assert got == kept


def test_tokens_are_sifted_together(repairer, monkeypatch):
    """The readings of many tokens are looked for in the few pairs of encodings that can hold one; the results are those of each text by itself."""
    counts = mojibake.pair_counts(CLEAN * 400).astype(np.float32)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgéèüößñçåøабвгдежзαβγδεжи“”’–") for _ in range(rng.randint(3, 9))) + f" {c}" for c in CLEAN for _ in range(4)]
    for text in [*CLEAN, "日本語の文章です。東京は大きい", "中文句子，很长"]:
        for meant in ("utf-8", *mojibake.WIDE, *mojibake.NARROW[::3]):
            for assumed in mojibake.ASSUMED[::2]:
                texts.append(text.encode(meant, "ignore").decode("cp1252" if assumed == "latin" else assumed, "replace"))
        for assumed in mojibake.ASSUMED_WIDE:
            texts += [f"{t.encode()[cut:].decode(assumed, 'replace')}{t}" for t in (text, *MORE) for cut in (0, 1)]
    texts += ["", "plain", "日本語", texts[0], f"{CLEAN[0]} {texts[99]}", "é" * 300, "鈥檚 a sentence", "\U0001f600é\U0001f600", "a\nÃ©\n日é日"]
    rng.shuffle(texts)
    tried, spans = [0], mojibake.Repairer._wide_spans

    def counted(*args):
        tried[0] += 1
        return spans(*args)

    monkeypatch.setattr(mojibake.Repairer, "_wide_spans", counted)
    expected = [repairer.repair(t) for t in texts]
    alone, tried[0] = tried[0], 0
    assert mojibake.Repairer(counts).repair_all(texts) == expected
    assert tried[0] * 4 < alone
    monkeypatch.setattr(mojibake, "SIFTED_CHARS", 200)  # short stretches, and texts beyond them
    assert mojibake.Repairer(counts).repair_all(texts) == expected


def test_sieve_keeps_every_reading(repairer):
    """Whatever pair of encodings a token reads better in is among those that the sieve keeps."""
    keys = []
    for text in [*CLEAN, "日本語の文章です", "한국어", "很长的中文"]:
        for name in (*mojibake.WIDE, *mojibake.NARROW[::2]):
            for assumed in mojibake.ASSUMED[::2]:
                seen = text.encode(name, "ignore").decode("cp1252" if assumed == "latin" else assumed, "replace")
                for left, right in ((" ", " "), ("\n", "日"), ("é", "\U0001f600")):
                    keys += [left + w + right for w in seen.split() if not w.isascii()]
    keys = list(dict.fromkeys(keys))
    repairer.repair_all([f"é{k}" for k in range(99)])
    hopes = repairer.sieve.hopes(keys)
    found = [repairer._readings(k[0], k[1:-1], k[-1]) for k in keys]
    assert sum(map(bool, found)) > 50
    assert all({pair for pair, _ in f} <= {" ".join(h) for h in hope} for f, hope in zip(found, hopes, strict=True))
    assert found == [repairer._readings(k[0], k[1:-1], k[-1], hope) for k, hope in zip(keys, hopes, strict=True)]
