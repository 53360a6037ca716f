"""The text operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helmtrace.llm import byte_bpe, line_dedup, packing, pii, quality_model, quality_rules, simhash, token_counts
from helmtrace.llm import html_text
from helmtrace.llm.html_text import Block, extract, main_text, path_scores
from helmtrace.llm.queries import COUNT_RANKS, RANKS, WORD_PIECES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
LONG = "a long line of text " * 20_000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three four"), (4, "one two three four"), (5, "é日本 😀 x\n\ny"), (6, LONG), (None, "one two three four"), (7, "\n\n\n")]


def documents(spark, n=None):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return docs if n is None else docs.limit(n)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(df):
    names = ["_ids", "_text", "_fp", "_words", "_n_words", "_kept", "_score", "_spans", "_version", "_dropped", "_n_lines", "id", "doc", "fp", "h1", "pos", "line", "key", "component_id", "v", "w", "cell", "start"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Quality rules


def repeated_by_hand(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len({i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)})


@pytest.mark.parametrize("make", [documents, odd])
def test_quality_statistics_match_counts_by_hand(spark, make):
    for row in quality_rules.judge(make(spark)).collect():
        text = row["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        repeated = repeated_by_hand(words)
        assert row["_n_words"] == len(words)
        assert row["_word_chars"] == sum(map(len, words))
        assert row["_n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["_n_dup_lines"] == len(lines) - len(set(lines))
        assert row["_n_repeat_words"] == repeated
        assert row["_base_failed"] == (len(words) < 50 or 100 * repeated > 50 * len(words))


PROSE = {
    "en": "The committee met in the old town hall, and it was clear that most of the members had read the report. It is a long text, but the first part of it sets out what was done and why. For a number of years the group had tried to find a way to bring water to the villages in the hills, and that was not easy on the poor roads of the time. In the end a plan was made, and the work was given to a small firm from the coast. The report is open about the costs, which were higher than planned, and about the time it took to build the last of the wells in the north of the region.",
    "de": "Der Ausschuss traf sich in dem alten Rathaus, und es war klar, dass die meisten den Bericht gelesen hatten. Er ist lang, aber der erste Teil zeigt, was in den Jahren getan wurde und von wem. Die Gruppe hatte sich mit der Frage befasst, wie das Wasser zu den Dörfern auf den Bergen kommt, und die Wege waren schlecht. Am Ende stand ein Plan, und die Arbeit ging an eine kleine Firma von der Küste. Der Bericht spricht offen von den Kosten, die höher waren als gedacht, und von der Zeit, die das Bauen der letzten Brunnen in dem Norden des Landes brauchte. Auf die Frage nach den Folgen gab es von den Leuten auf dem Land die Antwort, dass sich das Leben mit dem Wasser sehr geändert hat.",
    "fr": "La commission se tint dans la vieille salle de la mairie, et il est clair que les membres avaient lu le rapport. Le texte est long, mais la partie de tête dit que les travaux des années passées ont été faits avec soin. Le groupe cherchait un moyen de porter de l'eau dans les villages des collines, et les routes de la région étaient mauvaises. Un plan fut fait en mai, et une petite entreprise de la côte eut le travail. Le rapport est franc sur le coût, plus haut que prévu, et sur le temps pris pour creuser les puits du nord de la région. Les gens de la vallée disent que la vie est plus simple, et que les enfants ont le temps de lire et de jouer en paix dans les rues du village.",
    "es": "La comisión se reunió en la vieja sala del ayuntamiento, y era claro que los miembros conocían el informe. El texto es largo, pero la primera parte dice lo que se hizo en los años pasados y por qué. El grupo buscaba un modo de llevar el agua a los pueblos de las colinas, y los caminos de la región eran malos. En mayo se hizo un plan, y una empresa pequeña de la costa tomó el trabajo. El informe habla de los costes, que fueron más altos de lo previsto, y del tiempo que se tardó en abrir los pozos del norte de la región. La gente del valle dice que la vida es más fácil, y que los niños tienen el tiempo de leer y de jugar en las calles del pueblo por la tarde.",
}


@pytest.mark.parametrize("language", sorted(PROSE))
def test_quality_keeps_prose_and_refuses_its_disfigured_forms(spark, language):
    text = PROSE[language]
    forms = {
        1: text,
        2: text.upper().replace(" ", "!! "),
        3: " ".join(w + "###" for w in text.split()),
        4: " | ".join(w for w in text.split() if len(w) > 4) + " | " + " | ".join(w[::-1] for w in text.split() if len(w) > 4),
        5: " ".join(w for w in text.split()[:20] for _ in range(8)),
    }
    kept = {r["doc_id"]: r["_kept"] for r in quality_rules.judge(spark.createDataFrame(list(forms.items()), SCHEMA)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_quality_runs_no_python_on_executors(spark):
    plan = quality_rules.judge(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_on_random_strings(reference):
    rng = random.Random(5)
    marks = list("aZé's tredmlvLL'' \t\n\r   09²½٣,.!?#'\"日本語한😀́‍\u0085\x1c _")
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(1000)]
    texts += ["", "'s", "'S's'res", "x" * 3000, "   ", " \n\n a", "a  "]
    found = byte_bpe.encode_texts(texts, RANKS, block_chars=500)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
        assert byte_bpe.decode_ids(ids, RANKS).decode() == text


def test_classes_agree_with_the_library_for_every_code_point(reference):
    # Around each code point letters, so that its class shows in the pieces.
    rng = random.Random(1)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + rng.sample(range(0xE000, 0x20000), 3000)
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in points]
    for text, ids in zip(texts, byte_bpe.encode_texts(texts, RANKS)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)


def test_encode_column_keeps_rows_and_offsets(spark, reference):
    rows = byte_bpe.decode(byte_bpe.encode(clashing(odd(spark)), RANKS), RANKS).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r["text"] or ""
        ids = np.frombuffer(bytes(r["_ids"]), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert bytes(r["_decoded"]).decode() == text
        starts = np.frombuffer(bytes(r["_offsets"]), "<u4").tolist()
        data = text.encode()
        pieces = byte_bpe.load_pieces(RANKS)
        assert all(data[a : a + len(pieces[i])] == pieces[i] for a, i in list(zip(starts, ids))[:2000])
    assert byte_bpe.encode(empty(spark), RANKS).count() == 0


# HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body>"
    "<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies, really.</div>"
    "{body}<aside>More stories, here.</aside><div id=comments><p>First comment, by a reader.</p></div><form><label>Name</label></form>"
    "<footer>&copy; site</footer></body></html>"
)


def test_main_text_of_pages():
    text = "A sentence of some length, with marks. Another one follows it, as is usual."
    for body in (
        f"<article><h1>Head &amp; line</h1><p>{text}</p><p>Short.</p><div class=ad>Buy now, cheap.</div></article>",
        f"<div class=content><h1>Head &amp; line</h1><p>{text}<p>Short.</div>",
        f"<main><h1>Head\n &amp;   line</h1><p><b>{text}<br><p>Short.</p></main>",
    ):
        assert main_text(PAGE.format(body=body)) == f"Head & line\n{text}\nShort."
    for wrapped in (
        f"<div class='layout with-sidebar'><article><div class=entry-header><h1>Head</h1></div><p>{text}</p></article><div class=sidebar><p>{text}</p></div></div>",
        f"<div id=page-ads><main><h1>Head</h1><p>{text}</p><div id=comments><article class=comment-body><p>{text} Nice!</p></article></div></main></div>",
    ):
        assert main_text(wrapped) == f"Head\n{text}"
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>open &amp paragraph &am") == "open & paragraph &am"
    assert main_text("<p>a < b</p><p") == "a < b"
    assert main_text("<article>" + "<p>" + "x " * 100_000 + "</article>") == ("x " * 100_000).strip()
    assert main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert len(main_text("<div>" + "".join(f"<div>{i}" for i in range(30_000)) + "</div>")) > 0
    assert main_text("<p title=it's>one</p><p alt='a>b' class=\"x>y\">two's</p><p id=\"open>three</p>") == "one\ntwo's\nthree"


def test_main_text_keeps_what_lies_around_the_densest_part():
    text = "A sentence of some length, with marks. Another one follows it, as is usual."
    paragraphs = f"<p>{text}</p>" * 8
    body = "\n".join([text] * 8)
    for page in (
        f"<article><h1>T</h1><p>intro</p><div class=entry-content>{paragraphs}</div></article>",
        f"<main><div><h1>T</h1></div><div><p>intro</p></div><div><div>{paragraphs}</div></div></main>",
        f"<div id=page><h1>T</h1><p>intro</p><div class=entry-content>{paragraphs}</div></div>",
    ):
        assert main_text(PAGE.format(body=page)) == f"T\nintro\n{body}"
    for tag in ("article", "main", "div"):
        two = f"<{tag}><section>{f'<p>{text}</p>' * 13}</section><section>{f'<p>{text}</p>' * 7}</section></{tag}>"
        assert main_text(PAGE.format(body=two)) == "\n".join([text] * 20)
        for dominant in (f"<ul>{f'<li>{text}' * 9}</ul>", f"<table>{f'<tr><td>{text}' * 9}</table>", f"<blockquote>{paragraphs}<p>{text}</p></blockquote>"):
            around = f"<{tag}><h2>T</h2><p>before</p>{dominant}<p>after, {text}</p></{tag}>"
            assert main_text(PAGE.format(body=around)) == "\n".join(["T", "before", *[text] * 9, f"after, {text}"])
    # Menus without a mark stay out, beside an article or where nothing names it; links within it stay.
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a>" for i in range(9)) + "</ul>"
    assert main_text(f"<body>{menu}<div id=page><h1>T</h1><div>{paragraphs}</div></div></body>") == f"T\n{body}"
    assert main_text(f"<body>{menu}<p>tagline</p><div id=page><h1>T</h1><div>{paragraphs}</div></div></body>") == f"tagline\nT\n{body}"
    assert main_text(f"<body>{menu}<article><h1>T</h1><div>{paragraphs}</div><ul><li><a href=/s>Source</a></ul></article></body>") == f"T\n{body}\nSource"


def test_marks_of_a_whole_block_count():
    plain, dense = "name " * 400, "a, b. " * 500
    scores = [path_scores([Block("p", (1,), text, False, 0)])["p"] for text in (plain + dense, dense + plain)]
    assert scores[0] == scores[1] == pytest.approx((len(plain + dense) * (1 + 1000)) ** 0.5)


def test_extraction_equals_the_article_of_given_pages(spark):
    from html import unescape

    for row in extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*(>|$)", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["_text"] == "\n".join(b for b in blocks if b)


COURT = [f"The court heard case {i} on Monday, and it was brief. Then it rose." for i in range(12)]
NOISY = (
    "<html><body><header>Site</header><nav><a href=/>Home</a></nav><div>A small tagline</div><div class=cookie-notice>We use cookies, really.</div>{}"
    f"<div id=comments>{'<p>First comment, by a reader. Nice.</p>' * 9}</div><div>Copyright 2024 Example Ltd. All rights reserved.</div></body></html>"
)
WRAPPERS = (
    "<div>{}</div>",
    "<form id=aspnetForm>{}</form>",
    "<article class='post-1 hentry category-legal'>{}</article>",
    "<div class='post comments-open'>{}</div>",
    "<div id=wrap class='tag-social single'>{}</div>",
    "<form id=f><div id=wrap class='tag-social single'>{}<div class=comments><p>Me too, really.</p></div></div></form>",
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_mark_on_the_wrapper_of_an_article_is_lifted(wrapper):
    inner = "<h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in COURT)
    expected = "\n".join(["Head", *COURT])
    assert main_text(NOISY.format(wrapper.format(inner))) == expected
    assert main_text(f"<body>{wrapper.format(inner)}</body>") == expected
    listed = inner + "<ul><li>Ann</ul><table><tr><td>1<td>2</table>"
    assert main_text(NOISY.format(wrapper.format(listed))) == expected + "\nAnn\n1\n2"
    several = wrapper.format(inner) + wrapper.format("<div class=entry-content>" + inner + "</div>")
    assert main_text(NOISY.format(f"<div>{several}</div>")) == "\n".join([expected, expected])


def test_path_scores_decide_where_nothing_names_the_article(monkeypatch):
    pages = [NOISY.format(f"<div><h1>Head {i}</h1>{''.join(f'<p>{t}</p>' for t in COURT[: 4 + i % 8])}</div>") for i in range(40)]
    right = ["\n".join([f"Head {i}", *COURT[: 4 + i % 8]]) for i in range(40)]
    assert [main_text(p) for p in pages] == right
    draw = random.Random(1)
    monkeypatch.setattr(html_text, "path_scores", lambda page: {b.path: draw.random() for b in page})
    assert sum(main_text(p) != r for p, r in zip(pages, right)) > 20


def test_path_ratios_by_hand():
    page = [Block(p, 0, t, False, 0) for p, t in (("h", "Head"), ("p", "One, two."), ("p", "Three."), ("d", "no marks"))]
    # Lengths and marks per block of each path, then one eighth of either neighbour and three quarters of the block itself.
    length, marks = {"h": 4, "p": 7.5, "d": 8}, {"h": 0, "p": 1.5, "d": 0}
    order = ["h", "p", "p", "d"]
    smooth = {"h": [], "p": [], "d": []}
    for i, path in enumerate(order):
        near = [order[max(0, i - 1)], path, order[min(3, i + 1)]]
        smooth[path].append([sum(w * of[n] for w, n in zip((0.125, 0.75, 0.125), near)) for of in (length, marks)])
    for path, got in path_scores(page).items():
        text, mark = (sum(column) / len(smooth[path]) for column in zip(*smooth[path]))
        assert got == pytest.approx((text * (1 + mark)) ** 0.5)


def test_given_pages_without_the_article_element_keep_their_article(spark):
    plain = F.regexp_replace("html", "<(/?)article>", "<$1div>")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    whole = {r["page_id"]: r["_text"] for r in extract(pages).collect()}
    assert {r["page_id"]: r["_text"] for r in extract(pages.withColumn("html", plain)).collect()} == whole


def test_pages_of_links_or_furniture_have_no_text():
    assert main_text("<ul><li><a href=/a>One</a><li><a href=/b>Two, three.</a></ul>") == ""
    assert main_text("<div class=cookie-notice>We use cookies, really.</div>") == ""
    assert main_text("<p hidden>" + " ".join(COURT)) == main_text("<aside>" + " ".join(COURT)) == ""


def test_odd_markup_takes_linear_time():
    deep = "<div>" + "".join(f"<div class=ad>{i}" for i in range(30_000)) + "</i></b></section>" * 30_000
    assert isinstance(main_text(deep), str)


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>t</p>", "y")], "page_id long, html string, _text string")
    assert sorted(r["_text"] for r in extract(pages).collect()) == ["", "", "t"]
    assert extract(pages.limit(0)).count() == 0


# SimHash


def print_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in prints}


def test_fingerprints_and_components_match_brute_force(spark):
    docs = documents(spark)
    prints = {k: print_by_hand(t) for k, t in texts_of(docs).items()}
    rows = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups_by_hand(prints)


def test_crowded_blocks_give_the_same_components(spark):
    rng = random.Random(2)
    prints = {}
    for center in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            fp = center
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                fp ^= 1 << bit
            prints[len(prints)] = fp
    prints.update({1000 + i: rng.getrandbits(64) for i in range(200)})
    signed = sorted({fp - (1 << 64) if fp >> 63 else fp for fp in prints.values()})
    edges = simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    found = groups_by_hand({s: s & (1 << 64) - 1 for s in signed})
    label = {s: s for s in signed}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert label == found


def test_simhash_on_odd_rows(spark):
    rows = simhash.near_duplicates(clashing(odd(spark))).collect()
    assert len(rows) == len(ODD)
    by_id = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {by_id[(i, 0)] for i in (1, 2, 3, 7)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, None)} == {4}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = [r["doc_id"] for r in simhash.dedup(clashing(odd(spark))).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 4, 5, 6, None], key=str)


def test_simhash_dedup_tells_two_texts_of_one_id_apart(spark):
    rows = [(1, "one two three four"), (2, "one two three four"), (2, "quite another text of its own")]
    kept = simhash.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]


# Line dedup


def lines_by_hand(texts):
    holders = {}
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            key = re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
            if len(key) >= 10:
                holders.setdefault(key, set()).add(doc)
    out = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r")), set())
            if len(held) < 2 or doc == min(held):
                kept.append(line)
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


CASES = {
    1: "A line that is shared\nown line one of doc",
    2: "  a LINE that is shared\t\nshort\nshort\nA line that is shared",
    3: None,
    4: "\n\n",
    5: "É line that is shared\né line that is shared \n" + "\n".join(f"line number {i}" for i in range(200)),
    6: "\n".join(f"line number {i}" for i in range(150, 400)) + "\nshort",
    7: "tail without end\r\nline number 3\r",
}


def test_line_dedup_matches_brute_force(spark):
    for texts in (CASES, texts_of(documents(spark))):
        docs = spark.createDataFrame(list(texts.items()), SCHEMA)
        rows = line_dedup.dedup_lines(clashing(docs)).collect()
        assert {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["text"]) for r in rows} == lines_by_hand(texts)


def test_line_dedup_on_odd_rows(spark):
    rows = line_dedup.dedup_lines(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r["text"] for r in rows if r["doc_id"] is None} == {"one two three four"}
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["one two three four"] * 2
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


def test_two_texts_of_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "a shared line here\nx"), (2, "y\na shared line here"), (2, "a shared line here\nsomething else")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"] for r in out) == ["a shared line here\nx", "something else", "y"]


# Token counts


def test_attribution_matches_a_loop(spark):
    rng = random.Random(3)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 8))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        rng.shuffle(sections)
        edges = sorted(rng.sample(range(61), 15))
        starts, ends = np.array(edges[:-1]), np.array(edges[1:])
        want, crossing, outside = [0] * len(sections), 0, 0
        for a, b in zip(starts, ends):
            over = [(max(0, min(b, hi) - max(a, lo)), -lo, k) for k, (lo, hi) in enumerate(sections)]
            best = max(over, default=(0, 0, 0))
            if best[0] <= 0:
                outside += 1
                continue
            want[best[2]] += 1
            crossing += best[0] < b - a
        counts, crossed, out = token_counts.attribute(starts, ends, sections)
        assert (counts.tolist(), crossed, out) == (want, crossing, outside)


def test_line_counts_add_up_to_the_document(spark):
    rows = token_counts.attribute_sections(clashing(odd(spark)).unionByName(clashing(documents(spark))), COUNT_RANKS).collect()
    assert len(rows) == len(ODD) + documents(spark).count()
    for r in rows:
        text = r["text"] or ""
        assert len(r["_sections"]) == len(text.split("\n"))
        assert sum(r["_tokens"]["counts"]) + r["_tokens"]["n_outside"] == r["_tokens"]["n_tokens"]
        assert r["_tokens"]["n_outside"] == 0
        assert "".join(text[s["start"] : s["end"]] for s in r["_sections"]) == text


def test_fields_are_sections(spark):
    docs = spark.createDataFrame([(1, "a title", None, "the body of it")], "doc_id long, title string, note string, body string")
    with_fields = token_counts.field_sections(docs, ["title", "note", "body"])
    row = token_counts.attribute_sections(with_fields, COUNT_RANKS, "_joined", "_fields").first()
    assert [s["name"] for s in row["_sections"]] == ["title", "note", "body"]
    assert sum(row["_tokens"]["counts"]) == row["_tokens"]["n_tokens"] and min(row["_tokens"]["counts"]) >= 1


# Personal data


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(documents(spark))


def test_patterns():
    text = "mail a.b@c-d.org. ip 10.0.0.1 and 300.1.1.1 card 4111-1111 1111 1111, 4111111111111112; call +1 (212) 555-0147 or +1 2"
    found = [(k, text[a:b]) for a, b, k in pii.base_spans(text)]
    assert found == [("email", "a.b@c-d.org"), ("ip", "10.0.0.1"), ("card", "4111-1111 1111 1111"), ("phone", "+1 (212) 555-0147")]


def test_every_base_span_stays_and_prose_is_left_alone(spark, tagger):
    rows = pii.find(documents(spark), tagger).collect()
    for r in rows:
        base = {(s["kind"], s["start"], s["end"]) for s in r["_base"]}
        assert base == {(k, a, b) for a, b, k in pii.base_spans(r["text"])}
        assert base <= {(s["kind"], s["start"], s["end"]) for s in r["_spans"]}
    clean = [PROSE["en"] + " In 1998, 12 of 340 came; 3.5 percent, or 7,000. token = \"24be64439e3e49cf46b2d7\" password=e1c093f22d39"]
    assert pii.model_spans(clean, tagger) == [[]]


def test_tagger_learns_held_out_forms():
    made = pii.training_examples([], seed=7)
    model = pii.train(made, pii.KINDS)
    unseen = [x for x in pii.training_examples([], seed=99) if x[1]]
    tags, _ = model.decode(np.stack([pii.char_ids(t) for t, _ in unseen]))
    from helmtrace.llm.crf_tagger import gold_tags

    right = [(row == gold_tags(spans, pii.KINDS)).all() for row, (_, spans) in zip(tags, unseen)]
    assert np.mean(right) > 0.9


def test_tagger_finds_a_form_that_no_pattern_has(tagger):
    text = "call me at (212) 555-0147 in the evening then"
    assert pii.base_spans(text) == []
    assert [text[a:b] for a, b, _ in pii.model_spans([text], tagger)[0]] == ["(212) 555-0147"]


def test_gradient_of_the_tagger():
    from helmtrace.llm.crf_tagger import Tagger

    rng = np.random.default_rng(0)
    model = Tagger.fresh(["a", "b"])
    model.weights = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in model.weights.items()}
    ids, gold = rng.integers(0, 100, (3, 9)), np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0]] * 3)
    _, grad = model.loss_and_gradient(ids, gold)
    for name, at in (("fore", (2, 3)), ("back", (14, 20)), ("moves", (0, 1)), ("out", (5, 2)), ("first", (0,)), ("embed", (int(ids[0, 2]), 1)), ("fore_b", (5,))):
        old, step = model.weights[name][at], 1e-5
        model.weights[name][at] = old + step
        up, _ = model.loss_and_gradient(ids, gold)
        model.weights[name][at] = old - step
        down, _ = model.loss_and_gradient(ids, gold)
        model.weights[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-3


def test_personal_data_on_odd_rows(spark, tagger):
    rows = pii.find(clashing(odd(spark)), tagger).collect()
    assert len(rows) == len(ODD) and not any(r["_spans"] for r in rows)
    assert pii.find(empty(spark), tagger).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.org y"), (2, None), (3, "1" * 5000), (4, "10.0.0.1" * 900)], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, tagger).collect()}
    assert out[1] == "x [EMAIL] y" and out[2] is None and "10.0.0.1" * 2 not in (out[4] or "")


def test_windows_cover_all_triggers_with_overlap():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aaaaaaaaaaaaaaaaaaaaaaaa1@") for _ in range(rng.randint(0, 400)))
        starts = pii.windows(text)
        assert all(s >= 0 for s in starts)
        near = {j for i, c in enumerate(text) if c in "1@" for j in range(max(0, i - pii.REACH), min(len(text), i + pii.REACH + 1))}
        assert near <= {j for s in starts for j in range(s, s + pii.WINDOW)}


# Quality classifier


def test_classifier_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = quality_model.classify(docs, labels).withColumn("held", quality_model.fold("doc_id") == quality_model.HELD_OUT).join(labels, "doc_id").collect()
    assert all(r["held"] == (quality_model.crc_of(r["doc_id"]) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held"]]
    assert np.mean([(r["_score"] >= 0.5) == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["_score"] <= 1 for r in rows)


def test_classifier_never_sees_held_out_labels(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)


def test_forest_walk_equals_a_recursive_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(800, len(quality_model.FEATURES)))
    labels = (rows[:, 0] * rows[:, 1] > 0).astype(float)
    forest = quality_model.grow(rows, labels, trees=15)

    def walk(node, bins):
        while forest.left[node] != node:
            node = forest.left[node] if bins[forest.feature[node]] <= forest.cut[node] else forest.right[node]
        return forest.value[node]

    bins = forest.bins(rows)
    want = [forest.base + sum(walk(r, b) for r in forest.roots) for b in bins]
    assert np.allclose(forest.margin(rows), want)
    assert np.mean((forest.score(rows) >= 0.5) == labels) > 0.9


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int")
    rows = quality_model.classify(clashing(odd(spark)), labels).collect()
    assert len(rows) == len(ODD) and all(r["_score"] == 0.5 for r in rows)
    assert quality_model.classify(empty(spark), labels).count() == 0


# Packing


def check_sequences(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[doc][at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], bytes(r["ids"]), r["doc_tokens"]) == (at, zlib.crc32(part), part, len(ids[doc]))
            at += r["length"]
        assert at == len(ids[doc])
    assert by_doc.keys() == ids.keys()
    return padding / (packing.CAPACITY * len(by_sequence) or 1)


def tokens(texts):
    tokenizer = Tokenizer.from_file(WORD_PIECES)
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}


def test_packing_places_every_id_once_with_little_padding(spark):
    texts = texts_of(documents(spark))
    assert check_sequences(packing.pack(clashing(documents(spark)), WORD_PIECES).collect(), tokens(texts)) < 0.02


def test_packing_odd_texts(spark):
    texts = {1: None, 2: "", 3: "ÀÉ don't <|endoftext|> 12 ſΣΣ ǅ́", 4: "́x  é e ́ y", 5: LONG, 6: "日本語\x1cx\ny\x0bz"}
    texts |= {7: "a<|endoftext|>B <|ENDOFTEXT|> <|startoftext|><|endoftext|> < |x|>", 8: "\x85a\xa0b caf\xe9 \xb5 \xbd \x00 \x1d", 9: "it's IT'S 's\n\n.\t!? ''re"}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    check_sequences(packing.pack(docs, WORD_PIECES).collect(), tokens(texts))
    assert packing.pack(empty(spark), WORD_PIECES).count() == 0
    assert packing.pack(odd(spark), WORD_PIECES).where("doc_id IS NULL").agg(F.sum("length")).first()[0] == 5


def test_cuts_and_closing_waste_little():
    for n in [*range(1, 4200, 7), 2048, 4096, 2047]:
        lengths = packing.cut_lengths(n)
        assert sum(lengths) == n and max(lengths) <= 2048 and len(lengths) <= n // 2048 + 6
    packer = packing.Packer()
    one = np.array([1], "<u4").tobytes()
    sequences = [s for n in (5, 700, 33, 2048, 1999) for s in packer.add(n, one * n)] + list(packer.close())
    sizes = [sum(len(p[2]) // 4 for p in s) for s in sequences]
    assert sum(sizes) == 5 + 700 + 33 + 2048 + 1999
    assert list(packer.close()) == []


def test_pii_query_against_the_patterns(spark):
    from helmtrace.llm.queries import op7_pii

    texts = texts_of(documents(spark))
    for r in op7_pii(spark, SMALL).collect():
        base = pii.base_spans(texts[r["doc_id"]])
        told = [f"{k}:{a}:{b}" for a, b, k in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) | {""}


def test_sha_of_queries_matches_texts(spark):
    from helmtrace.llm.queries import op2_byte_bpe

    texts = texts_of(documents(spark))
    for r in op2_byte_bpe(spark, SMALL).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# The contract's patterns, written out again.
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_by_hand(text):
    out = []
    for kind, pattern in PLAIN_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return out


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(2)
    pieces = ["a", "B9", "@", "@", ".", "..", "-", "+", "%", " ", "1", "25", "0255", "256", "4111111111111111", "+49 30 5550 1234", "x@y.zz", "(", ")", "\n", "é", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == spans_by_hand(text), text


def test_long_runs_take_linear_time():
    for run in ("0" * 5000 + "1.1.1.1", "7" * 3_000_000, "a" * 3_000_000 + "@", "a." * 1_000_000 + "@b.c", "@" * 1_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "a@b" * 300_000):
        began = time.monotonic()
        spans = pii.base_spans(run)
        assert time.monotonic() - began < 20
        assert len(spans) == {"0": 1, "a.": 1}.get(run[:2].rstrip("0") or "0", len(spans))


def test_the_sample_of_the_quality_model_is_bounded_in_rows(spark, monkeypatch):
    docs = spark.range(40_000).select(F.when(F.col("id") < 30_000, 5).otherwise(F.col("id") % 40).alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    own = quality_model.grow
    monkeypatch.setattr(quality_model, "grow", lambda rows, *a, **k: (seen.append(len(rows)), own(rows, *a, **k))[1])
    quality_model.fit(docs, labels, sample_rows=20)
    assert seen == [20]
