"""Token counts, the lattice, line dedup and HTML against plain versions."""

import json
import re

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest

from plumbline.llm import html_wrappers, line_dedup, sentencepiece_lattice, token_counts

WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
PIECE_PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_count(word, pieces, longest):
    symbols = list(word.encode())
    symbols[-1] += 256
    at = n = 0
    while at < len(symbols):
        at += next(k for k in range(min(longest, len(symbols) - at), 0, -1) if tuple(symbols[at : at + k]) in pieces)
        n += 1
    return n


def test_token_counts_equal_greedy_matching(make_docs, odd_texts):
    letters = token_counts.byte_letters()
    with open(WORD_PATH, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    pieces = {s for s in (token_counts.symbols_of(n, letters) for n in names) if s} | {(b + m,) for b in range(256) for m in (0, 256)}
    longest = max(map(len, pieces))
    texts = [*odd_texts, "Unbelievable internationalisation's 12345 ... Ünïcödé ﬁn", "thththing " * 50]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(make_docs(texts), WORD_PATH).collect()}
    for i, text in enumerate(texts):
        words = token_counts.words_of(text or "")
        assert got[i] == (len(words), sum(plain_count(w, pieces, longest) for w in words))
    assert token_counts.token_counts(make_docs([]), WORD_PATH).collect() == []


def test_small_automaton_pops():
    matcher = token_counts.Automaton(iter([(1,), (2,), (3,), (1, 2), (2, 3, 1), (1, 2, 3, 1, 2)]))
    assert matcher.count([1, 2, 3, 1, 2]) == 1
    assert matcher.count([1, 2, 3, 1]) == 3
    assert matcher.count([1, 2, 3, 1, 3]) == 4
    assert matcher.count([]) == 0


def plain_path(unit, scores, byte_ids, longest, unknown):
    best = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        paths = []
        for start in range(max(0, end - longest), end):
            if found := scores.get(unit[start:end]):
                paths.append((best[start][0] + found[1], -(start + 1), best[start][2] + [found[0]]))
            elif end - start == 1:
                paths.append((best[start][0] + unknown, -(start + 1), best[start][2] + [byte_ids[b] for b in unit[start:end].encode()]))
        best.append(max(paths))
    return best[-1][2]


def test_lattice_equals_plain_viterbi_and_decodes(make_docs, odd_texts, tmp_path):
    pieces, byte_ids, decoded = sentencepiece_lattice.model(PIECE_PATH)
    scores = {piece: (i, score) for i, piece, score in pieces}
    unknown = min(s for _, _, s in pieces if s > -1e8) - sentencepiece_lattice.UNKNOWN_BELOW
    texts = [*odd_texts, "The quick brown fox\n\njumps\tover 12 dogs.", "日本語のテキスト and ქართული"]
    make_docs(texts).write.parquet(str(tmp_path / "docs"))
    docs = make_docs(texts).sparkSession.read.parquet(str(tmp_path / "docs"))
    encoded = sentencepiece_lattice.encode(docs, PIECE_PATH)
    rows = {r["doc_id"]: r for r in sentencepiece_lattice.decode_rows(encoded, PIECE_PATH).collect()}
    longest = max(len(p) for _, p, _ in pieces)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        units = sentencepiece_lattice.units_of(text)
        assert rows[i]["text"] == text.replace("▁", " ")
        assert rows[i]["n_units"] == len(units)
        known = {u: plain_path(u, scores, byte_ids, longest, unknown) for u in set(units)}
        assert rows[i]["ids"] == [x for u in units for x in known[u]]


@pytest.mark.parametrize("frequent", [200_000, 50, 0])
def test_merges_give_the_ids_of_the_library(make_docs, odd_texts, sf, spark, tmp_path, monkeypatch, frequent):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_lattice, "FREQUENT", frequent)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH)
    texts = [*odd_texts, "The quick brown fox: evidence\n\njumps\tover 12 dogs.", "日本語のテキスト and ქართული", "a" + " " * 40 + "b", "日本語" * 200, "\n", "<s> <0x0A> ▁x ▁▁", "abcdefghij" * 60 + "-" * 300, "①" * 250, "\r\x00\n " * 3]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    make_docs(texts).write.parquet(str(tmp_path / "docs"))
    encoded = sentencepiece_lattice.encode(spark.read.parquet(str(tmp_path / "docs")), PIECE_PATH, merges=True)
    rows = {r["doc_id"]: r for r in sentencepiece_lattice.decode_rows(encoded, PIECE_PATH).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == library.encode(text or "")
        assert rows[i]["text"] == (text or "").replace("▁", " ")
    make_docs([None, ""]).write.parquet(str(tmp_path / "none"))
    assert [r["ids"] for r in sentencepiece_lattice.encode(spark.read.parquet(str(tmp_path / "none")), PIECE_PATH, merges=True).collect()] == [[], []]


def test_merge_fold_needs_parts_before_pieces(monkeypatch):
    pieces = [(0, "a", -9.0), (1, "b", -9.0), (2, "c", -9.0), (3, "bc", -5.0), (4, "abc", -2.0)]
    monkeypatch.setattr(sentencepiece_lattice, "model", lambda path: (pieces, (), ("",) * 5))
    with pytest.raises(ValueError, match="earlier parts"):
        sentencepiece_lattice.merge_order("late part")
    pieces[3] = (3, "bc", -1.0)
    assert sentencepiece_lattice.merge_order("early part") == ([(0, "a", 2), (1, "b", 2), (2, "c", 2), (3, "bc", 0), (4, "abc", 1)], 3)


def test_lattice_of_nothing(make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "docs"))
    docs = make_docs([]).sparkSession.read.parquet(str(tmp_path / "docs"))
    assert sentencepiece_lattice.encode(docs, PIECE_PATH).collect() == []


def test_line_dedup_equals_sql(make_docs, spark):
    rows = [(i, f"Header\nbody {i}\n  Footer \n\nbody {i % 7}", "src0") for i in range(40)]
    rows += [(50 + i, f"Header\nother {i}", None) for i in range(5)] + [(60, None, "src1"), (61, "", "src1"), (62, "only\nonly", "src2"), (63, "Header", "src3")]
    rows += [(70, "copy\nof a page", "src0")] * 30 + [(None, "Header\nno id", "src0")]
    shared = "\n".join(f"shared text number {i}" for i in range(9))
    rows += [(200 + i, f"Header\n{shared}\nvariant {i}", "src5") for i in range(30)] + [(300 + i, f"Header\nthe own text of page {i}", "src5") for i in range(30)]
    for ratio, least in ((0.01, 3), (0.3, 3), (0.5, 10)):
        docs = make_docs(rows)
        got = line_dedup.without_boilerplate(docs, ratio, least)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
        want = con.execute(line_dedup.SQL.format(ratio=ratio, min_pages=least)).fetchall()
        mine = [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()]
        assert sorted(map(repr, mine)) == sorted(map(repr, want))
        assert all(shared in r[1] for r in mine if r[0] in range(200, 230))
    copies = [r for r in mine if r[0] == 70]
    assert len(copies) == 30 and copies[0][1] == "copy\nof a page"
    assert line_dedup.without_boilerplate(make_docs([])).collect() == []


def test_line_dedup_keeps_near_copies_and_clashing_columns(make_docs):
    copies = [(i, "\n".join(f"line {n} of a story" for n in range(10)) + f"\nvariant {i}", "small") for i in range(3)]
    docs = make_docs(copies + [(10 + i, f"page {i}\nMenu", "small") for i in range(47)]).withColumnsRenamed({"score": "n_lines", "length": "n_dropped"})
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(docs).collect()}
    assert all(got[i]["text"] == text and got[i]["n_dropped"] == 0 for i, text, _ in copies)
    assert all(got[10 + i]["text"] == f"page {i}" and got[10 + i]["n_lines"] == 2 for i in range(47))
    kept = {r["doc_id"]: r for r in line_dedup.cleaned(docs).collect()}
    assert {r["n_lines"] for r in kept.values()} == {"clash"} and kept[10][line_dedup.N_DROPPED] == 1


PAGE = (
    '<!DOCTYPE html><html><head><title>{t}</title><script>var a="<p>no</p>";</script></head><body><nav><ul>{menu}</ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><h1>{t}</h1>{paras}<div class="tools">Print this page</div>'
    '<aside>See also</aside><form><p>Your mail</p></form></article><div id="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>'
)


def page(title, paragraphs, menu=3):
    return PAGE.format(t=title, paras="".join(f"<p>{p}" for p in paragraphs), menu="".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(menu)))


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, f"https://www.a.example/{i}", page(f"Title {i}", [f"one {i} &amp; <b>bold</b>", f"two\n  {i}<br>more"][: 1 + i % 2], i)) for i in range(6)]
    rows += [(10, "http://user@B.example:80/x", "<p>a<p>b &lt;c&gt;"), (11, None, None), (12, "not a url", ""), (13, "http://c.example", "plain < text"), (14, "http://d.example", "<div><p>cut <b of"), (0, "https://www.a.example/0", page("Title 0", ["one 0 &amp; <b>bold</b>"], 0))]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_pages_become_their_articles(site):
    pages, rows = site
    got = [tuple(r) for r in html_wrappers.page_texts(pages).collect()]
    assert len(got) == len(rows)
    texts = {r[0]: r[2] for r in got}
    for i in range(6):
        assert texts[i] == "\n".join([f"Title {i}", f"one {i} & bold", f"two {i} more"][: 2 + i % 2])
    assert texts[10] == "a\nb <c>" and texts[11] == "" and texts[12] == "" and texts[13] == "plain < text" and texts[14] == "cut"
    assert all(r[3] == len(r[2]) for r in got)


def test_wrapper_has_optional_and_repeated_groups():
    a = html_wrappers.wrapper_of("<ul><li>x</li><li>y</li></ul><p>t</p>")
    b = html_wrappers.wrapper_of("<ul><li>x</li></ul><h2>n</h2><p>u</p>")
    ul, h2, p = html_wrappers.aligned(a, b)
    assert ul[0] == "ul" and ul[3][0][2] == 1
    assert h2[:2] == ["h2", 1] and p[:2] == ["p", 0]
    assert p[3][0][2] != p[3][0][3] and p[3][0][4] == 2
    dl = html_wrappers.wrapper_of("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")
    assert [n[0] for n in dl[0][3]] == ["()"]


def test_merge_order_keeps_slots():
    parts = [html_wrappers.wrapper_of(page(f"T{i}", ["x"] * (i + 1), i)) for i in range(4)]
    one = parts[0]
    for p in parts[1:]:
        one = html_wrappers.aligned(one, p)
    two = html_wrappers.aligned(html_wrappers.aligned(parts[3], parts[2]), html_wrappers.aligned(parts[1], parts[0]))
    assert {p for p, _ in html_wrappers.slots(one)} == {p for p, _ in html_wrappers.slots(two)}


def test_class_words_drop_only_whole_blocks():
    text = lambda page: html_wrappers.main_text(page, frozenset())
    for page in (
        "<body class='has-sidebar'><p>a</p></body>",
        "<body class='sidebar'><p>a</p></body>",
        "<main class='with-sidebar'><p>a</p></main>",
        "<main class='widget'><p>a</p></main>",
        "<article class='post comments-open'><p>a</p></article>",
        "<article class='sponsored'><p>a</p></article>",
        "<article><section id='social-impact'><p>a</p></section></article>",
        "<article><p class='notice'>a</p></article>",
        "<article><h2 id='search'>a</h2></article>",
        "<article><h2 id='related-work'>a</h2></article>",
        "<div class='widget'><article><p>a</p></article></div>",
        "<div class='widget'><div data-id='ad' data-class=menu title='x class=ad'><p>a</p></div><main></main></div><main><p>a</p></main>",
        "<div><p>a</p></div><div class='ad x'>b</div><div class='cookie-notice'>c</div><p class='notice'>d</p>",
        "<article><p>a</p><div class='x sidebar'>b</div><div id='comments'><article class='comment'><p>c</p></article></div></article>",
        "<article><p>a</p></article><div id='comments'><article class='comment'><p>c</p></article></div>",
    ):
        assert text(page) == "a", page
    assert text("<div data-id='ad'><p>a</p></div>") == "a"


def test_copies_and_repeats_are_one_page(spark):
    lone = "<article><h1>T</h1><p>one<p>two<ul><li>item</li></ul><figcaption>fig</figcaption><div>box</div></article>"
    plain = "<h1>T</h1><p>one</p><blockquote>q</blockquote><p>two</p>"
    equal = "<article><p>one<p>two<ul><li>x</li><li>x</li><li>x</li></ul></article>"
    for number, html in enumerate((lone, plain, equal)):
        texts = []
        for copies in (1, 3, 20):
            # copies differ in what is no main text
            rows = [(i, f"http://h{number}.example/{i}", html + f"<footer>{i}</footer><!-- {i % 2} -->") for i in range(copies)]
            got = html_wrappers.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
            texts += [r["text"] for r in got]
        assert len(texts) == 24 and len(set(texts)) == 1
        assert texts[0] == html_wrappers.main_text(html, frozenset())
    rows = [(i, "http://t.example/", f"<div>Print</div><p>body {i}</p>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"body {i}" for i in range(3)}


def test_deep_and_broken_markup():
    deep = "<div>" * 3000 + "inside" + "</p></div>" * 10
    assert html_wrappers.main_text(deep, frozenset()) == "inside"
    assert json.dumps(html_wrappers.wrapper_of(deep))
    assert html_wrappers.main_text("<article><p>one<p>two</article><p>out", frozenset()) == "one\ntwo"


def test_no_pages(spark):
    assert html_wrappers.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_units_are_cut_as_a_plain_pattern_cuts_them():
    mark = sentencepiece_lattice.MARK
    pattern = re.compile(f"{mark}+[^{mark}\n]*|\n|[^{mark}\n]+")
    texts = [None, "", " ", "  a  ", "\n", "\n\n a\n", f"{mark}{mark}b {mark}c", "é" * 200 + " x" * 3, "ab" * 100, " 日本語\n語 " * 40, "x"]

    def plain(text):
        units = pattern.findall(mark + text.replace(" ", mark)) if text else []
        return [part for unit in units for part in ([unit] if len(unit) <= sentencepiece_lattice.MERGE_CHARS else sentencepiece_lattice.unjoined(unit, PIECE_PATH))]

    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(3, 6), pa.array(texts[:2], pa.string())):
        words, numbers, counts = sentencepiece_lattice.uncut_units(sentencepiece_lattice.whole_texts(column), PIECE_PATH)
        words, ends = words.to_pylist(), [0, *counts.cumsum().tolist()]
        assert [[words[i] for i in numbers[a:b]] for a, b in zip(ends, ends[1:])] == [plain(text) for text in column.to_pylist()]
