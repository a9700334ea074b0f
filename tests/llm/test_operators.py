"""Each operator against brute force or a library, on inputs with every awkward case."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import byte_bpe, decontaminate, html_text, jaccard_join, language_id, nearest, repeats, substring_dedup, suffix_dedup, token_files, url_lists
from packetloom.llm.common import stored
from packetloom.llm.components import components
from packetloom.llm.hashes import Runs, word_values
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return cases.documents(spark, [])


def test_html_layout():
    page = """<title>x</title><p>One <b>two</b>
three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><table><tr><th>Name<th>N<tr><td>longer<td>1</table>
<pre>  x
    y</pre><div hidden>no</div><i style="display:none">no</i>tail &amp; <span>in</span>line<script>"</p>"</script><!-- z"""
    assert html_text.page_text(page) == (
        "One two three\n\nFour\nfive\n\n- a\n- b\n  3. c\n  4. d\n\nName   | N\nlonger | 1\n\n  x\n    y\n\ntail & inline")


def test_html_formulas_and_drawings():
    page = """<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow><annotation encoding="TeX">x=2 tex</annotation>
<annotation-xml><ci>no</ci></annotation-xml></semantics></math> hold.</p><div><svg><title>no</title><desc>no</desc><style>no</style>stray
<script href="x"/><defs><text>no</text></defs><path d="M0"/><g><text x=1>North <tspan>Sea</tspan></text><text>South</text></g><foreignObject><p>inside</p></foreignObject>
</svg>after</div>"""
    assert html_text.page_text(page) == "Let x=2 hold.\n\nNorth Sea South\n\ninside\n\nafter"


def test_html_spans_and_wide_tables():
    page = """<table><tr><th rowspan=2>a<th>b<th rowspan=0>c<tr><td>d<tr><td>e<td>f<tbody><tr><td>g<td>h<td>i</table>"""
    assert html_text.page_text(page) == "a | b | c\n  | d |\ne | f |\ng | h | i"
    words = [f"word{k}" for k in range(200)]
    wide = f"<table><tr><td>{' '.join(words)}<td>one<td>x<tr><td>short<td>three<td>{' '.join(words)}<tr><td>{'u' * 500}<td>v<td>w</table>"
    lines = html_text.page_text(wide).split("\n")
    edge = lines[0].index(" | ")
    assert 150 < edge <= 200 and lines[0][edge:] == " | one   | x"
    rest = [x for x in lines[1:] if not x.startswith(("short", "u"))]
    assert " ".join(x[:edge].strip() for x in [lines[0], *rest]).split() == words and all(x[edge:].strip(" |") == "" for x in rest)
    assert "short".ljust(edge) + " | three | " + " ".join(words) in lines and "u" * 500 + " | v     | w" in lines


@pytest.mark.parametrize("page,shown", [
    ("<p title=it's>one</p><p>two don't</p><p>three</p>", "one\n\ntwo don't\n\nthree"),
    ('<a href="x"">click</a> says "hello"', 'click says "hello"'),
    ('<p title="x>lost</p>kept', "lost\n\nkept"),
    ('<p title="a > b" hidden>no</p>yes', "yes"),
    ("a<!-->b<!--->c<!-- no --!>d</ no>e</>f<?no>g<!no>h", "abcdefgh"),
    ("<script>no</scripted></script no>yes", "yes"),
    ("<img alt=first alt=second><img/alt='third'><img alt = x/>", "firstthirdx/"),
    ("1 < 2 <3 <b>x", "1 < 2 <3 x"),
    ("one <b title='two", "one <b title='two"),
    ("<table><tr><td rowspan=0000002>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\nd"),
    ("<table><tr><td colspan=1000>a<td>b<tr><td>c<td></table>", "a | b\nc"),
])
def test_html_markup_as_browsers_read_it(page, shown):
    assert html_text.page_text(page).replace(" |\n", " |\n") == shown


@pytest.mark.parametrize("unit", ["<a ", "<!x ", "</script ", "<p a='", '<a b="', "<script></script ", "<tr><td rowspan=0 colspan=1000>", "<p>", "<svg/>"])
def test_html_time_is_linear(unit):
    def seconds(size):
        begin = time.process_time()
        html_text.page_text("<table>" * unit.startswith("<tr") + unit * (size // len(unit)))
        return time.process_time() - begin

    assert seconds(1 << 18) < 4 and seconds(1 << 20) < 16


def test_html_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p"), (4, "<div>" * 5000 + "deep"), (5, "</p></table>a<td>b"), (5, "</p></table>a<td>b")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id int, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id, str(r.text)) for r in got) == [(1, "None"), (2, ""), (3, "<p"), (4, "deep"), (5, "ab"), (5, "ab")]


def test_elias_fano_and_blocks():
    for values in ([], [0], [0, 0, 5, 5, 1 << 40], list(np.sort(np.random.default_rng(1).integers(0, 10**7, 3000)))):
        made, size = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes()))
        assert made.values().tolist() == list(values) == [made.select(i) for i in range(len(values))]
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 70)]
    block = token_files.Block(token_files._block(0, 0, 0, ids, [None, -5, 9])["payload"])
    assert block.doc_ids() == [None, -5, 9] and [block.document(i).tolist() for i in range(3)] == [list(range(n)) for n in (3, 0, 70)]


def test_token_files_round_trip(spark, docs, nothing, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    definition = open(path, encoding="utf-8").read()
    token_files.write_tokens(docs, definition, 1, str(tmp_path / "a"))
    got = token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "a"))).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    coded = {}
    for d, t, _ in cases.ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        coded.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((r[0] for r in cases.ROWS), key=lambda x: (x is not None, x or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), *x) for d, v in coded.items() for x in v)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    token_files.write_tokens(nothing, definition, 1, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_bpe_equals_the_library(spark, docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = byte_bpe.read_vocabulary(RANKS, public_tokenizers.PATTERN)
    assert all(vocabulary.ids[vocabulary.hash.candidate(t)] == i for t, i in ranks.items())
    rnd = random.Random(3)
    for text in ["", "\x1c a\x1f\x85b\xa0   x", "a" * 5000, "İΣς '’s I'll", "<|endoftext|>", " " * 99, *("".join(chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(160, 0xD000)))) for _ in range(200)) for _ in range(20))]:
        assert np.frombuffer(vocabulary.encode(text), "<i4").tolist() == library.encode_ordinary(text)
    coded = byte_bpe.encode(docs.select("doc_id", "text"), vocabulary)
    got = byte_bpe.decode(coded, vocabulary).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == sorted((str(d), cases.raw(t)) for d, t, _ in cases.ROWS)
    assert byte_bpe.encode_and_decode(spark, nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_digests_are_those_of_the_library(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))] += 1
    got = byte_bpe.encode_and_decode(spark, docs, RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected


def test_bpe_decodes_lists_of_any_kind(spark):
    vocabulary = byte_bpe.read_vocabulary(RANKS, public_tokenizers.PATTERN)
    some, other = vocabulary.ids[300], vocabulary.ids[-1]
    table = spark.createDataFrame([(1, None), (2, []), (3, [some, other, some]), (4, None), (5, [other])], "n int, token_ids array<int>").coalesce(1)
    a, b = vocabulary.tokens[some], vocabulary.tokens[other]
    assert {r.n: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(table, vocabulary).collect()} == {1: None, 2: bytearray(), 3: a + b + a, 4: None, 5: b}
    assert byte_bpe.decode(table.where("n < 3"), vocabulary).count() == 2
    for wrong in (-1, max(vocabulary.ids) + 1, None):
        with pytest.raises(Exception):
            byte_bpe.decode(spark.createDataFrame([(1, [some, wrong])], "n int, token_ids array<int>"), vocabulary).collect()


def test_decontamination_finds_what_is_contained(spark, docs, nothing):
    items = [(1, cases.text_of(1, 40)), (2, cases.LONG[2000:2300]), (3, None), (4, ""), (5, "two words"), (6, "never seen in any of the documents here"), (1, cases.text_of(1, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    expected = set()
    for d, t, _ in cases.ROWS:
        for i, x in items:
            w = words(x)
            own = grams(w, min(5, len(w))) if w else set()
            hit = len(own & grams(words(t), min(5, len(w)))) if own else 0
            if own and hit >= 0.8 * len(own):
                expected.add((d, i, len(own), hit))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == expected and len(got) > 5
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _, _ in cases.ROWS if d not in {e[0] for e in expected} or d is None and _ is None)
    assert decontaminate.leaks(nothing, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_url_lists_by_date(spark):
    log = spark.createDataFrame([
        ("block", "domain", "bad.com", "add", 10), ("block", "domain", "bad.com", "remove", 20), ("block", "domain", "bad.com", "add", 30),
        ("allow", "prefix", "x.bad.com/ok", "add", 0), ("block", "host", "bad.com", "add", 10), ("block", "host", "bad.com", "remove", 10),
        ("block", None, None, "add", 1), ("block", "host", "tie.com", "add", 5), ("block", "host", "tie.com", "add", 5)], "list string, kind string, value string, action string, dated int")
    captures = spark.createDataFrame([
        (1, "http://x.bad.com/a", 9), (2, "http://x.bad.com/a", 10), (3, "http://x.bad.com/a", 20), (4, "https://u@X.BAD.com:8/ok/z?q", 35),
        (5, "http://bad.com", 15), (6, None, 15), (7, "not a url", 15), (8, "http://bad.com/", None), (9, "http://tie.com./", 6), (9, "http://tie.com./", 6)], "id int, url string, fetched_at int").withColumn("verdict", F.lit("clash"))
    got = sorted((r.id, r.verdict, r.n_active) for r in url_lists.evaluate(captures, log).collect())
    assert got == [(1, "none", 0), (2, "block", 1), (3, "none", 0), (4, "allow", 2), (5, "block", 1), (6, "none", 0), (7, "none", 0), (8, "none", 0), (9, "block", 1), (9, "block", 1)]
    assert {r.verdict for r in url_lists.evaluate(captures, log.limit(0)).collect()} == {"none"}


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    vectors[700:800] = vectors[700]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0, 2.0]), (5100, []), (None, rows[0][1])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))).collect()
    single = vectors.astype(np.float32).astype(float)
    scores = single @ single.T
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert sorted(found) == list(range(0, 1500, 20))
    for q, own in found.items():
        own.sort()
        order = sorted((x for x in range(1500) if x != q), key=lambda x: (-round(scores[q, x], 9), x))[:20]
        assert [x[0] for x in own] == list(range(1, 21)) and all(abs(s - scores[q, v]) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(order))
    assert hits / (20 * len(found)) >= 0.9
    few = nearest.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")).collect()
    assert [(r["rank"], r.query_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 0), (2, 0), (3, 0)]


def test_nearest_recall_with_uneven_norms(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 64))
    vectors *= np.exp(rng.normal(size=(3000, 1))) / np.linalg.norm(vectors, axis=1)[:, None]
    vectors[7] *= 1000 / np.linalg.norm(vectors[7])
    got = nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    true = {q: set(np.argsort(-scores[q])[:20].tolist()) for q in range(0, 3000, 20)}
    recall = sum(r.vec_id in true[r.query_id] for r in got) / (20 * len(true))
    assert recall >= 0.9
    want = {q for q, own in true.items() if 7 in own}
    assert len({r.query_id for r in got if r.vec_id == 7} & want) >= 0.9 * len(want)


def test_nearest_returns_all_of_few(spark):
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=64) for i in range(15)} | {40 + i: rng.normal(size=32) for i in range(30)}
    got = nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), every=1).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(found[q] == set(range(15)) - {q} for q in range(15))
    assert all(len(found[q]) == 20 and found[q] <= set(range(40, 70)) - {q} for q in range(40, 70))
    opposed = [(i, (v * (1 if i else -1)).tolist()) for i, v in enumerate(1 + rng.normal(size=(300, 64)) / 20)]
    got = nearest.search(spark.createDataFrame(opposed, "vec_id long, embedding array<double>"), every=1000).collect()
    dense = np.array([v for _, v in opposed])
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == (1 + np.argsort(-(dense[1:] @ dense[0]))[:20]).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, width, percent):
    got = jaccard_join.join(docs, width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard_components(cases.ROWS, width, percent)


def test_jaccard_chains_and_blocks(spark, nothing):
    rnd = random.Random(11)
    rows = []
    for k in range(40):  # chains: each text differs by a word or two from the one before
        words = [f"v{rnd.randrange(400)}" for _ in range(rnd.choice((12, 60, 120)))]
        for step in range(6):
            rows.append((1000 * k + step, " ".join(words), "en"))
            words = list(words)
            for _ in range(rnd.choice((0, 1, 2))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
    old, jaccard_join.BLOCK = jaccard_join.BLOCK, 2  # splits neighbourhoods into blocks
    try:
        got = jaccard_join.join(cases.documents(spark, rows)).collect()
    finally:
        jaccard_join.BLOCK = old
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard_components(rows, 3, 90)
    assert jaccard_join.join(nothing).count() == 0


def test_open_pairs_follow_members(spark, monkeypatch):
    rnd = random.Random(12)
    short, long = ([f"w{rnd.randrange(10**6)}" for _ in range(n)] for n in (100, 1500))
    rows = []
    for k in range(400):  # copies that differ in one of eight places: links inside a place only
        words = list(short)
        words[20 + 4 * (k % 8)] = f"n{rnd.randrange(10**9)}"
        rows.append((k, " ".join(words), "en"))
    for k in range(24):  # just below the threshold, and so near that points do not tell; every fourth is copied and links
        words = list(long)
        for at in rnd.sample(range(0, 1500, 4), 15):
            words[at] = f"n{rnd.randrange(10**9)}"
        rows += [(1000 + 10 * k + c, " ".join(words + ["more"] * c), "en") for c in range(1 + (k % 4 == 0))]
    made, real = [], jaccard_join.open_pairs

    def counted(*args):
        out = stored(real(*args), "counted")
        made.append(out.where("sid is not null").count())
        return out

    monkeypatch.setattr(jaccard_join, "open_pairs", counted)
    monkeypatch.setattr(jaccard_join, "ROOM", (0,), raising=False)  # then whole sets
    got = jaccard_join.join(cases.documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard_components(rows, 3, 90)
    assert 0 < sum(made) < 10 * len(rows), made  # all pairs inside the places: some 9 000, in each neighbourhood


def test_one_of_each_keeps_clean_rows(spark, docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, None, 16, 17, 17]))


def test_bound_never_hides_a_pair():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.integers(0, 600, 256) for _ in range(2))
        clip = lambda x: np.minimum(x, 255).astype(np.uint8)
        assert jaccard_join.bound(clip(a), a.sum(), clip(b), b.sum()) >= np.minimum(a, b).sum()


def test_runs_follow_content():
    rng = np.random.default_rng(4)
    text = b" ".join(b"t%d" % x for x in rng.integers(0, 50, 400))
    data, edges = repeats.joined([text, b"", b"short", b"other words before " + text])
    values, at = word_values(data, edges)
    runs = Runs(values, at, 13, 5)
    assert int(runs.count[runs.text == 0].sum()) == 400 - 12
    first, last = (set(runs.content[runs.text == t].tolist()) for t in (0, 3))
    assert len(first & last) >= len(first) - 1


def test_substring_dedup(spark, docs, nothing):
    got = substring_dedup.remove(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == cases.without_repeated_words(cases.ROWS, 13)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove(nothing).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_suffix_dedup(spark, docs, nothing, crowd):
    old, suffix_dedup.CROWD = suffix_dedup.CROWD, crowd  # 0: every contested window goes through the index
    try:
        got = suffix_dedup.remove(docs).collect()
    finally:
        suffix_dedup.CROWD = old
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == cases.without_repeated_bytes(cases.ROWS, 400)
    assert suffix_dedup.remove(nothing).count() == 0


def test_suffix_sort_orders_and_verifies():
    rnd = random.Random(8)
    piece = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    edges = np.r_[0, np.cumsum([len(p) for p in piece])]
    group = np.array([len(p) % 2 for p in piece])
    own = suffix_dedup.Suffixes(np.frombuffer(b"".join(piece), dtype=np.uint8), group, edges[:-1], edges[1:])
    order = own.sorted()
    assert order.tolist() == sorted(range(200), key=lambda k: (group[k], piece[k], k))
    common = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    pairs = zip(order[:-1], order[1:])
    assert own.extensions(order)[1:].tolist() == [common(piece[a], piece[b]) if group[a] == group[b] else 0 for a, b in pairs]


def test_language_profiles(spark, docs, nothing):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (4, 5, 6, 11)) and odd[7].lang_pred in ("en", "fr")
    assert language_id.identify(nothing).count() == 0
    codes, _, which = language_id.grams(["ab a", None, "Éa"])
    names = {c for k in range(3) for c in ("a", "b", " a", "ab", "b ", "a ", " ab", "ab ", " a ", "é", " é", "éa", " éa", "éa ")}
    spelled = {"".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(c) >> s & 0x1FFFFF) for c in codes[np.unique(which)]}
    assert spelled == names
