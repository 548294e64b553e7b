"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from check import compare
from rankflow.llm import (bpe, bpe_codec, components, decontaminate, html_extract, line_dedup, quality_cnn, quality_rules,
                          quote_threads, secret_scan, simhash, token_counts)
from rankflow.llm.sql import ORACLE

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
CLASH = ("n_words long", "rank long", "_row long", "hits string", "row string", "fp long")


def table(spark, rows):
    """Documents of (id, text), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *[7, 8, 9, "h", "r", 3]) for i, t in rows],
                                 "doc_id long, text string, " + ", ".join(CLASH))


EDGES = [(1, None), (2, ""), (3, " \t\n\x0b "), (None, "a null id"), (4, LONG), (5, PASSAGE), (5, PASSAGE), (6, PASSAGE)]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def benchmark(spark, rows=((1, "alpha beta gamma"), (2, None), (3, "")), kind="long"):
    return spark.createDataFrame(list(rows), f"item_id {kind}, text string")


@pytest.mark.parametrize("run", [
    lambda d: quality_rules.apply_policy(quality_rules.ledger(d)), lambda d: bpe_codec.digests(d, WORDS),
    lambda d: bpe_codec.encode(d, WORDS), lambda d: token_counts.counts(d, BYTES), simhash.near_duplicates,
    lambda d: decontaminate.report(d, benchmark(d.sparkSession)), line_dedup.report, secret_scan.scan,
    lambda d: quality_cnn.classify(d, quality_cnn.train([], np.zeros(0)))])
def test_a_row_for_each_row(edges, nothing, run):
    assert sorted(str(r.doc_id) for r in run(edges).collect()) == sorted(str(i) for i, _ in EDGES)
    assert run(nothing).collect() == []


@pytest.mark.parametrize("run,left", [
    (quality_rules.screen, 4), (line_dedup.deduplicate, 6), (simhash.deduplicate, 4),
    (lambda d: decontaminate.clean(d, benchmark(d.sparkSession)), 8)])
def test_stages_hand_on_all_columns(edges, nothing, run, left):
    out = run(edges)
    assert out.columns == edges.columns and out.count() == left
    assert {r[2:] for r in out.collect()} == {(7, 8, 9, "h", "r", 3)}
    assert run(nothing).count() == 0


def test_quality_policies_and_ablation(spark):
    book = quality_rules.ledger(table(spark, [(1, "a b " * 60), (2, " ".join(f"word{i}" for i in range(80))), (3, "### " * 10),
                                              (4, " ".join(f"w{i} ##" for i in range(60)))]))
    lax = quality_rules.Policy("lax", 2, ["few_words"])
    got = {(r.policy, r.rule): (r.n_failed, r.n_only_this, r.n_kept_without)
           for r in quality_rules.ablation(book, [quality_rules.POLICY, lax]).collect()}
    assert got["lax", "few_words"] == (1, 1, 4)
    assert got["pretraining", "many_symbols"] == (2, 1, 2)
    assert got["pretraining", "repeats_itself"] == (2, 0, 1)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_policy(book, lax).collect()}
    assert kept == {1: (True, False), 2: (False, True), 3: (True, False), 4: (False, True)}


def test_merges_and_proofs_agree():
    v = bpe.load(WORDS)
    proofs = bpe.Proofs(v)
    inner, final = {i: w for w, i in v.inner.items()}, {i: w for w, i in v.final.items()}
    rng = np.random.default_rng(1)
    a, b = rng.choice(list(inner), 4000), rng.choice(list(final), 4000)
    fits = proofs.compatible(a, b)
    assert 0 < fits.sum() < len(fits)
    for x, y, fit in zip(a.tolist(), b.tolist(), fits.tolist()):
        assert (bpe.merge(inner[x] + final[y], v) == [x, y]) == fit
    stable = proofs.stable()
    assert all((bpe.merge(w, v) == [i]) == stable[i] for w, i in list(v.final.items())[::37])
    for word in ("ab" * 200, "aaaaaaa" * 30, "interna" * 20):
        ids = [v.inner[c] for c in word[:-1]] + [v.final[word[-1]]]
        assert bpe._merge_short(list(ids), v.merges) == bpe._merge_long(list(ids), v.merges)


def test_codes_of_odd_texts_are_the_library_s():
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b <|startoftext|> ΣΑΣ İI ſ K", "it's WE'LL 'S ''s x'ré 123 ４５ ½ \u0085 \x1c", "ab" * 3000, "é́̀ ﬁ",
             "<|endoftext|>", "<|endoftext|><|endoftext|> x", "՘a࢏ \U0001F468‍\U0001F469", "", "   \n\n  x  "]
    words, counts = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    codec, counter = bpe_codec.Codec(bpe.load(WORDS)), token_counts.Counter(bpe.load(BYTES))
    for text, ids, written in zip(texts, codec.encode(texts), codec.written(texts)):
        want = words.encode(text, add_special_tokens=False).ids
        assert ids == want and written == (len(want), " ".join(map(str, want)), words.decode(want, skip_special_tokens=False))
        assert counter.count(text) == len(counts.encode(text, add_special_tokens=False).ids)


def test_chains_lose_no_link():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    for flips in (1, 2, 3):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        for a, b in zip(x, y):
            assert any(len(simhash.chained(a, np.array([b]), s)) for s in range(simhash.SEGMENTS))
    far = x ^ np.uint64(0b1111)
    assert not any(len(simhash.chained(a, np.array([b]), s)) for a, b in zip(x, far) for s in range(simhash.SEGMENTS))


def test_crowded_keys_are_dealt_in_blocks(spark, monkeypatch):
    """Hundreds of fingerprints around one, in blocks of a few, are linked as all pairs link them."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    prints = {0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)}
    prints |= {int(p) for p in rng.integers(0, 2 ** 62, 50)}
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    got = {}
    for r in simhash.classes(frame).collect():
        got.setdefault(r.root, set()).add(r.fp % (1 << 64))
    left, want = set(prints), []
    while left:
        group, rim = set(), {left.pop()}
        while rim:
            p = rim.pop()
            group.add(p)
            near = {q for q in left if (p ^ q).bit_count() <= 3}
            left -= near
            rim |= near
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks give what one gives; short items, null ids and repeats of an id are defined."""
    item = " ".join(f"q{i}" for i in range(30))
    items = [(1, item), (2, "lone"), (3, "two words"), (None, "nameless"), (3, "other words"), (4, None)]
    docs = table(spark, [(1, "x " * 40 + item.upper() + " y"), (2, "Lone nameless TWO-words"), (3, "w " * 100 + "lone"), (4, None)])
    want = {1: (71, 30, 1, True), 2: (4, 4, 2, True), 3: (101, 1, 1, False), 4: (0, 0, 0, False)}
    for chars in (decontaminate.BLOCK_CHARS, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        rows = decontaminate.report(docs, benchmark(spark, items)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows} == want
        assert next(r.longest_match for r in rows if r.doc_id == 1) == 30
    found, c = decontaminate.search(docs, benchmark(spark, items))
    match = found.where("c0 = 1").select(c["matches"].alias("m")).first().m
    assert [tuple(m) for m in match] == [("1", 0, 40, 30)]


def test_line_runs(spark):
    other = "\n".join(f"line {i} of a second passage with words" for i in range(12))
    docs = table(spark, [(1, f"head\n{PASSAGE}\n\ntail"), (2, f"x\n{other}\ny"), (3, f"{PASSAGE}\nown words"),
                         (4, f"a\n{other}\nb"), (5, "\n".join([PASSAGE] * 3)), (6, "tail\nhead"), (7, "tail\nhead")])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.report(docs).collect()}
    assert got == {1: (3, 0, f"head\n{PASSAGE}\n\ntail"), 2: (14, 0, f"x\n{other}\ny"), 3: (2, 1, "own words"),
                   4: (14, 12, "a\nb"), 5: (3, 3, ""), 6: (2, 0, "tail\nhead"), 7: (2, 0, "tail\nhead")}


def test_weak_parts_need_each_other(spark):
    key = "Zk3" * 12
    texts = {1: f"user=robert key {key} end", 2: f"key {key} end", 3: "user=robert", 4: "user=robert " + "x " * 200 + key,
             7: f"user=robert\n\n{key}", 8: f"user=robert\n \t\nx\n[part b]\r\n{key}", 9: "user=robert\n" + "opt=1\n" * 60 + key,
             10: f"{key}\n---\nuser=robert\nhost\n===\n{key}", 11: f"[a]\nuser=robert\n[b] x\n{key}", 12: "user=" + "Zk3" * 12,
             13: f"\n\n\n[a]\nlogin: bob1\n{key}\n\n{key}", 14: f"AKIA{'Q7' * 10}\n{key}\n\n{key}",
             5: "é user=robert at https://host.example.com/x", 6: "token=abc token=token:abcdef"}
    rows = secret_scan.scan(table(spark, list(texts.items()))).collect()
    got = {r.doc_id: [(s.split(":")[0], texts[r.doc_id][slice(*map(int, s.split(":")[1:]))]) for s in r.spans.split(",") if s]
           for r in rows}
    assert got == {1: [("identifier", "user=robert"), ("random", key)], 2: [], 3: [],
                   4: [("identifier", "user=robert"), ("random", key)], 7: [], 8: [], 9: [("identifier", "user=robert"), ("random", key)],
                   10: [], 11: [("identifier", "user=robert"), ("random", key)], 12: [],
                   13: [("identifier", "login: bob1"), ("random", key)], 14: [("access", f"AKIA{'Q7' * 10}"), ("random", key)],
                   5: [("identifier", "user=robert"), ("endpoint", "https://host.example.com/x")], 6: []}


def test_weak_parts_are_whole_at_any_length(spark):
    long, url = "Zk3" * 400, "https://host.example.com/" + "path/" * 100 + "end"
    parts = {1: ("user=robert", long), 2: ("user=robert", "/" + "aB3+" * 20 + "/=="), 3: ("user=robert", url),
             4: ("user=robert", "postgresql://db.example.com/x"), 5: ("user=robert", "mongodb+srv://db.example.com/x"),
             6: ("login=" + "a.b-" * 50 + "c", url), 7: ("user" + " " * 20 + "= robert", "jdbc:postgresql://db.example.com/x"),
             8: ("user=robert", "/" + "aB3" * 12 + "+")}
    texts = {i: f"see {' and '.join(p)} there" for i, p in parts.items()}
    rows = secret_scan.scan(table(spark, list(texts.items()))).collect()
    for r in rows:
        found = [texts[r.doc_id][slice(*map(int, s.split(":")[1:]))] for s in r.spans.split(",") if s]
        assert set(parts[r.doc_id]) <= set(found), r.doc_id
    many = "a-b+" * 20_000 + " " + "a/" * 20_000 + "_ user=robert"
    assert [r.doc_id for r in secret_scan.scan(table(spark, [(1, many)])).collect()] == [1]


def test_finds_of_one_text_take_linear_time(spark):
    """A dump of 100,000 hexadecimal words, with weak parts in all of its scopes."""
    texts = {1: " ".join(f"{i:032x}" for i in range(100_000)),
             2: "\n\n".join(f"user=name{i} {'Zk3' * 12} {'9a' * 16}" for i in range(20_000))}
    started = time.monotonic()
    got = {r.doc_id: r for r in secret_scan.scan(table(spark, list(texts.items()))).collect()}
    assert time.monotonic() - started < 60
    assert got[1].n_hex == 100_000 and got[1].spans.count(",") == 99_999
    assert got[2].n_hex == 20_000 and got[2].spans.count("identifier") == got[2].spans.count("random") == 20_000


def test_secrets_equal_their_sql(spark):
    """Random joins of parts, words, breaks and joiners, through the operator and through the SQL."""
    rng = np.random.default_rng(6)
    pieces = ["user=robert", "login: bob_1", "username = 'x.y", "client_id=abc", "AKIA" + "Q7" * 9, "9a" * 16, "Zk3" * 12,
              "Zk3" * 40 + "==", "https://h.example/p", "jdbc:my-sql://db/x", "a-jdbc:b://host/y", "x+y://hhhh", "mongodb+srv://db.e/x",
              "password=hunter22", "token: 'abc.def", "api_key=" + "Zk3" * 12, "\n", "\n\n", "\n[part]\n", "\n---\n", "\n \t\n", "é", "_",
              "-", "+", " ", " ", " ", ":", "and more", "[x]", "=="]
    texts = [(i, "".join(rng.choice(pieces, 30))) for i in range(3000)] + [(-1, None), (-2, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert compare(secret_scan.scan(docs).toArrow(), con.sql(ORACLE["op6_secret_scan"]).to_arrow_table()) == ""


def test_pages(spark):
    body = "<p>One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen.</p>"
    pages = {
        1: None, 2: "", 3: f"<nav><a href=/>Home</a></nav><article><h1>T &amp;amp; t</h1>{body}<p>Tiny<br>bit</p></article><footer>f</footer>",
        4: f"<div class='top-menu'>Menu</div><div>{body}<p class=ad>Buy<p>Short one.{body}</div><div id=comments>{body}</div>",
        5: "<article>a<!-- c --><script>var x='</article>';</script> b<form>f</form><aside>s</aside></article",
        6: "<article>open &nbsp; text", 7: "<article><p title=\"open>some text</p><p>more</p></article>"}
    rows = spark.createDataFrame([(i, "u", h, 1) for i, h in pages.items()], "page_id long, url string, html string, text int")
    text = body[3:-4]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(rows).collect()}
    assert {i: t for i, (t, _) in got.items()} == {1: "", 2: "", 3: f"T &amp; t {text} Tiny bit", 4: f"{text} Short one. {text}",
                                                  5: "a b", 6: "open text", 7: "some text more"}
    assert all(n == len(t) for t, n in got.values())


def test_names_of_layouts_are_no_asides():
    body = "<p>One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen.</p>"
    tree, text = html_extract.trained(), body[3:-4]
    for page in (f"<body class='has-sidebar'><div>{body}</div>", f"<article class='post has-comments'>{body}</article>",
                 f"<html class=search><body id=header class='single-post right-sidebar'><main class=widget>{body}</main>",
                 f"<div class='layout no-sidebar header-fixed'>{body}</div>"):
        assert html_extract.main_text(page, tree) == text, page
    for name in ("sidebar", "x ad", "site-footer", "top-menu", "share-buttons y", "related_posts", "cookie-consent-banner", "ad-1"):
        assert html_extract.main_text(f"<article>{body}<div class='{name}'>{body}</div></article>", tree) == text, name


def test_silent_elements_without_an_end():
    tree = html_extract.trained()
    cases = {"<svg width=1/>": "", "<svg><title/><path/></svg>": "", "<math/>": "", "<button>": "", "<select><option>": "",
             "<canvas>": "", "<object data=x>": "", "<template>": "", "<video src=x>": "", "<button>Go</button>": "",
             "<object><object>in</object></object>": "", "<noscript><p>in</p></noscript>": "", "<script>x='</div>'</script>": "",
             "<svg><title>Icon</title><text>in</text></svg>": "", "<iframe src=x></iframe>": ""}
    for cut in cases:
        for tail in ("", "<footer><button>x</button><svg></svg><video></video></footer>"):
            page = f"<article><p>before</p>{cut}<p>after</p></article>{tail}"
            assert html_extract.main_text(page, tree) == "before after", page
    assert html_extract.main_text("<article><p>before</p><div><button>say</div><p>after</p></article></button>", tree) == "before say after"
    assert html_extract.main_text("<article>before<script>after</article>", tree) == "before"
    assert html_extract.main_text("<head><title>no end</head><article>text</article>", tree) == "text"
    assert html_extract.main_text("<article>" + "<button><p>x</p><title>" * 20_000, tree) == "x"


def test_short_lines_and_references_stay():
    text = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    body, tree = f"<p>{text}</p>", html_extract.trained()
    links = "<ul>" + "<li><a href=x>Some linked title</a>" * 3 + "</ul>"
    for page, want in {
            f"<p>Short first.</p>{body}<p>Short last.</p>": f"Short first. {text} Short last.",
            f"{body}<p>Who?</p><p>Me.</p><p>You?</p><p>Yes.</p>{body}": f"{text} Who? Me. You? Yes. {text}",
            f"{body}<ul><li>one item<li>two items<li>three</ul>": f"{text} one item two items three",
            f"{links}<p>Links</p>{links}{body}<p>End.</p>{links}": f"{text} End.",
            f"<article>{body}{links}</article>{links}": text + " Some linked title" * 3}.items():
        assert html_extract.main_text(page, tree) == want, page


def test_network_learns_and_reads_whole_texts():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["plain", "prose", "and", "more"], 60)).encode() for _ in range(60)]
    bad = [t + b" ### $$$ ###" * 40 for t in good]
    net = quality_cnn.train([quality_cnn.Sample.of(t) for t in good + bad], np.array([1.0] * 60 + [0.0] * 60))
    score = quality_cnn.scores(net, net.table(), good + bad)
    assert (score[:60] > 0.7).all() and (score[60:] < 0.3).all()
    long = b"plain prose and more " * 20_000
    tail = long + b" ### $$$ ###" * 4000
    assert quality_cnn.scores(net, net.table(), [tail])[0] < quality_cnn.scores(net, net.table(), [long])[0]


def test_long_texts_train_on_whole_chunks():
    """The chunks of a sampled text pool to what the whole text's chunks of the same places pool to."""
    rng = np.random.default_rng(4)
    table_ = rng.normal(size=(quality_cnn.WIDTH, 256, 3)).astype(np.float32)
    for size in (0, 1, 128, 16_000, 16_400, 300_001):
        text = bytes(rng.integers(0, 256, size, np.uint8))
        sample = quality_cnn.Sample.of(text)
        whole, _ = quality_cnn.pool_chunks(quality_cnn.responses(table_, quality_cnn.blocks_of(text)).max(axis=1))
        pooled, _ = quality_cnn.pool_chunks(quality_cnn.responses(table_, sample.blocks).max(axis=1), sample.step)
        places = np.linspace(0, len(whole) - 1, min(len(whole), quality_cnn.SAMPLE_CHUNKS)).astype(int)
        assert len(pooled) == len(places) and (pooled == whole[places]).all()


def test_labels_of_any_kind_of_id(spark):
    """Null labels, labels without documents, repeated ids and ids that are no numbers."""
    docs = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(20)] + [("d1", "text 1"), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2 if i % 5 else None) for i in range(30)] + [("d1", 1), (None, 1)],
                                   "doc_id string, quality int")
    samples, values = quality_cnn.sample(docs, labels)
    trained = {f"d{i}" for i in range(20) if i % 5 and zlib.crc32(f"d{i}".encode()) % 4 != 2}
    assert len(samples) == len(values) == len(trained) + ("d1" in trained)
    assert sum(values) == sum(int(d[1:]) % 2 for d in trained) + ("d1" in trained)
    rows = quality_cnn.classify(docs, quality_cnn.train(samples, values)).collect()
    assert len(rows) == 22 and {r.doc_id for r in rows} == {f"d{i}" for i in range(20)} | {None}


def test_quotes_are_linked_and_removed(spark):
    messages = [
        (1, 0, "user", "What is  a join?\nAnd a shuffle?"), (1, 1, "assistant", "A join matches rows."),
        (1, 2, "user", "On Monday, the assistant wrote:\n> A JOIN matches rows.\n>> what is a join?\nThanks <|end|>"),
        (1, 3, "user", "> And a shuffle?\n> never said\nstill open"), (2, 0, None, "> A join matches rows.\nalone"),
        (None, None, "user", None), (1, 4, "user", ""), (1, 4, "user", "")]
    frame = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, position int")
    rows = quote_threads.threads(frame).collect()
    got = {(r.conv_id, r.position): (r.turn, r.text, r.reply_to, r.n_quoted) for r in rows}
    assert got == {
        (1, 0): (0, "What is  a join?\nAnd a shuffle?", None, 0), (1, 1): (1, "A join matches rows.", None, 0),
        (1, 2): (2, "Thanks <|end|>", 1, 2), (1, 3): (3, "still open", 0, 2), (1, 4): (4, "", None, 0), (1, 5): (4, "", None, 0),
        (2, 0): (0, "alone", None, 1), (None, 0): (None, "", None, 0)}
    assert next(r.formatted for r in rows if r.turn == 2) == "<|user|>\nThanks < |end|>\n<|end|>"
    assert quote_threads.threads(frame.limit(0)).count() == 0


def told_conversations(seed=10, conversations=60, turns=50):
    """Messages (conversation, turn, role, text, original or None): replies that quote, some wrapped anew, in part or nested."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for conv in range(conversations):
        told = []
        for turn in range(turns):
            said = ["Thanks a lot.", "Yes."] if rng.random() < 0.2 else [
                " ".join(rng.choice(words, rng.integers(4, 14))).capitalize() + rng.choice(list(".!?")) for _ in range(rng.integers(1, 6))]
            body, original = [" ".join(said[:3]), "", " ".join(said[3:])] if len(said) > 3 else ["\n".join(said)], None
            own, quote = "\n".join(body), []
            if told and rng.random() < 0.7:
                source = int(rng.integers(len(told)))
                text, sentences = told[source]
                form = rng.integers(5)
                if form == 1:  # wrapped anew
                    text = "\n".join(text.upper().replace("\n", " ").split(" "))
                elif form == 2:  # one sentence, wrapped anew
                    text = sentences[int(rng.integers(len(sentences)))].replace(" ", "\n", 3)
                elif form == 3:  # half a sentence, which nobody said alone
                    text = sentences[0][:-3] + "x"
                quote = [f"> {line}" for line in text.split("\n")]
                if form == 4:  # nested below
                    quote += [f">> {line}" for line in told[int(rng.integers(len(told)))][0].split("\n")]
                original = None if form == 3 else source
                if original is not None:  # who said the same last
                    spoken = sentences if form == 2 else [text]
                    flat = " ".join(" ".join(spoken if form != 2 else [text]).lower().split())
                    original = max(i for i, (t, s) in enumerate(told)
                                   if flat in [" ".join(x.lower().split()) for x in (t, *t.split("\n"), *t.split("\n\n"), *s)])
                quote = ["On Monday " + "somebody " * 40 + "wrote:", *quote]
            told.append((own, said))
            rows.append((conv, turn, "user", "\n".join([*quote, *body]), original))
    return rows


def test_quotes_of_thousands_of_messages(spark):
    rows = told_conversations()
    frame = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    got = quote_threads.threads(frame).toArrow()
    found = {(r["conv_id"], r["turn"]): r["reply_to"] for r in got.to_pylist()}
    assert found == {(c, t): original for c, t, _, _, original in rows}
    assert sum(o is not None for o in found.values()) > 1000
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    assert compare(got, con.sql(ORACLE["op10_quote_threads"]).to_arrow_table()) == ""


def test_a_line_that_a_whole_conversation_repeats(spark):
    """Who said it last is found across the ranges of one crowded unit; ids may be of any type."""
    frame = spark.range(4000).select(
        F.lit("c").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"),
        F.expr("CASE id % 4 WHEN 0 THEN 'Ok.' WHEN 3 THEN 'so' ELSE '> ok.' END").alias("text"))
    rows = quote_threads.threads(frame).collect()
    assert all(r.reply_to == (r.turn - r.turn % 4 if r.turn % 4 in (1, 2) else None) for r in rows) and len(rows) == 4000


def test_one_crowded_conversation_keeps_its_order(spark):
    frame = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.concat(F.lit("m"), "id").alias("text")).repartition(7)
    assert all(r.position == r.turn for r in quote_threads.threads(frame).collect())
