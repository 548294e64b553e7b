"""The registered queries against their SQL, the public library or brute force, over whole small tables."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from check import compare, connect
from rankflow.llm.queries import QUERIES
from rankflow.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toArrow(), con.sql(ORACLE[name]).to_arrow_table()) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op2_is_what_the_library_gives(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op2_bpe_codec"](spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_op7_is_what_the_library_counts(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op7_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest id reachable, by id, over all pairs."""
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = least[b]
                    changed = True
    return least


def test_op3_is_what_all_pairs_give(spark, docs):
    prints = {i: slow_fingerprint(t) for i, t in docs.items()}
    least = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_op6_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    keys = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = re.compile(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = QUERIES["op6_secret_scan"](spark, sf).collect()
    assert sum(r.n_assign for r in rows) > 0
    for r in rows:
        text = docs[r.doc_id]
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(r.spans.split(","))


def test_op8_gives_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extract"](spark, SF).collect():
        blocks = re.split(r"<[^>]+>", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        text = " ".join(filter(None, (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks)))
        assert (r.text, r.n_chars) == (text, len(text))


def test_op9_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_cnn"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, label = map(np.array, zip(*judged))
    good, bad = score[label == 1], score[label == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (good >= 0.7).mean() > 0.9


def slow_line_dedup(texts, min_words=50):
    """Texts by id without the lines of runs that an earlier run equals; None if no line is left."""
    lines = {i: [(j, x) for j, x in enumerate(t.split("\n")) if x.split()] for i, t in sorted(texts.items())}
    seen, gone = set(), {i: set() for i in texts}
    for i, own in lines.items():
        for s in range(len(own)):
            n = 0
            for e in range(s, len(own)):
                n += len(re.findall(r"[^\x20\x09-\x0D]+", own[e][1]))
                if n >= min_words:
                    run = tuple(x for _, x in own[s:e + 1])
                    if run in seen:
                        gone[i].update(j for j, _ in own[s:e + 1])
                    seen.add(run)
                    if e - s > 60:
                        break
    out = {}
    for i, t in texts.items():
        left = [x for j, x in enumerate(t.split("\n")) if j not in gone[i]]
        if not gone[i] or len(gone[i]) < len(lines[i]):
            out[i] = "\n".join(left)
    return out


def test_pipeline_is_what_brute_force_gives(spark, con, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLE['op1_quality_rules']}) WHERE kept").fetchall()}
    texts = slow_line_dedup({i: docs[i] for i in kept})
    least = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    fold = {c: c + 32 for c in range(65, 91)}
    windows = {tuple(w[k:k + 13]) for w in (split(t.translate(fold)) for t in items) for k in range(max(1, len(w) - 12))} - {()}
    left = {}
    for i, t in texts.items():
        words = split(t.translate(fold))
        hit = {p for n in {len(w) for w in windows} for k in range(len(words) - n + 1)
               if tuple(words[k:k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(words):
            left[i] = sha(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)))
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == left
    assert 0 < len(got) < len(docs)
