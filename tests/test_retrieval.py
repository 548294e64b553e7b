import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.text import STOP_WORDS, tokens
from rankflow.operators import dense, fusion, lexical, queries, ranking, vectors
from rankflow.plans import retrieval
from rankflow.session import scratch_path
from tests.conftest import rows


def brute_bm25(docs, query, k):
    bags = {i: Counter(w for w in t.split() if w not in STOP_WORDS) for i, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    scores = {}
    for i, bag in bags.items():
        s = 0.0
        for w in query.split():
            if w in bag:
                idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                s += idf * bag[w] / (1.5 * (0.25 + 0.75 * sum(bag.values()) / mean) + bag[w])
        if s > 0:
            scores[i] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus():
    """A third of the documents are copies of one text, one word is in every text."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)]
    docs = [(i, "common " + " ".join(rng.choices(words, k=rng.randint(3, 20)))) for i in range(200)]
    docs += [(i, "common w1 w2 w3 w3") for i in range(200, 300)]
    asked = [(q, "common " + " ".join(rng.choices(words, k=6))) for q in range(40)]
    return docs, asked + [(40, "common"), (41, "w3 w3 w1"), (42, "unknown")]


def ranked_lists(index, asked, k, spark):
    terms = queries.query_terms(spark.createDataFrame(asked, "query_id long, text string"))
    got = {}
    for r in lexical.bm25_topk(index, terms, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    return got


def assert_lists(got, docs, asked, k):
    for q, text in asked:
        want = brute_bm25(docs, text, k)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], text
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("items,words,share", [(8192, 1 << 22, 8), (40, 1 << 22, 100), (40, 300, 2)])
def test_bm25_matches_brute_force(spark, corpus, monkeypatch, items, words, share):
    """One block or many, closed by items or by words, with and without thresholds from the best blocks."""
    docs, asked = corpus
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items)
    monkeypatch.setattr(lexical, "BLOCK_WORDS", words)
    monkeypatch.setattr(lexical, "SHARE", share)
    index = lexical.build_index(spark.createDataFrame(docs, "item_id long, text string").repartition(2))
    assert_lists(ranked_lists(index, asked, 25, spark), docs, asked, 25)
    for r in index.blocks.collect():
        assert len(r.item_ids) <= items and sum(r.lens) < words + 21


def zipf_block(n=6000, seed=1):
    """A block of texts with words of very different frequency, and 300 queries of six words."""
    rng = np.random.default_rng(seed)
    words = [rng.zipf(1.3, rng.integers(4, 40)) % 4000 for _ in range(n)]
    code, row = np.concatenate(words), np.repeat(np.arange(n), [len(w) for w in words])
    pairs = np.unique(np.stack([code, row]), axis=1)
    words = [words[i] for i in lexical._alike(pairs[0], pairs[1], np.array([len(w) for w in words]))]
    rows = {}
    for i, text in enumerate(words):
        for w, tf in Counter(text.tolist()).items():
            rows.setdefault(f"w{w:04}", []).append((i, tf))
    terms = sorted(rows)
    sizes = np.array([len(rows[t]) for t in terms])
    place, tf = (np.array([x[j] for t in terms for x in rows[t]]) for j in (0, 1))
    lens = np.array([len(t) for t in words])
    block = lexical.Block(pa.array(np.arange(n)), lens, np.zeros(0, np.int64), pa.array(terms), sizes, place, tf, float(lens.mean()))
    asked = [sorted({f"w{w:04}" for w in rng.zipf(1.3, 6) % 4000}) for _ in range(300)]
    idf = {t: math.log(1 + (n - s + 0.5) / (s + 0.5)) for t, s in zip(terms, sizes)}
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(asked), pa.array([[idf.get(t, 0.0) for t in a] for a in asked]),
                                        pa.array(np.zeros(300))], ["query_id", "terms", "weights", "least"])
    return block, batch, words, idf


def listed(block, batch, k):
    out = {}
    for q, i, s in block.search(batch, k):
        for a, b, c in zip(q.to_pylist(), i.to_pylist(), s.tolist()):
            out.setdefault(a, []).append((b, c))
    return out


def test_bounds_spare_strips(monkeypatch):
    """Most strips that hold a word of their query are passed over, more with a threshold from elsewhere; lists are whole."""
    monkeypatch.setattr(lexical, "WHOLE", 1e9)
    block, batch, words, idf = zipf_block()
    got = listed(block, batch, 10)
    mean = sum(map(len, words)) / len(words)
    for q in range(0, 300, 7):
        scores = np.zeros(len(words))
        for i, text in enumerate(words):
            bag = Counter(f"w{w:04}" for w in text.tolist())
            for t in batch["terms"][q].as_py():
                if t in bag:
                    scores[i] += idf[t] * bag[t] / (1.5 * (0.25 + 0.75 * len(text) / mean) + bag[t])
        steps = np.floor(scores * 1e6 + 0.5)
        want = [i for i in np.lexsort((np.arange(len(words)), -steps)) if scores[i] > 0][:10]
        assert [i for i, _ in got.get(q, [])] == want
    first = block.visited
    assert 0 < first < 0.35 * block.possible
    least = pa.array([got[q][-1][1] if len(got.get(q, [])) == 10 else 0.0 for q in range(300)])
    block.visited = 0
    assert listed(block, batch.set_column(3, "least", least), 10) == got
    assert block.visited < first


@pytest.mark.parametrize("share", [0.0, 1e9])
def test_both_ways_give_the_same_digits(monkeypatch, share):
    """Products and bounds list the same items with the same scores, dead places left out."""
    block, batch, _, _ = zipf_block(900, seed=4)
    block.alive[::7] = False
    monkeypatch.setattr(lexical, "WHOLE", 0.5)
    want = listed(block, batch, 12)
    monkeypatch.setattr(lexical, "WHOLE", share)
    assert listed(block, batch, 12) == want
    assert all(i % 7 for rows in want.values() for i, _ in rows)


def test_whole_scoring_in_pieces(monkeypatch):
    """Rows of a product, postings in pieces and candidates in pieces give the same lists; no array grows with the postings of a batch."""
    block, batch, _, _ = zipf_block(2000, seed=5)
    block.alive[::7] = False
    monkeypatch.setattr(lexical, "WHOLE", 1e9)
    want = listed(block, batch, 12)
    monkeypatch.setattr(lexical, "WHOLE", 0.0)
    spans, longest = lexical._spans, []
    monkeypatch.setattr(lexical, "_spans", lambda starts, lengths: longest.append(int(lengths.sum())) or spans(starts, lengths))
    for dense, rows, piece, work in ((0.0, 10_000, 1 << 16, 1 << 20), (0.01, 8, 2500, 500), (2.0, 8, 2500, 500)):
        for name, value in (("DENSE", dense), ("ROWS", rows), ("PIECE", piece), ("WORK", work)):
            monkeypatch.setattr(lexical, name, value)
        longest.clear()
        assert listed(block, batch, 12) == want
        # rows of a product are bounded by their number
        assert max(longest) <= max(piece, work, min(rows, len(block.df)) * block.n)
    assert max(longest) < 0.1 * sum(block.df[block.terms.index(t).as_py()] for terms in batch["terms"].to_pylist() for t in terms if block.terms.index(t).as_py() >= 0)


def test_reached_is_a_bound_close_to_the_kth():
    scores = np.random.default_rng(2).random((50, 1003)).astype(np.float32)
    for k in (1, 5, 40):
        got, kth = ranking.reached(scores, k), np.sort(scores, axis=1)[:, -k]
        assert (got <= kth).all() and ((scores >= got[:, None]).sum(axis=1) <= 3 * k + 5).all()


def test_vectors_are_not_selected_cell_by_cell(monkeypatch):
    """The k-th product is bounded by maxima of columns; lists are those of all products in doubles, ties by item."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).round(1)
    asked = rng.standard_normal((40, 16)).round(1)
    wide, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **more: wide.append(a.shape[1]) or partition(a, *rest, **more))
    q, i, score = dense.Scorer(x).best(asked, 9)
    steps = np.floor(np.einsum("qd,nd->qn", asked, x) * 1e6 + 0.5)
    want = [np.lexsort((np.arange(3000), -row))[:9].tolist() for row in steps]
    assert [i[q == n].tolist() for n in range(40)] == want and max(wide) <= 16 * 9


def test_copies_are_listed_as_far_as_needed():
    """Of vectors with many items only as many are written out as give k items; equal scores all stay."""
    row, col = np.array([0, 0, 0, 0, 1, 1]), np.array([0, 1, 2, 3, 2, 0])
    score, sizes = np.array([0.9, 0.8, 0.8, 0.1, 0.5, 0.4]), np.array([3, 5, 5, 1])
    got = dense._needed(row, col, score, sizes, 5)
    assert [x.tolist() for x in got] == [[0, 0, 0, 1], [0, 1, 2, 2], [0.9, 0.8, 0.8, 0.5]]
    assert [len(x) for x in dense._needed(row[:0], col[:0], score[:0], sizes, 5)] == [0, 0, 0]


def test_sums_by_key_shuffle_no_vector(spark, monkeypatch):
    """Sums of several passes and blocks of vectors; ids without a vector do not count, and only keys and ids are shuffled."""
    rng = np.random.default_rng(7)
    held = {i: rng.standard_normal(3).tolist() for i in range(50)}
    bought = [(int(k), int(i)) for k, i in zip(rng.integers(0, 40, 900), rng.integers(0, 60, 900))] + [(99, 55), (-1, 3)]
    want = {}
    for k, i in bought:
        if i in held:
            want[k] = np.add(want.get(k, np.zeros(3)), held[i])
    frames = [spark.createDataFrame(bought, "user_id long, vec_id long"), spark.createDataFrame(sorted(held.items()), "vec_id long, vector array<double>")]
    for passed, read in ((1 << 20, 1 << 15), (37, 7), (1, 1)):
        monkeypatch.setattr(vectors, "PASS_ROWS", passed)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(passed, 10_000))
        sums = vectors.sums_by_key(*frames, "user_id", "vec_id", 3)
        got = dict(sums.collect())
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].tolist()) for k in want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = vectors.sums_by_key(*frames, "user_id", "vec_id", 3)
    exchange = [line for line in sums._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(exchange) == 1 and "vector" not in exchange[0]


def test_few_terms_are_named_in_the_filter(spark, corpus):
    docs, _ = corpus
    index = lexical.build_index(spark.createDataFrame(docs, "item_id long, text string"))
    terms = spark.createDataFrame([(1, "w3", 1)], "query_id long, term string, qtf int")
    search = lexical._Search(index, terms.withColumn("weight", F.lit(1.0)), 5, 1.5, 0.75)
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w3)" in search.held._jdf.queryExecution().executedPlan().toString()


def test_a_changed_catalogue_becomes_segments(spark, corpus):
    """Added, changed and deleted items give the lists and totals of an index built anew; so does the compacted index."""
    docs, asked = corpus
    frame = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    path = scratch_path(spark, "segments")
    index = lexical.build_index(frame(docs), path)
    now = dict(docs)
    for round_ in range(2):
        changed = {i: f"common w{round_} w{i % 60} w5" for i in range(round_ * 7, 60, 3)} | {1000 + 50 * round_ + j: f"w{j} w{j + 1} new" for j in range(30)}
        gone = list(range(100 + 40 * round_, 130 + 40 * round_)) + [5, 999_999]
        index = lexical.update_index(index, frame(sorted(changed.items())), frame([(g, "") for g in gone if g not in changed]).select("item_id"))
        now = {i: t for i, t in (now | changed).items() if i not in gone or i in changed}
    for k in (3, 25):
        assert_lists(ranked_lists(index, asked, k, spark), sorted(now.items()), asked, k)
    assert len(index.segments) == 3
    # the whole catalogue, of which some more has changed
    now = {i: t + " w9" if i % 11 == 0 else t for i, t in now.items() if i % 13}
    index = lexical.open_index(frame(sorted(now.items())), path)
    fresh = lexical.build_index(frame(sorted(now.items())))
    same = lexical.open_index(frame(sorted(now.items())), path)
    small = lexical.compact_index(index)
    assert same.version == index.version == small.version - 1 == 4 and len(index.segments) == 4 and len(small.segments) == 1
    for one in (index, small, lexical.load_index(spark, path)):
        assert (one.n_items, one.n_words, one.fingerprint) == (fresh.n_items, fresh.n_words, fresh.fingerprint)
        assert sorted(one.terms.collect()) == sorted(fresh.terms.select("term", "df").collect())
        assert_lists(ranked_lists(one, asked, 10, spark), sorted(now.items()), asked, 10)
    assert small.packed.agg(F.sum("n")).first()[0] == fresh.packed.agg(F.sum("n")).first()[0]
    assert lexical.update_index(small, deleted=frame([(i, "") for i in now]).select("item_id")).n_items == 0


def test_an_empty_index(spark):
    index = lexical.build_index(spark.createDataFrame([], "item_id long, text string"))
    terms = spark.createDataFrame([(1, "w3", 1)], "query_id long, term string, qtf int")
    assert lexical.bm25_topk(index, terms).collect() == []
    index = lexical.update_index(index, spark.createDataFrame([(4, "w3 here"), (5, None)], "item_id long, text string"))
    assert [(r.item_id, r["rank"]) for r in lexical.bm25_topk(index, terms).collect()] == [(4, 1)]


def test_index_is_reused(spark, corpus):
    docs, _ = corpus
    path = scratch_path(spark, "test-index")
    built = lexical.open_index(spark.createDataFrame(docs, "item_id long, text string"), path)
    other = lexical.open_index(spark.createDataFrame(docs, "item_id long, text string"), path)
    assert built.n_items == other.n_items == 300 and built.version == other.version == 1
    assert built.mean_len == other.mean_len


@pytest.mark.parametrize("items_at_once, values", [(8192, 1 << 22), (30, 1 << 22), (64, 50)])
def test_dense_matches_brute_force(spark, monkeypatch, items_at_once, values):
    monkeypatch.setattr(dense, "ITEM_BLOCK", items_at_once)
    monkeypatch.setattr(dense, "BLOCK_VALUES", values)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 4
    items = np.vstack([centers[rng.integers(0, 6, 200)] + rng.normal(size=(200, 8)) * 0.2,
                       np.tile(centers[0], (100, 1)), np.zeros((1, 8))])
    asked = np.vstack([centers + 0.1, rng.normal(size=(30, 8))])
    index = dense.vector_index(spark.createDataFrame(
        [(f"i{n:03}", v.tolist()) for n, v in enumerate(items)], "item_id string, vector array<double>"))
    q = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(asked)], "query_id int, vector array<double>")
    got = {}
    for r in dense.dense_topk(index, q, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    scores = np.floor((asked @ items.T) * 1e6 + 0.5)
    for n in range(len(asked)):
        want = sorted(range(len(items)), key=lambda i: (-scores[n, i], i))[:10]
        assert got[n] == [f"i{i:03}" for i in want]


def test_items_stay_where_they_are(spark):
    """Only the best of each block are shuffled, never vectors."""
    vectors = [(n, [float(n), 1.0]) for n in range(20)]
    index = dense.vector_index(spark.createDataFrame(vectors, "item_id int, vector array<double>"))
    q = spark.createDataFrame(vectors, "query_id int, vector array<double>")
    plan = dense.dense_topk(index, q, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):].split("MapInArrow")[0]
    assert plan.count("Exchange") == 1 and "vector" not in below
    assert dense.dense_topk(index, q.limit(0), 3).count() == 0


def test_query_vectors_pass_by_the_driver(spark, monkeypatch):
    """Many blocks of queries are one pass over the items, and none is collected or broadcast."""
    monkeypatch.setattr(dense, "BLOCK_VALUES", 4)
    vectors = [(n, [float(n), 1.0]) for n in range(20)]
    index = dense.vector_index(spark.createDataFrame(vectors, "item_id int, vector array<double>"))
    q = spark.createDataFrame(vectors, "query_id int, vector array<double>")

    def refuse(*_, **__):
        raise AssertionError("query vectors reach the driver")

    with monkeypatch.context() as held:
        held.setattr(type(q), "toArrow", refuse)
        held.setattr(type(q), "collect", refuse)
        held.setattr(type(spark.sparkContext), "broadcast", refuse)
        out = dense.dense_topk(index, q, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert {(r["query_id"], r["item_id"]) for r in out.filter("rank = 1").collect()} == {(0, 0)} | {(n, 19) for n in range(1, 20)}


def test_only_postings_that_are_asked_for_are_shuffled(spark, monkeypatch):
    """Other terms' postings stay behind, whether terms are few or many."""
    docs = spark.createDataFrame([(n, f"rare{n} filler{n % 3} stuff{n % 5}") for n in range(600)], "item_id long, text string")
    index = lexical.build_index(docs)
    asked = spark.createDataFrame([("q", "rare7", 1), ("r", "rare8", 1)], "query_id string, term string, qtf int")
    for few in (200, 1):
        monkeypatch.setattr(lexical, "FEW_TERMS", few)
        out = lexical.bm25_topk(index, asked, 5)
        assert [(r["query_id"], r["item_id"]) for r in out.orderBy("query_id").collect()] == [("q", 7), ("r", 8)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert ("LeftSemi" in plan) == (few == 1)


def test_codes_spare_products():
    """Few products are computed in doubles, and the lists are those of all; bounds hold for every pair."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) * rng.lognormal(size=(3000, 1))
    x[500:900] = x[0]
    x[900] = 0
    q = np.vstack([rng.normal(size=(60, 32)) * 10.0 ** rng.integers(-9, 9, (60, 1)), np.zeros((1, 32)), x[:3]])
    codes = dense.Codes.of(x)
    unit = q / np.maximum(np.sqrt((q ** 2).sum(1)), 1e-300)[:, None]
    near = unit.astype(np.float32) @ (codes.code * codes.scale[:, None]).astype(np.float32).T
    assert (np.abs(near - unit @ x.T) <= codes.reach).all()
    scorer = dense.Scorer(x)
    row, col, score = scorer.best(q, 10)
    for n in range(len(q)):
        steps = np.floor(np.einsum("j,ij->i", q[n], x) * 1e6 + 0.5)
        want = np.lexsort((np.arange(len(x)), -steps))[:10]
        assert col[row == n].tolist() == want.tolist() or np.allclose(np.sort(score[row == n]), np.sort(steps[want] / 1e6), rtol=1e-9)
    scorer.exact = scorer.pairs = 0
    scorer.best(rng.normal(size=(200, 32)), 10)
    assert scorer.exact < 0.05 * scorer.pairs


def test_saved_codes_give_the_same_lists(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rng.normal(size=(400, 8)))], "item_id int, vector array<double>")
    q = items.withColumnRenamed("item_id", "query_id")
    path = scratch_path(spark, "coded")
    saved = dense.vector_index(items, path)
    assert {"code", "scale", "reach"} < set(saved.items.columns)
    pick = lambda index: sorted(map(tuple, dense.dense_topk(index, q, 7).collect()))
    assert pick(saved) == pick(dense.vector_index(items)) == pick(dense.open_vectors(items, path))


def test_fewer_items_than_asked(spark):
    index = dense.vector_index(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item_id string, vector array<double>"))
    q = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>")
    assert [(r["item_id"], r["rank"]) for r in dense.dense_topk(index, q, 5).orderBy("rank").collect()] == [
        ("b", 1), ("a", 2)]


def ranked(spark, *items):
    return spark.createDataFrame([("q", i, n) for n, i in enumerate(items, 1)],
                                 "query_id string, item_id string, rank int")


def order(df):
    return [r["item_id"] for r in df.orderBy("rank").collect()]


def test_rrf_ties_keep_first_seen(spark):
    a, b = ranked(spark, "x", "y"), ranked(spark, "y", "x")
    assert order(fusion.rrf([a, b])) == ["x", "y"]
    assert order(fusion.rrf([b, a])) == ["y", "x"]
    assert order(fusion.rrf([ranked(spark, "x"), ranked(spark, "z", "y")])) == ["x", "z", "y"]
    assert order(fusion.rrf([a, b], [0.2, 0.8])) == ["y", "x"]


def test_rrf_scores_and_empty_list(spark):
    a, b = ranked(spark, "x", "y"), ranked(spark, "y", "z")
    scores = {r["item_id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert scores["y"] == pytest.approx(1 / 62 + 1 / 61)
    assert order(fusion.rrf([a, b])) == order(fusion.rrf([a, b, a.limit(0)]))
    assert order(fusion.rrf([a, b], [1.0, 0.0])) == ["x", "y"]
    with pytest.raises(ValueError):
        fusion.rrf([a], [0.0])


def test_rrf_shuffles_lists_once(spark):
    fused = fusion.rrf([ranked(spark, "x", "y"), ranked(spark, "y", "z")], topk=2)
    assert fused._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_unknown_kind():
    with pytest.raises(ValueError):
        retrieval.retrieve("nearest", retrieval.Indexes(), retrieval.Queries())


def test_dedupe_closes_gaps(spark):
    assert [(r["item_id"], r["rank"]) for r in ranking.dedupe(ranked(spark, "a", "b", "a", "c")).orderBy("rank").collect()] == [
        ("a", 1), ("b", 2), ("c", 3)]


def test_term_counts_shuffle_no_pairs(spark, monkeypatch):
    """Counts of pieces are added up; ids with several rows count once, rows without an id not at all."""
    monkeypatch.setattr(lexical, "PIECE_BYTES", 16)
    items = spark.createDataFrame([(1, "The Red red, a Café x"), (2, "red-52_b"), (2, "RED \u4e2d\u6587"), (2, "blue"), (None, "red blue"), (3, None), (4, " ")],
                                  "item_id long, text string")
    got = lexical.term_counts(items)
    single = lexical.term_counts(items.where("item_id <> 2"))._jdf.queryExecution().executedPlan().toString()
    assert single.count("Exchange hashpartitioning") == 1
    plain = items.select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))
    assert rows(got) == rows(plain) and ("red", 5, 2) in rows(got)


def test_dedupe_shuffles_lists_once(spark):
    plan = ranking.dedupe(ranked(spark, "a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_topk_is_cut_below_the_exchange(spark):
    scored = spark.range(10).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("item_id"), F.lit(1.0).alias("score"))
    plan = ranking.top_k(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_copies_share_a_place(spark, monkeypatch):
    """Items with one text are scored once and equal queries asked once; lists name every item, also after changes."""
    monkeypatch.setattr(lexical, "FEW_ITEMS", 8)
    monkeypatch.setattr(lexical, "CROWD", 50)
    monkeypatch.setattr(lexical, "SPREAD", 2)
    frame = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    texts = ["steel ring", "brass nut ring", "old steel bolt ring", "small nut"]
    now = {i: texts[0] if i % 2 else texts[i // 2 % 4] for i in range(240)}
    asked = [(q, ("ring steel", "nut", "old ring")[q % 3]) for q in range(60)]
    index = lexical.build_index(frame(sorted(now.items())))
    assert index.blocks.select(F.sum(F.size("item_ids"))).first()[0] <= 5 and index.n_items == 240
    searches, ask = [], lexical._Search._ask
    monkeypatch.setattr(lexical._Search, "_ask", lambda self, rows, *a: searches.append(rows.count()) or ask(self, rows, *a))
    assert_lists(ranked_lists(index, asked, 9, spark), sorted(now.items()), asked, 9)
    assert searches == [3]
    gone, changed = range(0, 100, 3), {i: "small nut" for i in range(1, 60, 4)}
    index = lexical.update_index(index, frame(sorted(changed.items())), frame([(i, "") for i in gone if i not in changed]).select("item_id"))
    now = {i: t for i, t in (now | changed).items() if i not in gone or i in changed}
    for one in (index, lexical.compact_index(index)):
        assert one.n_items == len(now)
        assert dict(one.terms.select("term", "df").collect()) == dict(Counter(w for t in now.values() for w in set(t.split())))
        assert_lists(ranked_lists(one, asked, 9, spark), sorted(now.items()), asked, 9)


def test_rounds_hand_on_little(spark, monkeypatch):
    """With many blocks, far fewer candidates than a whole list of each block are shuffled."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"w{n}" for n in range(40)], k=12))) for i in range(1600)]
    asked = [(q, " ".join(rng.choices([f"w{n}" for n in range(40)], k=8))) for q in range(20)]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 25)
    index = lexical.build_index(spark.createDataFrame(docs, "item_id long, text string").coalesce(1))
    assert index.n_blocks >= 64
    handed, cut = [], lexical.top_k
    monkeypatch.setattr(lexical, "top_k", lambda rows, k: handed.append(rows.count()) or cut(rows, k))
    assert_lists(ranked_lists(index, asked, 10, spark), docs, asked, 10)
    assert len(handed) > 1 and sum(handed) < 20 * 10 * index.n_blocks / 2


@pytest.mark.parametrize("saved", [False, True])
def test_equal_vectors_are_scored_once(spark, monkeypatch, saved):
    """Of items with one vector, the vector is scored once and the first items by id are listed."""
    monkeypatch.setattr(dense, "ITEM_BLOCK", 20)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(30, 4))
    items = [(f"i{n:03}", vectors[0 if n % 3 else n % 30].tolist()) for n in range(300)]
    frame = spark.createDataFrame(items, "item_id string, vector array<double>")
    index = dense.vector_index(frame, scratch_path(spark, "copies") if saved else None)
    asked = rng.normal(size=(25, 4))
    scored, unlike = [], dense._unlike
    monkeypatch.setattr(dense, "_unlike", lambda *a: scored.append(unlike(*a)) or scored[-1])
    got = {}
    for r in dense.dense_topk(index, spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)], "query_id int, vector array<double>"),
                              7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert scored[0].select("vector").distinct().count() == len({tuple(v) for _, v in items}) == scored[0].where("bucket = 0").count()
    steps = np.floor(asked @ np.array([v for _, v in items]).T * 1e6 + 0.5)
    for q in range(25):
        assert got[q] == [items[i][0] for i in np.lexsort((np.arange(300), -steps[q]))[:7]]


def test_words_are_counted_in_pieces(spark, monkeypatch):
    """Postings of a large batch are made from few words at a time, and are all there."""
    lists = [["a", "b", "a"], [], ["c"] * 5, ["b"], ["d", "e"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists)], ["words"])
    cut = list(lexical._pieces(iter([batch]), 4))
    assert [x for b in cut for x in b["words"].to_pylist()] == lists and [b.num_rows for b in cut] == [3, 2]
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w1") for i in range(90)], "item_id long, text string").coalesce(1)
    want = sorted(map(tuple, lexical.postings(docs).collect()))
    monkeypatch.setattr(lexical, "PIECE_WORDS", 10)
    assert sorted(map(tuple, lexical.postings(docs).collect())) == want


def test_rows_that_travel_together_hold_no_null_lists(spark):
    """A run of null lists is gone over again at every row that is written to Arrow, so their time grew as the square of a batch."""
    types = {"term": T.StringType(), "places": T.ArrayType(T.IntegerType()), "item_ids": T.ArrayType(T.StringType())}
    rows = spark.createDataFrame([(1, "a", [0, 2])], "block long, term string, places array<int>")
    row = lexical._padded(rows, ["block"], 1, types).first()
    assert (row.block, row.kind, row.term, row.places, row.item_ids) == (1, 1, "a", [0, 2], [])
    whole = spark.createDataFrame([(1, ["x"])], "block long, item_ids array<string>")
    row = lexical._padded(whole, ["block"], 0, types).first()
    assert (row.kind, row.term, row.places, row.item_ids) == (0, None, [], ["x"])


def test_ranges_of_postings_grow_with_the_postings(spark, monkeypatch):
    """A sort stays as small, however many postings there are and however few partitions the session's shuffles have."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(9))) for i in range(60)], "item_id long, text string")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(lexical, "table_bytes", lambda df: 5 * usual * lexical.SORT_BYTES)
    index = lexical.build_index(docs)
    assert len(index.packed.inputFiles()) > usual
    assert index.terms.where("df > 0").count() == 60 * 7 + 2
