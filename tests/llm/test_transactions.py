"""Conversation repair, whitening and WARC transactions against brute force, by hand and at their edges."""

import base64
import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest

from rankflow.llm import turn_repair, warc, whitening
from rankflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, ROW long, chunk string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")

# -- repair ------------------------------------------------------------------------


def slow_damage(rows):
    """Rows (conv, turn, role, text) after the damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def slow_repair(rows):
    """Cost, audit and lines of the best of all edit strings, by forward search over whole strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    # the roles so far matter only by the last initial and whether there is any
    best = {"": (0, "", ())}

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def may(last, initial):
        return initial == "s" and last == "" or initial == "u" and last != "u" or initial == "a" and last == "u"

    def grow(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if may(last, role[0]):
                        put(best, role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return best

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for last, (cost, audit, lines) in grow(best).items():
            put(after, last, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 * (fault == "truncated")
            if may(last, role[:1]):
                put(after, role[0], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if may(last, other[0]):
                    put(after, other[0], (cost + 1 + late, audit + "R", (*lines, f"{other}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in grow(best).items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip([r[1][:1] for r in rows], [r[1][:1] for r in rows][1:])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TALK)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op11_is_what_brute_force_gives(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: slow_repair(own) for conv, own in slow_damage(rows).items()}
    assert told(QUERIES["op11_turn_repair"](spark, sf)) == want


def odd_rows(n, seed):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "unknown", "User"]
    texts = ["Yes.", "no", "", " \t", None, "why?", "x" * 50, "é!", "Yes.\n\n"]
    pick = lambda of: of[rng.integers(len(of))]
    turn = lambda: None if rng.random() < 0.1 else int(rng.integers(-3, 40))
    return [(None if rng.random() < 0.05 else int(rng.integers(n // 7)), turn(), pick(roles), pick(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_of_odd_conversations(spark, seed):
    rows = odd_rows(900, seed)
    want = {conv: slow_repair(own) for conv, own in slow_damage(rows).items()}
    assert told(turn_repair.damage_and_repair(talk(spark, rows))) == want


def test_a_crowded_conversation_is_repaired_in_chunks(spark):
    """A conversation that holds most rows, over many chunks and tasks, is what one pass over it gives."""
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = [(7, t, roles[rng.integers(6)] if t % 90 > 30 else "user", f"text {rng.integers(300)}{'.?  '[rng.integers(4)]}") for t in range(1500)]
    rows += [(c, t, roles[t % 2], f"{t}.") for c in (1, 8, 9) for t in range(5)]
    frame = talk(spark, rows)
    pieces = turn_repair.divided(turn_repair.damaged(frame), chunk_rows=16)
    crowded = pieces.where("chunk.conv_id = 7")
    assert crowded.count() > 60
    assert max(len(r.chunk.roles) for r in crowded.collect()) <= 16
    got = told(turn_repair.repair(turn_repair.damaged(frame), chunk_rows=16))
    assert got == {c: slow_repair(own) for c, own in slow_damage(rows).items()}


def test_runs_are_passed_by_powers():
    rng = np.random.default_rng(0)
    for _ in range(200):
        symbols = bytes(np.repeat(rng.integers(0, 12, 6), rng.integers(1, 40, 6)).tolist())
        h = turn_repair.FINAL
        for s in reversed(symbols):
            h = turn_repair._best(turn_repair.power(s, 0), h)
        assert turn_repair.back(symbols, turn_repair.FINAL) == h
        assert turn_repair._best(turn_repair.total(symbols), turn_repair.FINAL) == h


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = told(turn_repair.damage_and_repair(talk(spark, [(gone, 0, "user", "a.")])))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turn_repair.damage_and_repair(talk(spark, [])).collect() == []


# -- whitening ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, id string, vector long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x", 6) for i, v in rows], VECTORS)


def expect_whitened(rows, vecs, k=8):
    """Check result rows against a dense eigen-decomposition of the same whole numbers."""
    ids = sorted(vecs)
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in vecs[i]] for i in ids])
    n, total = len(x), [sum(map(int, col)) for col in x.T]
    v = np.cov((x - np.array(total) / n).T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = (x - np.array(total) / n) @ (u / np.sqrt(e))
    got = np.full((n, len(e)), np.nan)
    place = {i: a for a, i in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(c) - t) ** 2 for c, t in zip(x[place[r.vec_id]], total))
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-10 and r.identity_error < 1e-9
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    assert np.abs(np.sign(got * want).sum(0)).min() > 0.99 * n


def test_op12_is_what_a_dense_solver_gives(spark):
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    expect_whitened(QUERIES["op12_whitening"](spark, SF).collect(), vecs)


def test_rows_that_do_not_count_are_left_out(spark):
    rng = np.random.default_rng(0)
    good = {i: np.float32(rng.normal(size=5) * np.arange(1, 6)).tolist() for i in range(40)}
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (95, [1.0, 2.0]), (96, [3e38, 0.0, 0.0, 0.0, 0.0])]
    expect_whitened(whitening.whiten(vectors(spark, [*good.items(), *bad])).collect(), good)
    assert whitening.whiten(vectors(spark, bad[:5])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_components_without_variance_have_no_rows(spark):
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    rows = whitening.whiten(vectors(spark, [(i % 7, [float(i % 2), 2.0, float(i % 2)]) for i in range(10)])).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 10


def test_triangles_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    rng = np.random.default_rng(1)
    vecs = {i: np.float32(rng.normal(size=12) + 3).tolist() for i in range(300)}
    expect_whitened(whitening.whiten(vectors(spark, list(vecs.items())).repartition(9)).collect(), vecs)


@pytest.mark.parametrize("seed", range(12))
def test_the_solver_on_hard_matrices(seed):
    rng = np.random.default_rng(seed)
    d, n = int(rng.integers(1, 40)), int(rng.integers(1, 120))
    x = rng.integers(-300, 300, (n, d))
    if seed % 3 == 0:  # many equal eigenvalues
        x, n = np.vstack([50 * np.eye(d, dtype=np.int64), -50 * np.eye(d, dtype=np.int64)]), 2 * d
    elif seed % 3 == 1:  # eigenvalues of very different size
        x = np.floor(x * 4.0 ** rng.integers(-6, 6, d)).astype(np.int64)
    of = whitening.Sums(n, d, tuple(int(s) for s in x.sum(0)))
    r = np.vstack([np.linalg.qr(of.centred(x), mode="r"), np.zeros((d, d))])[:d]
    diagonal, above, v = whitening.bidiagonal(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(whitening.singular_values(diagonal, above) - want).max() <= 1e-13 * max(want[0], 1e-300)
    model = whitening.solve(r, of)
    w = model.apply(x)
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max(initial=0) < 1e-9


def test_deviations_are_exact():
    of = whitening.Sums(10 ** 6, 2, (3, 2 * 10 ** 9))
    for row in ([1, 2], [900, 7], [5, 100]):
        assert whitening._deviation(np.array([row]), of) == [sum((10 ** 6 * a - b) ** 2 for a, b in zip(row, of.total))]
    assert whitening._deviation(np.array([[10 ** 9, 1]]), of) == [None]


# -- WARC --------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, id string, key int, digest string, revisits int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], PAGES)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_pages_come_back_from_their_archives(spark, tmp_path):
    rows = [(3, "http://a/x?y=1", "same"), (2, "http://b/", "same"), (1, None, None), (4, "http://c\r\nX: y", ""), (5, "http://[", "<é>\r\n\r\n"),
            (6, "u", "z" * 300_000), (None, "v", "same"), (7, "w", "own"), (7, "w", "own"), (7, "a", "own"), (None, "q", "q")]
    path = str(tmp_path / "archives")
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                           for r in warc.round_trip(pages(spark, rows), path).collect())))
    first = {"same": 2, "": 1, "own": 7}
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        head = first.get(html or "", i) == i and not (i == 7 and any(w[0] == 7 for w in want))
        want.append((i, len(b), digest(b), "response" if head else "revisit", None if head else first[html or ""]))
    assert got == sorted(map(str, want))
    archives = warc.listed(spark, f"{path}/*.warc.gz")
    back = warc.records(archives, payloads=True).collect()
    assert len(back) == 3 * len(rows)
    assert len({r.record_id for r in back}) == len(back)
    kept = sorted(bytes(r.payload) for r in back if r.kind == "response")
    assert kept == sorted({(h or "").encode() for _, _, h in rows})
    # of the equal pages 7 the smaller url is the response
    assert {r.target_uri for r in back if r.kind == "response" and bytes(r.payload) == b"own"} == {"a"}
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_short_payloads_are_responses(spark):
    got = {(r.page_id, r.record_type) for r in warc.round_trip(pages(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "long"), (4, "d", "long")]),
                                                               min_bytes=2).collect()}
    assert got == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_many_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 50}" * 20) for i in range(300)]
    made = warc.write(pages(spark, rows), str(tmp_path / "w"), archive_bytes=2000)
    assert made.count() > 20
    nested = warc.captures(warc.records(made).cache())
    assert nested.count() == 300 and nested.where("n_records = 3 AND request IS NOT NULL AND metadata IS NOT NULL").count() == 300
    assert sum(r.record_type == "revisit" and r.refers_to == r.page_id % 50 for r in warc.pages_of(nested, "long").collect()) == 250


FOREIGN = [
    # the response names the request; the metadata names the request too
    ("response", "r1", ["q1"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), ("request", "q1", [], b"GET / HTTP/1.1\r\n\r\n"),
    ("metadata", "m1", ["q1"], b"pageId: 1\r\nhop: L\r\n"),
    # both name the response, one of them twice; a second request of the same capture
    ("request", "q2", ["r2", "r2"], b"GET"), ("response", "r2", [], b"HTTP/1.0 404\r\n\r\n"), ("request", "q0", ["r2"], b""),
    # no response, no capture, an unknown type
    ("metadata", "m3", ["gone"], b""), ("warcinfo", "i", [], b"software: x\r\n"), ("response", "r4", ["r4"], b""),
]


def foreign(kind, name, to, block):
    content = "application/warc-fields" if kind in ("metadata", "warcinfo") else "application/http"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", *[f"WARC-Concurrent-To: <urn:uuid:{t}>" for t in to],
             f"Content-Type: {content}", "X-Long: a", "  b", f"content-length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_other_writers(spark, tmp_path, packed):
    raw = [foreign(*r) for r in FOREIGN]
    name = tmp_path / ("x.warc.gz" if packed else "x.warc")
    name.write_bytes(b"".join(map(gzip.compress, raw)) if packed else b"".join(raw))
    rows = warc.records(warc.listed(spark, str(name))).cache()
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_records) for r in warc.captures(rows).collect()}
    assert got == {"r1": ("q1", "m1", 3), "r2": ("q0", None, 3), "r4": (None, None, 1)}
    one = next(r for r in rows.collect() if r.record_id == "r1")
    assert (one.n_bytes, one.digest, one.fields["a"]) == (4, digest(b"body"), "b")
    rows.unpersist()
    name.write_bytes(name.read_bytes()[:-9])
    with pytest.raises(Exception, match="EOFError|breaks off|end-of-stream"):
        warc.records(warc.listed(spark, str(name))).collect()
