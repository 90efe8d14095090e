"""Operators 11 to 13 against brute force, on awkward rows and over several cells or slices."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from rushes.llm import conversation_repair, vector_cells
from rushes.llm.conversation_repair import repair, repaired_turns
from rushes.llm.hard_negatives import hard_negatives, merged_upwards
from rushes.llm.pieces import Model
from rushes.llm.queries import damaged
from rushes.llm.repair_grammar import BASE, EMPTY, INSERTIONS, SYMBOLS, Rope, finish, matrices, re_pair, times
from rushes.llm.sentencepiece_fst import default_model
from rushes.llm.topk_search import accumulate, exact_top_k, postings
from rushes.llm.vector_cells import NEVER

# --- vectors --------------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, q long, id long, v string, score long, rank int, _x int, _y int"


def vector_rows(seed=5, n=160, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(0, 1)]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(20)]  # one vector many times
    rows += [(20, rows[20][1], 0), (30, rows[31][1], 1), (30, rows[30][1], rows[30][2])]  # repeated ids and a repeated row
    rows += [(50, None, 1), (51, [0.1, None] + [0.2] * (dims - 2), 1), (52, [math.nan] * dims, 1), (53, [math.inf] * dims, 2)]
    rows += [(54, [], 0), (56, [0.5], 2), (57, [0.5] * (dims + 2), None), (None, [0.5] * dims, 1), (None, None, None)]
    return rows


def whole(rows):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_score(pairs):
    return sorted(pairs, key=lambda p: (-p[1], p[0] is None, p[0] or 0))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x", 3, 4, 5, 6) for i, v, lab in vector_rows()], VECTORS)


@pytest.fixture(params=[False, True])
def cells(request, monkeypatch):
    """Once as it is, once with cells so small that every block meets several others."""
    if request.param:
        monkeypatch.setattr(vector_cells, "QUERY_BYTES", 1)
        monkeypatch.setattr(vector_cells, "CANDIDATE_BYTES", 1)


def asked(rows, every):
    return {(i, tuple(v), lab) for i, v, lab in rows if i is not None and i % every == 0}


def test_top_k_brute(vectors, cells):
    rows = whole(vector_rows())
    want = []
    for i, v in {(i, v) for i, v, _ in asked(rows, 10)}:
        want += [(i, r, c, s) for r, (c, s) in enumerate(by_score([(c, dot(v, w)) for c, w, _ in rows if c != i])[:5], 1)]
    got = [tuple(r) for r in exact_top_k(vectors, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_negatives(rows, every):
    out = []
    for i, v, lab in asked([r for r in rows if r[2] is not None], every):
        others = [(c, dot(v, w), other) for c, w, other in rows if c != i and other is not None]
        for n, (p, s) in enumerate(by_score([(c, x) for c, x, other in others if other == lab])[:5], 1):
            hard = by_score([(c, x) for c, x, other in others if other != lab and 50 * s <= 100 * x <= 95 * s])[:3]
            out += [(i, p, n, r, c, s, x) for r, (c, x) in enumerate(hard, 1)]
    return out


def test_hard_negatives_brute(vectors, cells):
    got = [tuple(r) for r in hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got, key=str) == sorted(brute_negatives(whole(vector_rows()), 10), key=str) and got


def test_vectors_awkward(spark, vectors):
    empty = vectors.where("false")
    assert exact_top_k(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    one = vectors.where("vec_id = 10")
    assert exact_top_k(one, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exact integer score"):
        exact_top_k(large, F.col("vec_id") == 0).collect()


def test_postings_add_up_to_products():
    rng = np.random.default_rng(1)
    c, q = (rng.integers(-9, 9, (n, 12)) * (rng.random((n, 12)) < 0.3) for n in (40, 7))
    c[:, 3] = 5  # a dense list
    scores = np.zeros((7, 40), np.int64)
    accumulate(q, postings(c), scores)
    assert (scores == q @ c.T).all()


def test_slots_merge_upwards():
    scores = np.array([[[5, 4, 3], [9, NEVER, NEVER], [20, 11, 10]]])
    names = np.array([[[1, 2, 3], [4, 0, 0], [5, 6, 7]]])
    s, n = merged_upwards(scores, names)
    assert s[0].tolist() == [[5, 4, 3], [9, 5, 4], [20, 11, 10]] and n[0].tolist() == [[1, 2, 3], [4, 1, 2], [5, 6, 7]]


# --- pieces ---------------------------------------------------------------------------------------------------------------
def test_lattice_holds_the_shortest_path():
    model = Model(open(default_model(), "rb").read())
    for text in ("the thing", "a\nb", "漢字 x", "théâtre"):
        arcs, n = model.lattice(text), len(model.normal(text))
        assert {a[0] for a in arcs} | {n} == set(range(n + 1))
        at = 0
        for piece in (i for i in model.encode(text) if not model.is_byte[i]):
            at = next(e for s, e, p, _ in arcs if p == piece and s >= at)
        assert all(e - s == len(model.texts[p]) for s, e, p, _ in arcs if p >= 0)
        assert all(e - s == 1 for s, e, p, _ in arcs if p < 0)


def test_neighbours_agree_as_the_merges_say():
    model = Model(open(default_model(), "rb").read())
    rng = np.random.default_rng(8)
    ids = np.array(sorted(model.ids.values()))
    left, right = rng.choice(ids, 4000), rng.choice(ids[:3000], 4000)
    got = model.agree(left, right)
    assert got.tolist() == [model._merges_to(int(a), int(b)) for a, b in zip(left, right)] and not got.all()


# --- conversations --------------------------------------------------------------------------------------------------------
BLANK, ENDS = " \t\n\v\f\r", ".!?"
TALK = "conv_id long, turn long, role string, text string, key string, again boolean, n long, slice long, audit string"


def faults(rows):
    """(role, text, fault) in order: turn, then role, then the hash of both."""
    key = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r))):
        last = text.strip(BLANK)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ENDS else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """By trying every edit before and at every row, with a state of the grammar."""

    @lru_cache(None)
    def best(i, state, inserted=0):
        out = [(0, "")] if i == len(rows) and state in "0a" else []
        nxt = {"0": "u", "s": "u", "a": "u", "u": "a"}[state]
        if inserted < 2:
            c, e = best(i, nxt, inserted + 1)
            out.append((c + 5, "I" + e))
        if i < len(rows):
            role, _, fault = rows[i]
            c, e = best(i + 1, state)
            out.append((c + 2, "D" + e))
            if fault not in ("blank", "duplicate"):
                more, first = 5 * (fault == "truncated"), role[:1]
                if first == nxt or first == "s" and state == "0":
                    c, e = best(i + 1, first)
                    out.append((c + more, "K" + e))
                c, e = best(i + 1, nxt)
                out.append((c + more + 1, "R" + e))
        return min(out, default=(10**9, ""))

    return best(0, "0")


def repaired(rows, audit):
    state, i, out = "0", 0, []
    for e in audit:
        nxt = {"0": "u", "s": "u", "a": "u", "u": "a"}[state]
        name = {"u": "user", "a": "assistant"}[nxt]
        if e == "I":
            out.append((name, ""))
        elif e != "D":
            out.append((rows[i][0] if e == "K" else name, rows[i][1]))
        if e != "D":
            state = "s" if e == "K" and state == "0" and rows[i][0][:1] == "s" else nxt
        i += e != "I"
    return out


def expected(rows):
    conv = faults([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest(tuple(conv))
    body = "\n".join(f"{r}:{x}" for r, x in repaired(conv, audit))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(conv))
    count = {f: sum(c[2] == f for c in conv) for f in ("blank", "duplicate", "truncated")}
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (len(conv), gaps, *count.values(), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def conversations():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", " \t", None, "Why?\n", "a. b", "Fine!", "é…", "x" * 3000 + "."]
    rows = []
    for conv in range(60):
        turns = rng.sample(range(12), rng.randint(1, 9)) + [None] * (conv % 7 == 0) + [3] * (conv % 5 == 0)
        rows += [(conv, t, rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choice(texts)) for t in turns]
    rows += rows[:9]  # repeated rows
    rows += [(None, i, "user" if i % 2 else "assistant", f"Line {i}.") for i in range(5)]
    rows += [(100, i, rng.choice(["user", "assistant"]), f"Turn {i % 90}" + rng.choice([".", ""])) for i in range(300)]  # a long one
    return rows + [(101, 1, "user", "Same.")] * 150


@pytest.mark.parametrize("slice_rows", [4096, 7])
def test_repair_brute(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(conversation_repair, "SLICE_ROWS", slice_rows)
    rows = conversations()
    df = spark.createDataFrame([(*r, "k", True, 1, 2, "a") for r in rows], TALK).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair(df).collect()}
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def test_repaired_turns_spell_the_conversation(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (1, 2, "user", " "), (2, 5, "system", "Be kind."), (2, 6, "user", "Go.")]
    df = spark.createDataFrame([(*r, "k", True, 1, 2, "a") for r in rows], TALK)
    out = repaired_turns(df).orderBy("conv_id", "turn", "slice_role", "slice_key", "slice_again", "chunk", "position").collect()
    spelt = {c: [(r.role, r.text) for r in out if r.conv_id == c] for c in (1, 2)}
    for c in (1, 2):
        conv = faults([r[1:] for r in rows if r[0] == c])
        assert spelt[c] == repaired(conv, cheapest(tuple(conv))[1])


def test_repair_awkward(spark):
    none = spark.createDataFrame([], TALK)
    assert repair(none).count() == 0 and repaired_turns(none).count() == 0
    nulls = spark.createDataFrame([(None,) * 9] * 3, TALK)
    assert [tuple(r) for r in repair(nulls).collect()] == [(None, 3, 0, 3, 0, 0, 2, 6, "DDD", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1, None)] + [(None, None, None, None)]
    got = sorted(map(str, damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else said(text).replace(".", "").replace("!", "") if kind == 2 else said(text)
        want += [f"Row(conv_id={c}, turn={t}, role={role!r}, text={text!r})"] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want)


def test_matrices_of_grammar_equal_plain_products():
    rng = random.Random(2)
    sequences = [bytes(rng.randrange(SYMBOLS) for _ in range(rng.randint(1, 30))) for _ in range(40)] + [b"\x01" * 50, b"\x01\x03" * 40]
    rules, short = re_pair(sequences)
    assert rules and sum(map(len, short)) < sum(map(len, sequences))
    of = matrices(sequences)
    for s in sequences:
        m = BASE[s[0]]
        for code in s[1:]:
            m = times(m, BASE[code])
        assert [x and (x[0], str(x[1])) for x in of[s]] == [x and (x[0], str(x[1])) for x in m]


def test_ropes_compare_as_strings():
    rng = random.Random(6)

    def rope(text):
        if len(text) < 5 or rng.random() < 0.1:
            return Rope(text)
        at = rng.randint(1, len(text) - 1)
        return Rope(None, rope(text[:at]), rope(text[at:]))

    texts = ["".join(rng.choice("DK") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    texts += [t + "I" for t in texts[:8]] + [t[:100] + "R" + t[101:] for t in texts[:8]]
    for a, b in itertools.product(texts, texts):
        assert (rope(a) < rope(b)) == (a < b)
    assert str(EMPTY + rope(texts[0])) == texts[0]
    assert finish([(0, EMPTY), None, None, None])[0] == 0 and INSERTIONS[3][0] == 10


# --- quality classifier ---------------------------------------------------------------------------------------------------
def test_a_sample_without_documents_is_an_error(spark):
    from rushes.llm.quality_classifier import classify

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with pytest.raises(RuntimeError, match="training sample"):
        classify(docs, sample=1e-7)
    assert classify(docs, sample=3).count() == docs.count()  # three in two hundred, however it falls


# --- pages ----------------------------------------------------------------------------------------------------------------
def test_pages_of_any_depth_and_inline_noise(spark):
    from rushes.llm.html_wrapper import extract, extract_pages

    assert extract("<article><p>text</p><div class='share-price'>Stock</div><div class='share-bar'>Tweet</div></article>") == "text Stock"
    assert extract("<div class='comment-free'><p>Hello there all.</p></div>") == "Hello there all."
    assert extract("<article><p>a <span class='ad'>BUY <b>now</b></span>b</p><p>c <span class=ad>open</p><p>d</p></article>") == "a b c d"
    deep = "<div>" * 100_000 + "deep text" + "</div>" * 100_000
    rows = [(1, "http://h/1", deep), (2, "http://h/2", "<article><p>plain</p></article>"), (3, "http://h/3", "<p>" + "word " * 4_000_000 + "</p>")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2], len(got[3])) == ("deep text", "plain", 19_999_999)
