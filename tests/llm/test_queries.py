"""The registered pipeline queries against brute force on the smallest tables, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rushes.llm import context_tree
from rushes.llm.common import components
from rushes.llm.context_tree import score_texts
from rushes.llm.decontaminate import decontaminate, drop_contaminated
from rushes.llm.html_wrapper import extract, extract_pages
from rushes.llm.line_dedup import drop_repeated_lines, line_dedup
from rushes.llm.near_dedup import drop_near_duplicates, near_duplicates
from rushes.llm.pieces import Model
from rushes.llm.quality_classifier import classify, posteriors
from rushes.llm.quality_rules import quality_rules
from rushes.llm.queries import QUERIES
from rushes.llm.sentencepiece_fst import decode, default_model, encode
from rushes.llm.substring_dedup import cut_words, remove_passages, repeated_passages
from rushes.llm.token_files import access, pack, read_at, token_documents, unpack, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, band long, slot long, n long, no int, component string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One short text."), (4, "One short text."), (4, "Another text under the same id."), (None, "No id here at all."),
    (5, LONG), (6, LONG), (7, "é" * 3000), (8, "a\nb\n\nb\n" * 50), (9, "\n".join(["The same long line stands here, twenty times over."] * 20)),
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, "x") for i, t in ROWS], AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], AWKWARD)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, fp long, words string")


# --- 1 quality classifier -----------------------------------------------------------------------------------------------
def test_em_tells_classes_apart():
    good = sum(2 * 3**k for k in range(10))
    bad = good - 3**0 - 3**8
    p = posteriors({good: 900, bad: 100, 0: 5})
    assert p[good] > 0.9 and p[bad] < 0.1
    assert posteriors({}) == {}


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    for quality in (0, 1):
        own = [r.kept == bool(quality) for r in got if r.quality == quality]
        assert sum(own) >= 0.95 * len(own)


def test_classifier_awkward(awkward, empty):
    assert classify(awkward).count() == len(ROWS)
    assert classify(empty).count() == 0


# --- 2 pieces -----------------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=default_model())
    model = Model(open(default_model(), "rb").read())
    rng = np.random.default_rng(3)
    chars = list("abcdef  \n\t.,'▁éß漢😀<0x0A>ABC123\x00")
    odd = ["".join(rng.choice(chars, rng.integers(0, 80))) for _ in range(500)] + ["", "▁▁x", "  ", "x" * 200]
    for t in [*list(texts.values())[:60], *odd]:
        assert model.encode(t) == sp.encode(t)


def test_unigram_takes_the_cheapest_path():
    def field(n, v):
        return bytes([n << 3 | 2, len(v)]) + v

    piece = lambda t, s, k=1: field(1, field(1, t.encode()) + bytes([2 << 3 | 5]) + np.float32(s).tobytes() + bytes([3 << 3, k]))
    data = piece("<unk>", 0, 2) + piece("a", -1) + piece("b", -1) + piece("ab", -1.5) + piece("ba", -0.2) + piece("▁", -1)
    data += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 0, 4 << 3, 0]))
    model = Model(data)
    assert [model.texts[i] for i in model.encode("aba")] == ["a", "ba"]
    assert [model.texts[i] for i in model.encode("ab")] == ["ab"]


def test_encode_round_trip(awkward, empty):
    made = encode(awkward)
    back = decode(made)
    want = collections.Counter((i, t or "") for i, t in ROWS)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == want
    assert all(r.exact for r in made.collect())
    assert encode(empty).count() == 0


# --- 3 decontamination --------------------------------------------------------------------------------------------------
def brute_hits(text, items, n=10):
    ws, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        b = WORD.findall(lower(t))
        if not b:
            continue
        m = min(n, len(b))
        windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)}
        for i in range(len(ws) - m + 1):
            if tuple(ws[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontaminate_brute(spark, awkward, empty):
    items = [(1, "under the same"), (2, " ".join(LONG.split()[500:512])), (3, None), (4, ""), (5, "under the same"), (6, "The same long line stands here, twenty times over. The same long")]
    bench = items_of(spark, [(i, t, 0, "") for i, t in items])
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(awkward, bench).collect())
    assert got == collections.Counter((i, *brute_hits(t, items)) for i, t in ROWS)
    assert decontaminate(empty, bench).count() == 0
    none = decontaminate(awkward, items_of(spark, [])).collect()
    assert len(none) == len(ROWS) and not any(r.contaminated for r in none)
    assert drop_contaminated(awkward, bench).columns == awkward.columns


# --- 4 pages ------------------------------------------------------------------------------------------------------------
def test_extract_parts():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Head</header><nav><ul><li>x</ul></nav><article><h1>A &amp; B</h1>"
        "<p>One <b>bo</b>ld<br>two<p>Three&nbsp;four<aside>no</aside><div class='cookie-notice'>no</div><form>no</form><!-- no --></article>"
        "<section id=comments>no</section><footer>no</footer></body>"
    )
    assert extract(page) == "A & B One bold two Three four"
    assert [extract(x) for x in ("", "<", "<p", "plain &lt; text")] == ["", "<", "", "plain < text"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    own = {r.page_id: re.search(r"<article>(.*?)</article>", r.html, re.S)[1] for r in pages.collect()}
    import html

    for r in extract_pages(pages).collect():
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", own[r.page_id]))).split())
        assert r.n_chars == len(r.text)


def test_pages_awkward(spark):
    rows = [(1, "http://a.com/1", None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "nonsense", "<div><p>" * 300 + "deep"), (4, "http://A.com:80/", "<main><p>hi</main>")]
    pages = spark.createDataFrame([(*r, "h", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = collections.Counter((r.page_id, r.text) for r in extract_pages(pages).collect())
    assert got == collections.Counter([(1, ""), (2, "x"), (2, "x"), (3, "deep"), (4, "hi")])
    assert extract_pages(pages.limit(0)).count() == 0


# --- 5 quality rules ----------------------------------------------------------------------------------------------------
def test_rules_brute(awkward, empty):
    def facts(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(zip(ws, ws[1:], ws[2:]))
        rep = {p for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for p in range(i, i + 3)}
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(ws) < 50 or 100 * len(rep) > 50 * len(ws)

    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(awkward).collect()
    )
    assert got == collections.Counter((i, *facts(t)) for i, t in ROWS)
    assert quality_rules(empty).count() == 0


def test_rules_keep_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in got)


# --- 6 passages ---------------------------------------------------------------------------------------------------------
def test_passages_are_found_and_cut(spark, texts):
    rng, made = np.random.default_rng(5), []
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.08 else "") for _ in range(n))
    shared = [prose(60) + "." for _ in range(10)]
    for i in range(40):
        ws = prose(200).split()
        if i < 20:
            ws[90:90] = shared[i % 10].split()
        made.append((i, " ".join(ws)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = repeated_passages(frame).collect()
    assert {r.doc_id for r in got} <= set(range(10, 20)) and len(got) >= 9
    for r in got:
        assert r.of_doc_ids == [r.doc_id - 10] and r.n_words >= 50
    cleaned = {r.doc_id: r.text for r in remove_passages(frame).collect()}
    assert all(len(cleaned[r.doc_id].split()) == 260 - r.n_words for r in got)
    assert cut_words("a b c d", [(1, 2)]) == "a d"


@pytest.mark.parametrize("ends", [". ", "\n"])
def test_passages_of_short_sentences_or_lines(spark, ends):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))

    def units(least):
        out = []
        while sum(map(len, out)) < least:
            out.append([word() for _ in range(rng.integers(2, 8))])
        return out

    shared, rows = [units(51) for _ in range(40)], []
    for i in range(80):
        us = units(300)
        at = int(rng.integers(5, len(us) - 5))
        rows.append((i, ends.join(" ".join(u) for u in [*us[:at], *shared[i % 40], *us[at:]])))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.of_doc_ids == [r.doc_id - 40] for r in got) and len({r.doc_id for r in got}) >= 36


def test_pieces_do_not_depend_on_the_neighbour_in_the_batch():
    import pyarrow as pa

    from rushes.llm.substring_dedup import paragraphs
    from rushes.llm.words import NONBLANK, words

    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, rng.integers(1, 90))) for _ in range(60)]
    sizes = lambda ts: [int(x) for w in words(pa.array(ts), NONBLANK) for x in np.subtract(*paragraphs(w)[::-1]) + 1]
    assert sizes(texts) == [x for t in texts for x in sizes([t])]


def test_passages_awkward(awkward, empty):
    got = {(r.doc_id, *r.of_doc_ids) for r in repeated_passages(awkward).collect()}
    assert (6, 5) in {x[:2] for x in got} and {x[0] for x in got} <= {5, 6, 8, 9}
    assert repeated_passages(empty).count() == 0
    assert remove_passages(awkward).count() == len(ROWS)


# --- 7 near duplicates --------------------------------------------------------------------------------------------------
def test_near_duplicates_brute(docs, texts):
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))) if ws else frozenset()
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            j = both / max(len(sets[a] | sets[b]), 1)
            if j >= 0.85 or texts[a] == texts[b]:
                assert got[a].class_id == got[b].class_id
    by = collections.defaultdict(list)
    for i, r in got.items():
        by[r.class_id].append(i)
        assert r.kept == (i == r.class_id)
    assert all(len(v) == got[v[0]].class_size and min(v) == k for k, v in by.items())


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base, rows = [f"word{i}" for i in range(150)], []
    for i in range(300):
        ws = list(base)
        for j in rng.choice(150, rng.integers(0, 12), replace=False):
            ws[j] = f"new{rng.integers(1 << 40)}"
        rows.append((i, " ".join(ws)))
    sets = [frozenset(zip(*(t.split()[j:] for j in range(5)))) for _, t in rows]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a in range(300):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.84 * len(sets[a] | sets[b]):
                assert got[a] == got[b]


def test_links_from_the_threshold_on(spark):
    rng, rows = np.random.default_rng(12), []
    for i in range(150):
        ws = [f"w{x}" for x in (rng.random(150) ** 3 * 3000).astype(int)]
        other = list(ws)
        for j in rng.choice(150, rng.integers(1, 6), replace=False):
            other[j] = f"n{rng.integers(1 << 40)}"
        rows += [(i, " ".join(ws)), (i + 150, " ".join(other))]
    df = collections.Counter(x for _, t in rows for x in set(t.split()))
    idf = {x: 8 + math.log((1 + len(rows)) / (1 + n)) for x, n in df.items()}

    def weights(t):
        ws = t.split()
        return {g: n * sum(idf[x] for x in g) / 5 for g, n in collections.Counter(zip(*(ws[j:] for j in range(5)))).items()}

    sets = {i: weights(t) for i, t in rows}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = 0
    for i in range(150):
        a, b = sets[i], sets[i + 150]
        j = sum(min(a.get(g, 0), b.get(g, 0)) for g in a | b) / sum(max(a.get(g, 0), b.get(g, 0)) for g in a | b)
        near += 0.8 <= j < 0.85
        assert got[i] == i
        if abs(j - 0.8) > 1e-4:  # words that share a slot count together in the operator
            assert got[i + 150] == (i if j >= 0.8 else i + 150)
    assert near >= 10


def test_near_awkward(awkward, empty):
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_duplicates(awkward).collect()}
    assert {(5, 5, 2), (6, 5, 2), (1, 1, 2), (2, 1, 2), (4, 4, 2), (None, None, 1)} <= got
    assert near_duplicates(empty).count() == 0
    rest = drop_near_duplicates(awkward)
    assert rest.columns == awkward.columns
    assert collections.Counter(r.doc_id for r in rest.collect()) == collections.Counter([1, 3, 4, 4, None, 5, 7, 8, 9])


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 lines ------------------------------------------------------------------------------------------------------------
def brute_lines(rows, least=40):
    seen, out = set(), []
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(full)):
            held, b = 0, a
            while b < len(full) and held < least:
                held += len(lines[full[b]])
                b += 1
            if held < least:
                break
            window = tuple(lines[k] for k in full[a:b])
            if window in seen:
                gone.update(range(full[a], full[b - 1] + 1))
            seen.add(window)
        out.append((i, len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_brute(spark, docs, texts):
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup(docs).collect())
    assert got == brute_lines(sorted(texts.items()))
    rows = [(1, "a b\nc d\n" * 40), (2, "c d\n\na b\n" * 40), (3, "x\n" * 200)]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_lines(rows)


def test_line_dedup_awkward(awkward, empty):
    got = collections.defaultdict(list)
    for r in line_dedup(awkward).collect():
        got[r.doc_id].append(r)
    assert got[1][0].text is None and got[2][0].text == "" and got[6][0].text == "" and got[5][0].text == LONG
    assert got[9][0].n_removed == 19 and {r.n_removed for r in got[4]} == {0}
    assert line_dedup(empty).count() == 0
    assert 6 not in {r.doc_id for r in drop_repeated_lines(awkward).collect()}


def brute_runs(rows, least=40):
    """The lines left, blank ones apart, without all runs of ``least`` characters that stand further up or in an earlier text."""
    seen, out = set(), []
    for i, t in rows:
        full, gone = [x for x in t.split("\n") if x.strip(" ")], set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                run = tuple(full[a:b])
                if sum(map(len, run)) >= least:
                    if run in seen:
                        gone.update(range(a, b))
                    seen.add(run)
        out.append((i, [x for k, x in enumerate(full) if k not in gone]))
    return out


def test_whole_runs_brute(spark):
    rng = np.random.default_rng(4)
    pool = [c * n for c, n in zip("abcdefghijkl", (3, 60, 20, 7, 39, 40, 1, 25, 15, 90, 12, 30))] + ["", " "]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 14, rng.integers(1, 15)))) for i in range(150)]
    left = lambda out: sorted((i, [x for x in t.split("\n") if x.strip(" ")]) for i, t in out)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = left((r.doc_id, r.text) for r in line_dedup(frame, whole=True).collect())
    assert got == brute_runs(rows) != left((i, t) for i, _, t in brute_lines(rows))


def test_copy_with_short_last_line_leaves_the_pipeline(spark):
    text = "x" * 60 + "\n" + "y" * 20
    rows = [(i, text, "en", "s", len(text), 1, 2, 3, 4, "x") for i in (1, 2)]
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert [r.doc_id for r in stage(spark, spark.createDataFrame(rows, AWKWARD), SF).collect()] == [1]


# --- 9 token files ------------------------------------------------------------------------------------------------------
def test_codes_round_trip():
    rng = np.random.default_rng(2)
    for top in (1, 255, 256, 70_000, 1 << 24, (1 << 32) - 1):
        ids = (rng.random(5000) ** 3 * top).astype(np.uint32)
        segment = pack(ids)
        assert (unpack(segment) == ids).all()
        at = rng.integers(0, 5000, 2000)
        assert (access(segment, at) == ids[at]).all()


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    stream, want = [], {}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [1]
        want[i] = (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_documents(docs).collect()} == want
    out = str(tmp_path / "tokens")
    write_tokens(docs, out, path)
    at = list(range(0, len(stream), 997)) + [len(stream) - 1, len(stream), -1, None, 0, 0]
    asked = spark.createDataFrame([(p,) for p in at], "position long")
    assert {r.position: r.id for r in read_at(spark, out, asked).collect()} == {p: stream[p] for p in at if p is not None and 0 <= p < len(stream)}


def test_token_files_awkward(awkward, empty):
    rows = token_documents(awkward).orderBy("start").collect()
    assert len(rows) == len(ROWS) and rows[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert token_documents(empty).count() == 0


# --- 10 context trees ---------------------------------------------------------------------------------------------------
def test_scores_brute(docs, texts):
    got = {r.doc_id: r for r in score_texts(docs).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0end"] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i in texts if not out[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    counts = collections.Counter()
    for i, t in texts.items():
        if not out[i]:
            b = b"\0\0" + t.encode() + b"\xff"
            for k in range(2, len(b)):
                node = 1
                for bit in range(7, -1, -1):
                    x = b[k] >> bit & 1
                    for d in range(3):
                        counts[b[k - d : k], node, x] += 1
                    node = 2 * node + x
    longer = collections.defaultdict(set)
    for ctx, node, _ in counts:
        if ctx:
            longer[ctx[1:], node].add(ctx)
    memo = {}

    def own(ctx, node):
        a, b = counts[ctx, node, 0], counts[ctx, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            x = own(ctx, node)
            memo[ctx, node] = x if len(ctx) == 2 else float(np.logaddexp(x, sum(weighted(y, node) for y in longer[ctx, node]))) - math.log(2)
        return memo[ctx, node]

    def one(ctx, node):
        p = None
        for d in (2, 1, 0):
            s = ctx[2 - d :]
            a, b = counts[s, node, 0], counts[s, node, 1]
            kt = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == 2 else 1 / (1 + math.exp(min(700, sum(weighted(y, node) for y in longer[s, node]) - own(s, node))))
            p = kt if p is None else w * kt + (1 - w) * p
        return p

    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]), rel=1e-9)
    for i in sorted(texts)[:8]:
        b, total = b"\0\0" + texts[i].encode() + b"\xff", 0.0
        for k in range(2, len(b)):
            node = 1
            for bit in range(7, -1, -1):
                p = one(b[k - 2 : k], node)
                total += math.log10(p if b[k] >> bit & 1 else 1 - p)
                node = 2 * node + (b[k] >> bit & 1)
        assert got[i].score == pytest.approx(total, rel=1e-6)


def test_scores_awkward(awkward, empty):
    rows = score_texts(awkward).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert score_texts(empty).count() == 0


def brute_depth(training, texts, depth):
    """log10 of the probability of each text by the definition, context by context."""
    counts, longer, memo = collections.Counter(), collections.defaultdict(set), {}

    def choices(text):
        b = b"\0" * depth + text.encode() + b"\xff"
        for k in range(depth, len(b)):
            for bit in range(8):
                yield b[k - depth : k], (b[k] | 256) >> (8 - bit), b[k] >> (7 - bit) & 1

    for t in training:
        for ctx, node, x in choices(t):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node, x] += 1
                if d:
                    longer[ctx[depth - d + 1 :], node].add(ctx[depth - d :])

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            a, b = counts[ctx, node, 0], counts[ctx, node, 1]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            below = None if len(ctx) == depth else sum(weighted(y, node)[0] for y in longer[ctx, node])
            memo[ctx, node] = (own, 1.0) if below is None else (float(np.logaddexp(own, below)) - math.log(2), 1 / (1 + math.exp(min(700, below - own))))
        return memo[ctx, node]

    def one(ctx, node, d):
        s = ctx[depth - d :]
        a, b = counts[s, node, 0], counts[s, node, 1]
        w = weighted(s, node)[1]
        return w * (b + 0.5) / (a + b + 1) + (0 if d == depth else (1 - w) * one(ctx, node, d + 1))

    return [sum(math.log10(p if x else 1 - p) for ctx, node, x in choices(t) for p in [one(ctx, node, 0)]) for t in texts]


@pytest.mark.parametrize("depth,frequent", [(5, 1 << 21), (6, 20), (3, 0)])
def test_deep_contexts_brute(spark, monkeypatch, depth, frequent):
    monkeypatch.setattr(context_tree, "GRAMS", frequent)
    monkeypatch.setattr(context_tree, "HEAD", frequent)
    rng = np.random.default_rng(depth)
    pool = ["abra", "cadabra", "\u00e9t\u00e9", "alakazam", "\u4e2d\u6587", " ", "\n"]
    texts = ["".join(pool[k] for k in rng.integers(0, 7, rng.integers(0, 40))) for _ in range(30)] + [None, "", "zzz", "zzz"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    training = [t or "" for i, t in rows if i % 3]
    want = dict(enumerate(brute_depth(training, [t or "" for t in texts], depth)))
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 3 != 0, depth).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert [r.score for r in got] == pytest.approx([want[r.doc_id] for r in got], rel=1e-6)


def test_query_uses_deep_contexts(spark, docs):
    two = score_texts(docs).groupBy().sum("score").first()[0]
    assert QUERIES["op10_context_tree"](spark, SF).groupBy().sum("score").first()[0] > 0.9 * two


# --- pipeline -----------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, docs, texts):
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF)
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= set(texts)
        frame = after
    left = {r.doc_id: r.text for r in frame.collect()}
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert ids == set(left) and ids
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(brute_hits(t, items)[1] == 0 for t in left.values())


def test_pipeline_awkward(spark, awkward, empty):
    for frame in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
