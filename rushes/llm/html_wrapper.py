"""Main text of web pages by wrapper inference.

A wrapper is a union-free regular expression over the block elements of a host's pages: an element may be optional (?) or
repeated (+), neighbours that recur together form a repeated group, and text is a slot.  The pages of a host are folded
into it one after the other.  Two streams are aligned by their longest common elements; what has no partner becomes
optional, what follows itself becomes repeated.

Folding goes in two steps, so that a host with a third of all pages is no single group: pages are reduced to their own
expressions, of which a host has few distinct ones, and those are folded, first within ``SALTS`` parts of a host, then
over the parts.  Along with it come the characters of every slot, inside and outside links.

The wrapper of a host then decides which slots hold the main text: those of its articles, or of its main element, or,
without either, of the smallest element with most of the text that isn't boilerplate or links.  Menus, headers, footers,
sidebars, notices, adverts, forms and comments inside it don't count.  Pages are read along the wrapper.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import written
from rushes.llm.html_tree import Node, is_noise, parse

SALTS = 16
BROADCAST = 32 << 20
MOST = 0.6

#: Blocks that hold a paragraph or list, not an article.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote tr td th thead tbody figure figcaption center".split())


def is_main(label: str, tag: str) -> bool:
    return label.split(".")[0] == tag or (tag == "main" and "main" in label.split(".")[1:])


# An expression is a list of items [label, optional, repeated, items]; groups have the label "()".


def _key(items: list) -> str:
    return json.dumps(items, separators=(",", ":"))


def fold_repeats(items: list, most: int = 4) -> list:
    """Neighbouring runs of up to ``most`` items that recur become one repeated item or group."""
    for size in range(1, most + 1):
        out, i = [], 0
        while i < len(items):
            labels = [x[0] for x in items[i : i + size]]
            j = i + size
            while size and j + size <= len(items) and [x[0] for x in items[j : j + size]] == labels:
                j += size
            if j == i + size or len(labels) < size:
                out.append(items[i])
                i += 1
                continue
            merged = items[i : i + size]
            for k in range(i + size, j, size):
                merged = [join(a, b) for a, b in zip(merged, items[k : k + size])]
            if size == 1:
                out.append([merged[0][0], merged[0][1], True, merged[0][3]])
            else:
                out.append(["()", False, True, merged])
            i = j
        items = out
    return items


def join(a: list, b: list) -> list:
    """One item that matches what either of two items of the same label matches."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def align(a: list, b: list) -> list:
    """One expression that matches what either matches: partners are joined, all else becomes optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    return fold_repeats(out)


def expression(node: Node) -> list:
    """The expression of one page, its repeats folded."""
    return fold_repeats([[c.label, False, False, expression(c)] for c in node.children])


def slot_sizes(node: Node, path: str, out: dict) -> None:
    for c in node.children:
        if c.label == "#":
            n = out.setdefault(path, [0, 0])
            n[0] += len(c.text)
            n[1] += c.linked
        else:
            slot_sizes(c, f"{path}/{c.label}", out)


def decide(items: list, sizes: dict[str, list[int]]) -> list[str]:
    """Paths of the elements that hold the main text; everything below them counts but noise."""
    found: dict[str, list[str]] = {"article": [], "main": []}
    weight: dict[str, float] = {}

    def walk(items: list, path: str, clean: bool) -> float:
        total = max(sizes.get(path, (0, 0))[0] - 2 * sizes.get(path, (0, 0))[1], 0) if clean else 0
        for label, _, _, inner in items:
            if label == "()":
                total += walk(inner, path, clean) - (max(sizes.get(path, (0, 0))[0] - 2 * sizes.get(path, (0, 0))[1], 0) if clean else 0)
            elif label != "#":
                own, ok = f"{path}/{label}", clean and not is_noise(label)
                for tag, paths in found.items():
                    if ok and is_main(label, tag):
                        paths.append(own)
                total += walk(inner, own, ok)
        weight[path] = max(weight.get(path, 0), total)
        return total

    whole = walk(items, "", True)
    for paths in (found["article"], found["main"]):
        if paths:
            return sorted({p for p in paths if not any(p.startswith(q + "/") for q in paths)})
    held = [p for p, n in weight.items() if whole and n >= MOST * whole and p.rpartition("/")[2].split(".")[0] not in PARTS]
    return [max(held, key=lambda p: (p.count("/"), p))] if held else [""]


def main_text(root: Node, wrapper: list, mains: list[str]) -> str:
    """The text of the slots below ``mains``, read along the wrapper; a page without them decides for itself."""
    out: list[str] = []

    def slots(items: list) -> dict:
        flat: dict[str, list] = {}
        for label, _, _, inner in items:
            if label == "()":
                for k, v in slots(inner).items():
                    flat[k] = align(flat[k], v) if k in flat else v
            else:
                flat[label] = align(flat[label], inner) if label in flat else inner
        return flat

    def walk(node: Node, items: list, path: str, inside: bool) -> None:
        here = slots(items)
        for c in node.children:
            if c.label == "#":
                if inside:
                    out.append(c.text)
            elif not is_noise(c.label) and c.label in here:
                own = f"{path}/{c.label}"
                walk(c, here[c.label], own, inside or own in mains)

    walk(root, wrapper, "", "" in mains)
    return " ".join(out)


def extract(page: str, wrapper: list | None = None, mains: list[str] | None = None) -> str:
    """The main text of a page by its host's wrapper, or by its own expression where that finds nothing."""
    root = parse(page)
    text = main_text(root, wrapper, mains) if wrapper is not None else ""
    if not text:
        own, sizes = expression(root), {}
        slot_sizes(root, "", sizes)
        text = main_text(root, own, decide(own, sizes))
    return text


def host_of(url: str):
    """The lower-case host of a URL column, without port and user; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _pages(batches):
    for b in batches:
        counts: dict[tuple[str, str], int] = {}
        sizes: dict[tuple[str, str], list[int]] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root, own = parse(page or ""), {}
            key = host, _key(expression(root))
            counts[key] = counts.get(key, 0) + 1
            slot_sizes(root, "", own)
            for path, (n, linked) in own.items():
                x = sizes.setdefault((host, path), [0, 0])
                x[0] += n
                x[1] += linked
        rows = [(h, 0, e, n, 0) for (h, e), n in counts.items()] + [(h, 1, p, n, k) for (h, p), (n, k) in sizes.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["host", "kind", "value", "n", "linked"],
            )


def _folded(table: pa.Table) -> pa.Table:
    """One expression for a group of expressions, in the order of their text."""
    host, found = table.column("host")[0].as_py(), None
    for e in sorted(table.column("value").to_pylist()):
        items = json.loads(e)
        found = items if found is None else align(found, items)
    return pa.table({"host": pa.array([host], pa.string()), "value": pa.array([_key(found)], pa.string())})


def _decided(table: pa.Table) -> pa.Table:
    host, found, sizes = table.column("host")[0].as_py(), None, {}
    for kind, value, n, linked in zip(*(table.column(c).to_pylist() for c in ("kind", "value", "n", "linked"))):
        if kind:
            sizes[value] = [n, linked]
    for kind, value in sorted(zip(table.column("kind").to_pylist(), table.column("value").to_pylist())):
        if not kind:
            items = json.loads(value)
            found = items if found is None else align(found, items)
    return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([_key(found or [])], pa.string()), "mains": pa.array([json.dumps(decide(found or [], sizes))], pa.string())})


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, mains): the expression of every host and the paths of its main text, both as JSON."""
    facts = written(
        pages.select(host_of(url).alias("host"), page).mapInArrow(_pages, "host string, kind int, value string, n long, linked long")
        .groupBy("host", "kind", "value").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked")), "expressions",
    )
    salted = facts.where("kind = 0").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    parts = salted.groupBy("host", "salt").applyInArrow(_folded, "host string, value string").select(
        "host", F.lit(0).alias("kind"), "value", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("linked")
    )
    return parts.unionByName(facts.where("kind = 1")).groupBy("host").applyInArrow(_decided, "host string, wrapper string, mains string")


def _texts(pages):
    def run(batches):
        read: dict[str, tuple[list, list[str]]] = {}
        for b in batches:
            texts = []
            for page, wrapper, mains in zip(*(b.column(j).to_pylist() for j in range(3))):
                if wrapper not in read:
                    if len(read) >= 1000:
                        read.clear()
                    read[wrapper] = (json.loads(wrapper), json.loads(mains)) if wrapper is not None else (None, None)
                texts.append(extract(page or "", *read[wrapper]))
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=pages)

    return run


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the page.

    A null page counts as empty and has the empty text; a null or unreadable URL belongs to the host named by the empty
    string.  Pages are read alone, so repeated rows get equal results.  Other columns pass through and must not be named
    text, n_chars or begin with ``_w_``.  An empty table gives no rows.
    """
    rest = [c for c in pages.columns if c != page]
    made = written(wrappers(pages, url, page), "wrappers").select(F.col("host").alias("_w_host"), F.col("wrapper").alias("_w_wrapper"), F.col("mains").alias("_w_mains"))
    size = made.agg(F.sum(F.length("_w_wrapper") + F.length("_w_mains") + F.length("_w_host"))).first()[0] or 0
    made = F.broadcast(made) if size <= BROADCAST else made
    both = pages.join(made, host_of(url) == F.col("_w_host"), "left").select(page, "_w_wrapper", "_w_mains", *rest)
    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")
    return both.mapInArrow(_texts([*rest, "text", "n_chars"]), schema)
