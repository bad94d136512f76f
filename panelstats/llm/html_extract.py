"""Operator 6: main text of web pages by equivalence-class template deduction.

Every tag of a page is a token whose role is its path of containers. A token's
occurrence vector says how often it stands on each page of its host; it is kept
as fingerprint sums, so that vectors of any length are grouped by a plain
aggregate and a host may have any number of pages. Tokens with equal vectors form
an equivalence class. The class that stands exactly once on every page that has tags, in the
order of its mean positions and with every element's end after its start, is the
host's template; the other large classes are nested into the gap of the template
that holds them. The template's slots are then searched for the article: an
``article`` or ``main`` element, otherwise the deepest element of the template
that holds most of the host's text, menus and the like left out. Words are never
taken for template, so no part of a text is lost because many pages share it.

Inside the chosen slot, scripts, forms, asides, notices, adverts, comments and
other page furniture are left out, character references are decoded, white space
inside a block becomes one blank, and blocks are joined by blanks. A page that
lacks its host's slot is read by its own tags.

Defined results: null and empty pages, and pages without an article or any other
text, give the empty string; a null URL has the empty host; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

BROADCAST_HOSTS = 200_000
DOMINANT = 0.6  # share of a host's text that the deepest chosen container must hold

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CONTAINERS = frozenset("html body div article main section nav header footer aside form table ul ol dl menu figure "
                       "details dialog fieldset address".split())
INLINE = frozenset("a b i em strong span u s small big sub sup code mark abbr cite q time kbd var samp font label ins "
                   "del bdi bdo dfn tt wbr img".split())
FURNITURE_TAGS = frozenset("head nav header footer aside form menu dialog button".split())
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie "
                            "cookies consent notice notices alert popup modal sidebar menu nav navbar navigation "
                            "breadcrumb breadcrumbs footer header masthead comment comments replies reply respond "
                            "related share sharing social newsletter subscribe pagination pager toolbar "
                            "complementary contentinfo search".split())
WORD_BREAK = re.compile(r"[^a-z0-9]+")


def _signature(name: str, attrs: str) -> tuple[str, bool]:
    """Name with class, id and role, and whether they say page furniture."""
    if not attrs or "=" not in attrs:
        return name, name in FURNITURE_TAGS
    marks = [(a.lower(), (x or y or z).lower()) for a, x, y, z in ATTRIBUTE.findall(attrs)]
    said = {w for _, v in marks for w in WORD_BREAK.split(v)}
    sig = name + "".join(f"[{a}={re.sub('[0-9]+', '0', v)}]" for a, v in sorted(marks))
    return sig, name in FURNITURE_TAGS or (name in CONTAINERS or name == "p") and not said.isdisjoint(FURNITURE_WORDS)


def events(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """("text", s, furniture, path), ("open" | "close", token, furniture, path), ("break" | "inline", ...)."""
    stack: list[tuple[str, str, bool]] = []  # name, path, furniture
    at = 0
    for m in MARKUP.finditer(page):
        path, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        if m.start() > at:
            yield "text", page[at:m.start()], inside, path
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in CONTAINERS or name in FURNITURE_TAGS:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    path, inside = stack[depth][1], stack[depth][2]
                    del stack[depth:]
                    yield "close", path, inside, path
            else:
                yield ("inline" if name in INLINE else "break"), f"{path}</{name}>", inside, path
        elif name in CONTAINERS or name in FURNITURE_TAGS:
            sig, furniture = _signature(name, m["attrs"])
            path, inside = f"{path}/{sig}", inside or furniture
            stack.append((name, path, inside))
            yield "open", path, inside, path
        else:
            yield ("inline" if name in INLINE else "break"), f"{path}<{name}>", inside, path
    if at < len(page):
        path, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        yield "text", page[at:], inside, path


def _within(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _blocks(found: list[tuple[str, str, bool, str]], top: str) -> str:
    """Text of the containers with path ``top``, without furniture."""
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            words = html.unescape("".join(block)).split()
            if words:
                out.append(" ".join(words))
            block.clear()

    for kind, what, furniture, path in found:
        if furniture or not _within(path, top):
            if kind != "inline":
                close()
        elif kind == "text":
            block.append(what)
        elif kind != "inline":
            close()
    close()
    return " ".join(out)


def _name(path: str) -> str:
    return path.rpartition("/")[2].partition("[")[0]


def own_slot(found: list[tuple[str, str, bool, str]]) -> str:
    """Path of the page's own article, main element or dominant container."""
    opened = [w for kind, w, furniture, _ in found if kind == "open" and not furniture]
    for name in ("article", "main"):
        hit = next((p for p in opened if _name(p) == name), None)
        if hit:
            return hit
    chars = {p: sum(len(w.strip()) for kind, w, furniture, path in found
                    if kind == "text" and not furniture and _within(path, p)) for p in dict.fromkeys(opened)}
    everything = sum(len(w.strip()) for kind, w, furniture, _ in found if kind == "text" and not furniture)
    return max((p for p, c in chars.items() if c >= DOMINANT * everything), key=lambda p: p.count("/"), default="")


def extract(page: str | None, slot: str | None) -> str:
    """Main text of one page; ``slot`` is the host's."""
    found = list(events(page or ""))
    if slot is None or not any(kind == "open" and w == slot for kind, w, _, _ in found):
        slot = own_slot(found)
    return _blocks(found, slot)


def token_vectors(pages: DataFrame) -> DataFrame:
    """``host, token, pages, s1, s2, place, chars``: one row per token of a host; the
    empty token stands once on every page that has tags."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            acc: dict[tuple[str, str], list] = {}
            for n, (host, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = list(events(page or ""))
                one: dict[str, list] = {"": [1, 0.0, 0]}
                opened: list[str] = []
                for i, (kind, what, furniture, path) in enumerate(found):
                    if kind == "text":
                        size = 0 if furniture else len(what.strip())
                        if size:
                            for p in opened:
                                if _within(path, p):
                                    one["+" + p][2] += size
                            one[""][2] += size
                        continue
                    token = ("+" if kind == "open" else "-" if kind == "close" else "") + what
                    t = one.setdefault(token, [0, 0.0, 0])
                    t[0] += 1
                    t[1] += (i + 1) / (len(found) + 1)
                    if kind == "open" and not furniture and what not in opened:
                        opened.append(what)
                if len(one) == 1:
                    continue  # a page without tags says nothing of the template
                seed = f"{batch.column(0)[n].as_py()}\0{len(page or '')}".encode()
                weight = int.from_bytes(blake2b(seed, digest_size=8).digest(), "little") | 1
                for token, (count, place, chars) in one.items():
                    a = acc.setdefault((host, token), [0, 0, 0, 0.0, 0])
                    v = weight * count & mask
                    a[0] += 1
                    a[1] += v >> 32
                    a[2] += v & 0xFFFFFFFF
                    a[3] += place / count
                    a[4] += chars
            keys, vals = list(acc), list(zip(*acc.values(), strict=True)) if acc else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 *[pa.array(vals[i], pa.float64() if i == 3 else pa.int64()) for i in range(5)]],
                names=["host", "token", "pages", "s1", "s2", "place", "chars"])

    rows = pages.select("page_id", "host", "html").mapInArrow(
        run, "host string, token string, pages long, s1 long, s2 long, place double, chars long")
    return rows.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "s1", "s2", "place", "chars")])


def templates(vectors: DataFrame) -> DataFrame:
    """``host, class, level, token, place``: the template (level 0) and the classes of
    two tokens and more nested in its gaps (level 1, ``gap`` is the token before)."""
    page = vectors.where(F.col("token") == "").select("host", F.col("pages").alias("n"), F.col("s1").alias("p1"),
                                                      F.col("s2").alias("p2"), F.col("chars").alias("all_chars"))
    t = vectors.where(F.col("token") != "").join(page, "host") \
        .withColumn("place", F.col("place") / F.col("pages")).where(2 * F.col("pages") >= F.col("n"))
    t = t.withColumn("root", (F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2")))
    same = Window.partitionBy("host", "s1", "s2")
    t = t.withColumn("size", F.count(F.lit(1)).over(same)).where(F.col("root") | (F.col("size") >= 2))
    before = Window.partitionBy("host").orderBy("place", "token").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("gap", F.last(F.when(F.col("root"), F.col("token")), ignorenulls=True).over(before)) \
        .select("host", F.xxhash64("s1", "s2").alias("class"), F.when(F.col("root"), 0).otherwise(1).alias("level"),
                "token", "place", "gap", "chars", "all_chars")


def slots(template: DataFrame) -> DataFrame:
    """``host, slot``: the template element that holds the article."""
    root = template.where(F.col("level") == 0)
    path = F.substring("token", 2, 1 << 30)
    opens = root.where(F.col("token").startswith("+")).select("host", path.alias("path"), "place", "chars", "all_chars")
    closes = root.where(F.col("token").startswith("-")).select("host", path.alias("path"), F.col("place").alias("stop"))
    # nested: an element's end, where the template has it, comes after its start
    o = opens.join(closes, ["host", "path"], "left").where(F.col("stop").isNull() | (F.col("stop") > F.col("place")))
    last = F.regexp_extract("path", r"/([a-z0-9]+)[^/]*$", 1)
    rank = F.when(F.col("chars") <= 0, 0).when(last == "article", 3).when(last == "main", 2) \
        .when(F.col("chars") >= DOMINANT * F.col("all_chars"), 1).otherwise(0)
    depth = F.size(F.split("path", "/"))
    best = o.withColumn("rank", rank).where(F.col("rank") > 0) \
        .groupBy("host").agg(F.max_by("path", F.struct("rank", F.when(F.col("rank") == 1, depth).otherwise(0),
                                                       -F.col("place"), "path")).alias("slot"))
    return best


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"),
                        F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1)).alias("host"))
    vectors = stage_table(token_vectors(rows), "vectors")
    found = stage_table(slots(templates(vectors)), "slots")
    if found.count() <= BROADCAST_HOSTS:
        found = F.broadcast(found)
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "slot")
    kind = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [extract(h, s) for h, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
