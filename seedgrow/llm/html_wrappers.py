"""Main text of web pages by union-free wrapper inference.

Pages of one host share a template. A page is a stream of tokens: slots (a path
of block-level elements with its verdict, told apart by whether the page has
an article) and their texts. The streams of a host are matched slot by slot
without ever forming a union: differing texts make a text slot, a slot that
some pages lack is optional, and one that a page has several times is a
repeated group. Every block of a page is then kept or dropped by its slot:

* page furniture by element, role or ``hidden`` is template;
* a text that stands on nearly all pages of its slot is template, unless most
  of the text repeats so (near copies) or it is a heading inside an article;
* a repeated group of links, or a short link, outside an article is template;
* inside an article, or on a page without one, other slots are main text;
  beside an article they are where they outweigh it (the article is a teaser);
* slots that only a whole token of a class or id calls furniture are template,
  unless a host's pages have nothing else and the slot holds paragraphs.

A slot that the wrapper does not know is judged by its page alone.

Blocks are the texts between block-level tags; inside one, white space becomes
one space. Character references are decoded.

Scale: the wrapper is made from all blocks of all distinct pages (told apart by
a 64-bit hash of their html). A page gives one row of facts, digests in place of
texts; copies of a page are dropped by host and hash; facts are summed by host,
slot and text and then by host and slot, partially before each shuffle, so a hot
host does not gather in one task. A host's slots, not its pages, are judged
together. The wrappers, one row per host, are written and joined back by host
(broadcast only if their true size is small, else a join that the planner may
split on a hot host). Extraction is a map.

Edge cases: null or empty html gives an empty text; a null url belongs to the
host ''; repeated rows get equal results; a host with one page has a wrapper of
that page; broken markup (unclosed elements, stray '<', a page cut off inside a
tag, script or comment) is read as far as it goes; an unclosed raw element other
than script or style is empty, so is ``<svg/>``; the text of math and object stays.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch, read_table

# Fixed value: rows handled at once.
ROWS = 64
# A text is template if it stands on so many distinct pages, on
# this share of the pages that have its slot and on this share of the host's.
TEMPLATE_PAGES = 3
TEMPLATE_SLOT = 0.8
TEMPLATE_HOST = 0.05

# Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg select".split())
# Of these, what may hold itself, and what runs to the end of the page unclosed.
NESTED = {"svg", "template"}
TO_THE_END = {"script", "style"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
FURNITURE = set("nav footer aside form menu dialog button label fieldset search head".split())
ARTICLE = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# An element of the first kind is closed by the start of one of the second.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "head"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
# Inline elements that implied ends do not reach out of.
SCOPES = {"button", "object"}
# Words of classes and ids that mark page furniture, words that
# may stand beside them in one token ("related-posts"), whole tokens, words of
# a page's own header, and tokens that mark an article element as none.
_HINT_WORD = re.compile(
    r"ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu|breadcrumbs?|foot|footer|masthead|"
    r"topbar|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscri\w*|signup|popup|modal|overlay|share|"
    r"sharing|social|related|recommend\w*|comments?|commentlist|reply|replies|respond|discussion|disqus|pagination|pager|"
    r"toolbar|widget|login|search|skip|tags|copyright|legal"
)
_BESIDE = set(
    "area bar block body bottom box btn button buttons col container footer form global group has header icon icons inner "
    "item items left link links list main media message outer page panel policy post posts primary right row secondary "
    "section site slot stories text thread title top unit wrap wrapper".split()
)
_HINT_TOKEN = re.compile(r"site-?header|page-?header|sign-?up|join-us|follow-us|you-may-also-like|read-more")
_HEADER_WORDS = set("header head".split())
_NO_ARTICLE = re.compile(r"ads?|advert\w*|sponsored|promo\w*|comments?(?:-\w+)?|reply|replies|related(?:-\w+)?")
_HEADING = re.compile(r"(?:^|[>|+])h[1-6](?:[.@%][^>]*)?$")


def _hinted(value: str, words=_HINT_WORD.fullmatch) -> bool:
    """Whether a whole token of a class or id names page furniture: every word
    of it is such a word or one that goes with them, and one is."""
    for token in value.lower().replace("_", "-").split():
        if words == _HINT_WORD.fullmatch and _HINT_TOKEN.fullmatch(token):
            return True
        parts = [w for w in re.sub(r"\d+", "", token).split("-") if w]
        if any(map(words, parts)) and all(words(w) or w in _BESIDE for w in parts):
            return True
    return False


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def host_of(url):
    """Host of a url column, lower-cased, without port; '' if there is none."""
    h = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(h, F.lit(""))


def _raw_ends(page: str, name: str) -> dict[int, int]:
    """Where each element that may hold itself ends, by the end of its start tag."""
    ends: dict[int, int] = {}
    open_at: list[int] = []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", page, re.I):
        if not m[1]:
            if not m[2].rstrip().endswith("/"):
                open_at.append(m.end())
        elif open_at:
            ends[open_at.pop()] = m.end()
    return ends


def tokens(page: str) -> Iterator[tuple]:
    """('open', name, attributes), ('close', name) and ('text', text).

    The content of a raw element is skipped: up to its own end tag, counting
    nested svg and template. ``<svg/>`` and an unclosed element are empty, but
    an unclosed script or style runs to the end of the page."""
    at, n = 0, len(page)
    nested: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if name in NESTED:
                if name not in nested:
                    nested[name] = _raw_ends(page, name)
                if not attributes.rstrip().endswith("/"):
                    at = nested[name].get(at, at)
                continue
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else n if name in TO_THE_END else at
            continue
        yield "open", name, attributes


@lru_cache(maxsize=4096)
def _signature(name: str, attributes: str) -> tuple[str, str]:
    """What identifies an element in a path, and its verdict: '' none, 'drop',
    'hint' (dropped for a word of its class or id), 'article' or 'header'."""
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    cls = " ".join(sorted(re.sub(r"\d+", "#", found.get("class", "")).split()))
    ident = re.sub(r"\d+", "#", found.get("id", ""))
    role = found.get("role", "").lower()
    sig = name + (f".{cls}" if cls else "") + (f"@{ident}" if ident else "") + (f"%{role}" if role else "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(
        r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    named = [found.get("class", ""), found.get("id", "")]
    if name in ARTICLE or role in ("main", "article"):
        # The class of an article tells of its theme and subject, not its role.
        if name == "article" and any(_NO_ARTICLE.fullmatch(t) for t in named[0].lower().replace("_", "-").split()):
            return sig, "hint"
        return sig, "drop" if hidden else "article"
    if name in ("body", "html"):
        return sig, ""
    if name in FURNITURE or role in ROLES or hidden:
        return sig, "drop"
    if any(map(_hinted, named)):
        return sig, "hint"
    if name == "header" or any(_hinted(v, _HEADER_WORDS.__contains__) for v in named):
        return sig, "header"
    return sig, ""


class _Open:
    __slots__ = ("name", "sig", "verdict")

    def __init__(self, name, sig, verdict):
        self.name, self.sig, self.verdict = name, sig, verdict


def blocks(page: str) -> Iterator[tuple[str, str, str, float]]:
    """(path, verdict, text, share of the text inside links) of each block.

    The path names the enclosing block-level elements; the verdict is 'drop'
    inside page furniture, 'hint' inside what only its class or id calls so,
    'article' inside an article, else ''. Text inside inline furniture (a
    button, a label, something hidden) is left out of its block.
    """
    stack: list[_Open] = []
    held: list[str] = []
    around: list[_Open] = []  # what was open at the block's first text
    linked = 0
    links = 0
    cut = 0  # open inline furniture

    def close(i):
        nonlocal links, cut
        for o in stack[i:]:
            links -= o.name == "a"
            cut -= o.verdict == "drop" and o.name not in BLOCK
        del stack[i:]

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        share, linked = (linked / max(len(text), 1)), 0
        if not text:
            return None
        names = [o for o in stack if o.name in BLOCK]
        path = ">".join(o.sig for o in names)
        inside = any(o.verdict == "article" for o in stack)
        verdict = "article" if inside else ""
        seen_article = False
        for o in stack:
            if o.name not in BLOCK and not any(o is x for x in around):
                continue  # began inside the block
            seen_article = seen_article or o.verdict == "article"
            if o.verdict == "drop" or (o.verdict == "header" and not seen_article):
                verdict = "drop"
            elif o.verdict == "hint" and verdict != "drop":
                verdict = "hint"
        return path, verdict, text, min(share, 1.0)

    for tok in tokens(page):
        if tok[0] == "text":
            if cut:
                continue
            t = html_module.unescape(tok[1])
            if not held:
                around = [o for o in stack if o.verdict and o.name not in BLOCK]
            held.append(t)
            if links:
                linked += len(" ".join(t.split()))
            continue
        name = tok[1]
        if tok[0] == "open":
            if name in BLOCK:
                if (b := flush()) is not None:
                    yield b
                # Implied ends, up to the innermost element that can hold them.
                for i in range(len(stack) - 1, -1, -1):
                    if name in CLOSED_BY.get(stack[i].name, ()):
                        close(i)
                        break
                    if stack[i].name in SCOPES or (
                        stack[i].name in BLOCK and stack[i].name != "p" and stack[i].name not in CLOSED_BY
                    ):
                        break
            elif name == "br":
                held.append(" ")
            if name not in VOID:
                o = _Open(name, *_signature(name, tok[2]))
                stack.append(o)
                links += name == "a"
                cut += o.verdict == "drop" and name not in BLOCK
        else:
            if name in BLOCK and (b := flush()) is not None:
                yield b
            if name == "br":
                held.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
                # An inline end tag does not reach out of its block.
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
    if (b := flush()) is not None:
        yield b


# -- wrapper inference -------------------------------------------------------
# A slot is a path with its verdict, told apart by whether its page has an
# article ('+'). The facts of a slot are sums over its blocks on the host's
# distinct pages, so they do not depend on the order of alignment: ``align``
# gives the order of the items, the sums give the verdicts.


def slot_of(path: str, verdict: str, article: bool) -> str:
    return ("+" if article else "") + (f"{verdict}|" if verdict else "") + path


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def page_facts(page: str) -> list[tuple]:
    """(slot, digest, blocks, size of one block, 1 with the first text of the
    slot, per mille of link text, article text of the page) of each distinct
    text of each slot; the last two go with the slot's first text."""
    found = list(blocks(page))
    inside = sum(len(text) for _, verdict, text, _ in found if verdict == "article")
    facts: dict[tuple[str, int], list[int]] = {}
    firsts: dict[str, list[int]] = {}
    for path, verdict, text, share in found:
        slot = slot_of(path, verdict, inside > 0)
        fact = facts.setdefault((slot, _digest(text)), [0, len(text), 0, 0, 0])
        fact[0] += 1
        first = firsts.setdefault(slot, fact)
        first[2], first[4] = 1, inside
        first[3] += round(share * 1000)
    return [(*key, *fact) for key, fact in facts.items()]


def align(wrapper: list[dict], page: list[dict]) -> list[dict]:
    """The wrapper generalised to match ``page`` too: a longest common
    subsequence of slots is kept, the rest becomes optional."""
    a, b = [w["key"] for w in wrapper], [w["key"] for w in page]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            x, y = wrapper[i], page[j]
            out.append(
                {**x, "text": x["text"] if x["text"] == y["text"] else None, "rep": x["rep"] or y["rep"],
                 "opt": x["opt"] or y["opt"], "n": x["n"] + y["n"], "link": x["link"] + y["link"],
                 "size": x["size"] + y["size"], "pages": x["pages"] + y["pages"]}
            )
            i, j = i + 1, j + 1
        elif j < len(b) and out and out[-1]["key"] == b[j] and best[i][j + 1] == best[i][j]:
            out.append({**page[j], "opt": True})  # one more of the last slot: a repeated group
            j += 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append({**wrapper[i], "opt": True})
            i += 1
        else:
            out.append({**page[j], "opt": True})
            j += 1
    # Neighbours of one slot are one repeated group.
    merged: list[dict] = []
    for w in out:
        if merged and merged[-1]["key"] == w["key"]:
            m = merged[-1]
            m.update(rep=True, text=None, n=m["n"] + w["n"], link=m["link"] + w["link"], size=m["size"] + w["size"],
                     pages=max(m["pages"], w["pages"]), opt=m["opt"] and w["opt"])
        else:
            merged.append(w)
    return merged


def is_template(pages: int, slot_pages: int, host_pages: int) -> bool:
    """Whether a text on ``pages`` pages is the same on nearly all of a slot's."""
    return pages >= TEMPLATE_PAGES and pages >= TEMPLATE_SLOT * slot_pages and pages >= TEMPLATE_HOST * host_pages


def judge(slots: dict[str, dict]) -> dict:
    """Wrapper of a host from the facts of its slots: for each slot whether
    its text is main text (``slots``), and the texts in it that are template
    all the same (``texts``).

    A slot's facts: ``pages``, ``n`` blocks, ``size`` and ``link`` (per mille)
    summed over them, ``inside`` (article text of its pages), ``fixed``
    (template texts as [digest, blocks, size]).
    """
    out: dict[str, bool] = {}
    texts: dict[str, list[int]] = {}
    for article in (False, True):
        sign = "+" if article else ""
        kind = {s: f for s, f in slots.items() if s.startswith("+") == article and not s.startswith(f"{sign}drop|")}
        # The heading of a series stands on all its pages and is main text.
        kind = {s: {**f, "fixed": []} if s.startswith("+article|") and _HEADING.search(s) else f for s, f in kind.items()}
        fixed = {s: sum(n * size for _, n, size in f["fixed"]) for s, f in kind.items()}
        menu = {
            s: f["link"] > 800 * f["n"] and (f["n"] > f["pages"] or f["size"] < 80 * f["n"]) for s, f in kind.items()
        }

        def of(verdict):
            return {s for s in kind if s.startswith(f"{sign}{verdict}|")}

        def chosen(names):
            # Where most of the text repeats, the pages are near copies and
            # repeating says nothing.
            copies = 2 * sum(fixed[s] for s in names) > sum(kind[s]["size"] for s in names)
            main = {s for s in names if copies or fixed[s] < kind[s]["size"]}
            return main, set() if copies else main

        plain = {s for s in kind.keys() - of("article") - of("hint") if not menu[s]}
        if article:
            # Text beside an article is main where it outweighs the article.
            main, _ = chosen(of("article"))
            beside, cut = chosen({s for s in plain if kind[s]["size"] - fixed[s] > kind[s]["inside"]})
            main |= beside
        else:
            main, cut = chosen(plain)
        if not main:
            # Nothing but slots with the class words of furniture: the words
            # mislead where texts of a paragraph's length vary.
            main, cut = chosen({s for s in of("hint") if not menu[s] and kind[s]["size"] >= 80 * kind[s]["n"]})
        out.update({s: s in main for s in kind})
        texts.update({s: sorted(t for t, _, _ in kind[s]["fixed"]) for s in cut if kind[s]["fixed"]})
    out.update({s: False for s in slots if s not in out})
    return {"slots": out, "texts": texts}


def infer(pages: list[str]) -> dict:
    """Wrapper of a host from all the given pages."""
    distinct = sorted(set(p for p in pages if p))
    slots: dict[str, dict] = {}
    seen: dict[tuple[str, int], list[int]] = {}
    for page in distinct:
        for slot, digest, n, size, first, link, inside in page_facts(page):
            f = slots.setdefault(slot, {"pages": 0, "n": 0, "size": 0, "link": 0, "inside": 0, "fixed": []})
            for k, v in (("pages", first), ("n", n), ("size", n * size), ("link", link), ("inside", inside)):
                f[k] += v
            t = seen.setdefault((slot, digest), [0, 0, size])
            t[0], t[1] = t[0] + 1, t[1] + n
    for (slot, digest), (on, n, size) in seen.items():
        if is_template(on, slots[slot]["pages"], len(distinct)):
            slots[slot]["fixed"].append([digest, n, size])
    return judge(slots)


def extract(page: str | None, wrapper: dict) -> str:
    """Main text of a page, read through its host's wrapper."""
    if not page:
        return ""
    found = list(blocks(page))
    article = any(v == "article" for _, v, _, _ in found)
    slots, texts = wrapper.get("slots", {}), wrapper.get("texts", {})
    out = []
    for path, verdict, text, share in found:
        slot = slot_of(path, verdict, article)
        main = slots.get(slot)
        if main is None:
            main = verdict == "article" if article else verdict == "" and share <= 0.8
        elif main and slot in texts:
            main = _digest(text) not in texts[slot]
        if main:
            out.append(text)
    return "\n".join(out)


_FACTS = "slot:string,digest:bigint,n:bigint,size:bigint,first:bigint,link:bigint,inside:bigint"


def host_wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, wrapper`` (JSON) from all distinct pages of each host."""
    rows = pages.where(F.length("html") > 0).select(host_of(F.col("url")).alias("host"), "html")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split(":")[0] for x in _FACTS.split(",")]
        fact = pa.struct([(n, pa.string() if n == "slot" else pa.int64()) for n in names])
        schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("facts", pa.list_(fact))])
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                html = part.column("html").to_pylist()
                facts = [[dict(zip(names, f)) for f in page_facts(p)] for p in html]
                columns = [part.column("host"), pa.array(map(_digest, html), pa.int64()), pa.array(facts, schema.field("facts").type)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    facts = rows.mapInArrow(read, f"host string, page bigint, facts array<struct<{_FACTS}>>")
    # One row a page, with a slot of no name for the page itself.
    facts = facts.dropDuplicates(["host", "page"]).select("host", F.explode(
        F.concat("facts", F.array(F.struct(F.lit("").alias("slot"), *[F.lit(int(n == "first")).cast("long").alias(n) for n in
                 ("digest", "n", "size", "first", "link", "inside")])))).alias("f")).select("host", "f.*")
    key = ["host", "slot"]
    texts = facts.groupBy(*key, "digest").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("first", "link", "inside")])
    texts = scratch.keep(texts, "texts")
    slots = scratch.keep(texts.groupBy(*key).agg(
        F.sum("first").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size"),
        F.sum("link").alias("link"), F.sum("inside").alias("inside")), "slots")
    # is_template, in columns; at most a few texts of a slot pass.
    hosts = slots.where("slot = ''").select("host", F.col("pages").alias("host_pages"))
    fixed = texts.where((F.col("pages") >= TEMPLATE_PAGES) & (F.col("slot") != ""))
    fixed = fixed.join(slots.select(*key, F.col("pages").alias("slot_pages")), key).join(hosts, "host")
    fixed = fixed.where((F.col("pages") >= TEMPLATE_SLOT * F.col("slot_pages").cast("double"))
                        & (F.col("pages") >= TEMPLATE_HOST * F.col("host_pages").cast("double")))
    fixed = fixed.groupBy(*key).agg(F.sort_array(F.collect_list(F.array("digest", "n", "size"))).alias("fixed"))
    slots = slots.where("slot != ''").join(fixed, key, "left")

    def run(rows):
        import pandas as pd

        names = ["pages", "n", "size", "link", "inside"]
        facts = {r["slot"]: {**{k: int(r[k]) for k in names}, "fixed": [[int(x) for x in f] for f in r["fixed"]] if r["fixed"] is not None else []}
                 for r in rows.to_dict("records")}
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(judge(facts), ensure_ascii=False, sort_keys=True)]})

    return slots.groupBy("host").applyInPandas(run, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    pages = pages.select("page_id", "url", "html")
    wrappers = scratch.keep(host_wrappers(pages, scratch), "wrappers").withColumnRenamed("host", "of_host")
    rows = pages.withColumn("host", host_of(F.col("url")))
    rows = rows.join(wrappers, rows["host"] == wrappers["of_host"], "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        @lru_cache(maxsize=256)
        def load(text: str) -> dict:
            return json.loads(text)

        for b in batches:
            texts = []
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                for page, w in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist()):
                    texts.append(extract(page, load(w) if w else {}))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op1_html(spark, sf_dir: str) -> DataFrame:
    d = extract_pages(read_table(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
