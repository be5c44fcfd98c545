"""Main text of HTML pages by the maximum-scoring contiguous run of tokens.

A page is read into tokens: tags, runs of words, and removed elements (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; told by
element name, role, class and id).  The outer edges of ``article`` and ``main`` elements (from
the first one's start to the last one's end), or of containers named as content where a
page has neither, are not crossed; borders between and inside them weigh as learned.  Words
score positive, tags and removed elements negative (tags between two words count once); one
linear scan finds the run with the largest sum.  The weights are log odds
of lying inside the content, counted by a Spark job over labelled pages (those that mark
their content by closed ``article`` or ``main`` elements) on top of the prior counts below.

Text of a block is decoded, its white space made one space and trimmed; the blocks of the
run are joined in page order by one newline.  Nothing else is dropped.

Defined results: null, empty or wordless html gives the empty string; unclosed elements
end with their parent; repeated rows each get their text; without labelled pages the
priors alone give the weights.
"""
from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, col

# Element names of the HTML standard by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes title textarea xmp".split())
REMOVED = frozenset("head nav footer aside form button select dialog menu object canvas audio video map svg math".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FOREIGN = frozenset(["svg", "math"])
# start tags that end an open svg or math, by the standard
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                     "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
                   "q s samp small span strike strong sub sup time tt u var wbr".split())
LANDMARKS = frozenset(["article", "main"])
# Words in class, id and role that name parts which are not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login register share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion widget widgets toolbar pagination pager "
    "search searchbox skip contentinfo complementary".split())
# words that beside those say nothing of their own: where all parts of a class are of the two
# sets or a content's name, the class names a removed part inside content, too
PLACES = frozenset("list area section box wrapper wrap container block form links link bar items item inner group slot unit "
                   "posts articles stories left right top bottom site page global js".split())
# elements that hold words of an article, never removed for a class
TEXT_ELEMENTS = INLINE | HEADINGS | frozenset("p pre code blockquote figure figcaption table tbody thead tr td th li dt dd".split())
# a class that says what a container has, not what it is
STATES = ("has-", "has_", "with-", "with_", "no-", "no_")
HEADER_WORDS = frozenset(["header"])
CONTENT_WORDS = frozenset("article entry post story content".split())

# Prior counts (inside, outside) of a token kind, as from a hundred hand-labelled pages.
PRIOR = {"words": (900, 100), "link words": (30, 70), "far words": (1, 99), "inline": (300, 100), "p": (300, 100),
         "heading": (150, 100), "list": (95, 100), "table": (95, 100), "quote": (150, 100), "block": (25, 100),
         "removed": (10, 100), "inner": (300, 100), "border": (95, 100), "landmark": (0, 1000), "page": (0, 1000)}
KINDS = {**{x: "inline" for x in INLINE}, **{x: "heading" for x in HEADINGS}, "p": "p",
         **{x: "list" for x in ("ul", "ol", "li", "dl", "dt", "dd")},
         **{x: "table" for x in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")},
         **{x: "quote" for x in ("blockquote", "pre", "figure", "figcaption", "hr")},
         "article": "landmark", "main": "landmark", "html": "page", "body": "page"}

# a tag's attributes as the standard reads them: a quote opens a value only right behind the equals
# sign, an unquoted value ends at white space or >; a quote that is never closed is none
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)"
                    r"((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.S)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_PART = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                      "main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div body html table ul ol td th nav aside footer header form blockquote".split())


def _names(found: dict) -> list[str]:
    """The single classes and the id of an element."""
    return [x for k in ("class", "id") for x in found.get(k, "").split()]


def _is_removed(name: str, attrs: str, in_article: bool, in_content: bool) -> bool:
    if name in REMOVED:
        return True
    if name in ("html", "body", "main"):
        return False
    content = name == "article" or _is_content(name, attrs)
    if name == "header" and not in_article:
        return True
    if attrs and "=" in attrs or "hidden" in attrs:
        found = {}
        for k, v in _ATTR.findall(attrs):
            found.setdefault(k.lower(), v.strip("\"'"))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return True
        if found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form",
                                             "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"):
            return True
        if content or name in TEXT_ELEMENTS:         # words beside the content's own name are its state
            return False
        parts = [{p.lower() for p in _PART.findall(x)} for x in _names(found) if not x.lower().startswith(STATES)]
        if in_content:                               # the class must name nothing else
            return any(x & BOILERPLATE and x <= BOILERPLATE | PLACES | CONTENT_WORDS for x in parts)
        named = set().union(*parts)
        if named & BOILERPLATE:
            return True
        if named & HEADER_WORDS and not in_article and not named & CONTENT_WORDS:
            return True
    return False


def _is_content(name: str, attrs: str) -> bool:
    """Whether class, id or role of a container says that it holds the content."""
    if name not in ("div", "section", "td") or "=" not in attrs:
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    parts = [{p.lower() for p in _PART.findall(x)} for x in _names(found)]
    return any(x & CONTENT_WORDS and not x & BOILERPLATE for x in parts) or found.get("role", "").lower() in ("main", "article")


def tokens(page: str | None) -> list[tuple]:
    """(kind, text, block, inside a landmark) per token; text is None for markup.  Landmarks
    are ``article`` and ``main``, or on pages without them the outermost containers
    named as content (kind ``soft``); all but the first start and the last end are
    ``border``.  Inside a removed element nothing is listed but the
    element itself, once."""
    out = _tokens(page)
    edge, at = next(((x, 3) for x in ["landmark"] if any(t[0].startswith(x) for t in out)), ("soft", 4))
    marks = [k for k, t in enumerate(out) if t[0].startswith(edge)]
    outer = {k for k in marks[:1] if out[k][0] == edge} | {k for k in marks[-1:] if out[k][0] != edge}
    return [(edge if k in outer else "border" if t[0].startswith(edge) else "block" if t[0].startswith("soft") else t[0],
             t[1], t[2], t[at]) for k, t in enumerate(out)]


def _tokens(page: str | None) -> list[tuple]:
    if not page:
        return []
    out: list[tuple] = []
    stack: list[tuple[str, bool]] = []
    place: dict[str, list[int]] = {}                 # name -> where it is on the stack
    scopes: list[int] = []
    block, removed, links, header, headings = 0, 0, 0, 0, 0
    marks, soft = 0, 0                               # open landmarks; depth of the outermost content container

    def text(raw: str) -> None:
        if raw and not removed and (not header or headings):
            t = _html.unescape(raw) if "&" in raw else raw
            out.append(("link words" if links else "words", t, block, marks > 0, soft > 0))

    def close(k: int) -> None:
        nonlocal removed, links, marks, block, header, headings, soft
        while len(stack) > k:
            name, gone = stack.pop()
            place[name].pop()
            if name in _SCOPE:
                scopes.pop()
            removed -= gone
            links -= name == "a"
            marks -= name in LANDMARKS
            header -= name == "header"
            headings -= name in HEADINGS
            if name not in INLINE:
                block += 1
            if soft and len(stack) < soft:
                soft = 0

    def last(name: str) -> int:
        return place[name][-1] if place.get(name) else -1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:                                     # end tag
            k = last(name)
            if k < 0:
                if name == "p":
                    block += 1
                continue
            shown, was = not removed, soft
            close(k)
            if shown and not removed:
                out.append(("soft end" if was and not soft and name in ("div", "section", "td") else
                            "landmark end" if name in LANDMARKS else KINDS.get(name, "block"),
                            None, block, marks > 0, soft > 0))
            continue
        foreign = min((place[x][0] for x in FOREIGN if place.get(x)), default=None)
        if foreign is not None and name in BREAKOUT and last("foreignobject") < foreign:
            close(foreign)
            foreign = None
        if name in _CLOSES_P or name in _SIBLINGS:
            k = max(map(last, _SIBLINGS.get(name, ("p",))))
            if k >= 0 and k >= (scopes[-1] if scopes else -1):
                close(k)
        if name not in INLINE:
            block += 1
        gone = not removed and _is_removed(name, m[3], marks > 0, marks > 0 or soft > 0)
        closed = _SELF_CLOSED.search(m[3])
        if not removed:
            opens = not gone and not soft and _is_content(name, m[3])
            out.append(("removed" if gone else "soft" if opens else KINDS.get(name, "block"), None, block, marks > 0, soft > 0))
            if name == "br" or name == "img":
                out.append(("words", " ", block, marks > 0, soft > 0))
            if opens:
                soft = len(stack) + 1
        if name in RAW and not (foreign is not None and closed):    # its content is not markup
            end = re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?>", re.I).search(page, at)
            at = end.end() if end else n
            if name not in INLINE:
                block += 1
            continue
        if name in VOID or closed:
            continue
        place.setdefault(name, []).append(len(stack))
        if name in _SCOPE:
            scopes.append(len(stack))
        stack.append((name, bool(gone)))
        removed += bool(gone)
        links += name == "a"
        marks += name in LANDMARKS
        header += name == "header"
        headings += name in HEADINGS
    return out


def labelled(toks: list[tuple]) -> bool:
    """Whether the page marks its content: closed landmark elements, with words."""
    return sum(k == "landmark" for k, *_ in toks) == 2 and any(t and t.strip() and inside for _, t, _, inside in toks)


def kind_of(tok: tuple, has_landmark: bool) -> str:
    """The kind a token is counted and weighed as: words outside the landmarks of a page are
    far ones, markup inside a landmark is inner (its borders are given)."""
    kind, text, _, inside = tok
    if not has_landmark or kind in ("landmark", "soft"):
        return kind
    if text is not None:
        return kind if inside else "far words"
    return "inner" if inside and kind in ("block", "removed", "list", "table", "quote") else kind


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Word kinds: positive, 1 at most; markup kinds: negative, by log odds of the counts
    (inside, outside).  The landmarks' outer edge is never crossed."""
    out = {}
    for kind, (pi, po) in PRIOR.items():
        i, o = counts.get(kind, (0, 0))
        odds = math.log((i + pi + 0.5) / (o + po + 0.5))
        out[kind] = max(0.01, min(1.0, 0.5 * (1 + odds))) if "words" in kind else -max(0.05, min(4.0, 0.3 - odds))
    out["landmark"] = out["soft"] = -1e6
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the run with the largest sum, in one scan; the first and then the
    shortest of equal ones; (0, 0) if no score is positive."""
    best, a, b, run, start = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += x
        if run > best:
            best, a, b = run, start, k + 1
    return a, b


def one_by_run(scores: list[float], toks: list[tuple]) -> None:
    """Markup between two words counts as its worst tag alone, so that a short title is not
    cut off by the many tags behind it; outside content this holds for the tags of text
    (paragraphs, lists, tables, inline), while containers count each."""
    worst = at = None
    for k, t in enumerate(toks):
        if t[1] is not None:
            if t[1].strip():
                worst = at = None
            continue
        if not t[3] and t[0] in ("block", "removed", "border", "page", "landmark", "soft"):
            continue
        if worst is None or scores[k] < worst:
            if at is not None:
                scores[at] = 0.0
            worst, at = scores[k], k
        else:
            scores[k] = 0.0


def main_text(page: str | None, w: dict[str, float]) -> str:
    toks = tokens(page)
    has = any(t[0] in ("landmark", "soft") for t in toks)
    named = has and not any(t[0] == "landmark" for t in toks)
    far = 0.3 if named else w["far words"]           # a container's name is weaker evidence than its element
    scores = [(far if k == "far words" else w[k]) * (len(t[1].split()) if t[1] is not None else 1)
              for t in toks for k in [kind_of(t, has)]]
    one_by_run(scores, toks)
    a, b = best_run(scores)
    blocks: dict[int, list[str]] = {}
    for t in toks[a:b]:
        if t[1] is not None:
            blocks.setdefault(t[2], []).append(t[1])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from every labelled page of the table: counts per task, summed by Spark
    (a row for each of the fixed token kinds)."""
    bounded_batches(pages.sparkSession)

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                toks = tokens(page)
                if not labelled(toks):
                    continue
                for t in toks:
                    n = len(t[1].split()) if t[1] is not None else 1
                    c = seen.setdefault(kind_of(t, True), [0, 0])
                    c[not t[3]] += n
        yield pa.RecordBatch.from_pydict({"kind": list(seen), "inside": [c[0] for c in seen.values()],
                                          "outside": [c[1] for c in seen.values()]},
                                         schema=pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]))

    counted = (pages.select(col(html_col).cast("string").alias("html")).mapInArrow(count, "kind string, inside long, outside long")
               .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    return weights({r["kind"]: (r["inside"], r["outside"]) for r in counted.collect()})


def extract(pages: DataFrame, w: dict[str, float], id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    bounded_batches(pages.sparkSession)
    src = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(p, w) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
