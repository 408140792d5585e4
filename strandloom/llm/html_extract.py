"""Main text of HTML pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score
negative.  The weights come from labelled pages: those that mark their own main
content with exactly one ``<article>`` (or else ``<main>``).  Counts of each token
inside and outside of it give log-odds; they are sums over all pages, gathered as a
few numbers per element name of a fixed vocabulary.  A tag that the main content
hardly ever holds must outweigh the longest run of words found outside of it, so
that the scan never crosses it for an advert's sake.  One linear scan (Kadane) then
finds the best contiguous region.

Subtrees that are no article text (scripts, styles, navigation, asides, forms, and
elements whose names say nothing but advert, comments, notice and the like) count as one tag in
the scan and yield no text inside the region.  A name with another word in it (``login-guide``,
``related-work``, ``has-sidebar``) says nothing, and a form or named container that holds an
article, or most of the page's words, is content.  The header of an article, with its title, stays.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?|<[!?][^>]*+>?""", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "iframe", "svg", "math", "title", "textarea", "select")}
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Elements that start or end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never main text.
BOILERPLATE = frozenset("nav aside footer form button dialog menu head object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time u var".split())
#: Words in a class, id or role that mark an element as boilerplate.
_LISTED = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|sidebar|comments?|commentlist|disqus|notices?|cookies?|consent|gdpr|menu|nav|navbar|navigation|breadcrumbs?|"
    r"share|sharing|social|newsletter|subscribe|signup|related|recommended|popup|modal|widgets?|pagination|pager|toolbar|complementary|contentinfo|search|login|"
    r"footer|masthead|disclaimer|copyright", re.I)
#: Words that may stand beside them without another meaning.
_GENERIC = re.compile(
    r"|\d\w*|bar|box|block|list|area|wrap|wrapper|container|inner|outer|section|panel|content|items?|links?|buttons?|icons?|form|message|text|title|header|head|body|"
    r"top|bottom|left|right|main|site|page|global|primary|secondary|mobile|desktop|sticky|fixed|small|large|slot|unit|rail|col|column|row|clearfix|hidden|visible|js|"
    r"is|no|the|and|of|to|posts?|articles?|stories|side|skip|link|responsive|thread|reader|user|privacy|policy|region|module|component|group", re.I)
#: Elements that make a subtree look like an article.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main pre blockquote".split())

VOCABULARY = BLOCKS | BOILERPLATE | VOID | INLINE | set(_RAW_END)
#: Weights until labelled pages are seen.
DEFAULT_WEIGHTS = {"word": 1.0, "tag": -200.0, "div": -3.0, "section": -3.0, "other": -0.5, **{t: -0.01 for t in (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody",
    "thead", "tfoot", "tr", "td", "th", "caption", "col", "figure", "figcaption", "hr", "img", "details", "summary", "hgroup", "address", "center", "wbr", *INLINE)}}


def _says_boilerplate(value: str) -> bool:
    """Whether a class, id or role consists of listed and generic words only, with a listed one among them."""
    parts = re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip()))
    return any(_LISTED.fullmatch(w) for w in parts) and all(_LISTED.fullmatch(w) or _GENERIC.fullmatch(w) for w in parts)


def _named(tag: str, attrs: str, inside: bool) -> str:
    """Why an element looks like a boilerplate subtree: by its "element", its "name", or being "hidden"; empty if it does not."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return "element"
    if attrs and tag not in ("body", "html", "article", "main"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "hidden"
            if name in ("class", "id", "role") and _says_boilerplate(value):
                return "name"
    return ""


class _Subtrees:
    """Sums over the tokens of a page: what lies between two of them."""

    def __init__(self, flat: list[tuple[str, str, str, int, int]]):
        self.words, self.prose, self.roots, self.titles = [0], [0], [0], [0]
        for kind, x, *_ in flat:
            is_open = kind == "open"
            self.words.append(self.words[-1] + (len(x.split()) if kind == "text" else 0))
            self.prose.append(self.prose[-1] + (is_open and x in _PROSE))
            self.roots.append(self.roots[-1] + (is_open and x in ("article", "main")))
            self.titles.append(self.titles[-1] + (is_open and x == "h1"))

    def holds_article(self, tag: str, why: str, i: int, j: int) -> bool:
        """Whether a suspected subtree is the page's content all the same: it holds an article, or most words of the
        page and prose (a form around the page) or its title (a container whose name misleads)."""
        if why == "hidden" or tag in BOILERPLATE - {"form", "aside"}:
            return False
        if self.roots[j] > self.roots[i]:
            return True
        most = 2 * (self.words[j] - self.words[i]) > self.words[-1]
        return most and (self.prose[j] > self.prose[i] if tag == "form" else self.titles[j] > self.titles[i])


def tokens(page: str) -> list[tuple[str, str, int]]:
    """(kind, payload, depth in article/main) in page order.

    Kinds: ``text`` (raw characters), ``open``/``close`` (element name), ``skip`` (a whole
    boilerplate subtree; its text is the payload).  A boilerplate element that is never closed
    skips its tag only.
    """
    flat: list[tuple[str, str, str, int, int]] = []
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            flat.append(("text", page[pos:], "", pos, n))
            break
        if m.start() > pos:
            flat.append(("text", page[pos:m.start()], "", pos, m.start()))
        pos = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                flat.append(("close", tag, "", m.start(), pos))
            elif tag in _RAW_END and not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, pos)
                pos = end.end() if end else n
                flat.append(("skip", tag, "", m.start(), pos))
            else:
                flat.append(("open", tag, m[3], m.start(), pos))
    closers: dict[str, list[tuple[int, int]]] = defaultdict(list)  # element -> (index, +1/-1)
    for i, (kind, tag, attrs, _, _) in enumerate(flat):
        if kind == "open" and tag not in VOID and not attrs.endswith("/"):
            closers[tag].append((i, 1))
        elif kind == "close":
            closers[tag].append((i, -1))
    match: dict[int, int] = {}
    for events in closers.values():
        stack: list[int] = []
        for i, d in events:
            if d > 0:
                stack.append(i)
            elif stack:
                match[stack.pop()] = i
    out, i, depth = [], 0, 0
    sums = _Subtrees(flat)
    while i < len(flat):
        kind, x, attrs, _, _ = flat[i]
        if kind in ("open", "close") and x in ("article", "main"):
            depth = max(0, depth + (1 if kind == "open" else -1))
            out.append((kind, x, depth if kind == "close" else depth - 1))
        elif kind == "open" and i in match and (why := _named(x, attrs, depth > 0)) and not sums.holds_article(x, why, i, match[i]):
            out.append(("skip", x + "\0" + " ".join(t for k, t, *_ in flat[i:match[i]] if k == "text"), depth))
            i = match[i]
        else:
            out.append((kind, x, depth))
        i += 1
    return out


def _class(kind: str, x: str) -> str:
    tag = x.split("\0", 1)[0] if kind == "skip" else x
    return ("skip:" if kind == "skip" else "") + (tag if tag in VOCABULARY else "other")


def count_page(page: str, counts: dict[str, list[float]]) -> None:
    """Add a labelled page's [inside, outside, longest outside run] per token class."""
    toks = tokens(page)
    if sum(k == "open" and x in ("article", "main") for k, x, _ in toks) != 1:
        return
    for kind, x, depth in toks:
        if kind == "text":
            n, key = len(x.split()), "word"
        elif kind == "skip":
            n, key = 1, _class(kind, x)
            run = len(x.split("\0", 1)[1].split()) if "\0" in x else 0
            counts["word"][2] = max(counts["word"][2], run)
        else:
            n, key = 1, _class(kind, x)
        if n:
            row = counts[key]
            row[0 if depth > 0 else 1] += n
            if kind == "text" and depth == 0:
                row[2] = max(row[2], n)


def weights_from(counts: dict[str, tuple[float, float, float]]) -> dict[str, float]:
    """Token weights: log-odds of inside against outside; words at least 1, tags at most -0.01.

    Words are compared with tags, and tags among themselves, so that long articles do not make every tag look rare.
    """
    if not counts or "word" not in counts or not counts["word"][0]:
        return dict(DEFAULT_WEIGHTS)
    tags = {k: c for k, c in counts.items() if k != "word"}
    t_in, t_out = (sum(c[i] for c in tags.values()) + len(tags) + 1 for i in (0, 1))
    odds = {k: math.log((c[0] + 1) / t_in) - math.log((c[1] + 1) / t_out) for k, c in tags.items()}
    w_in, w_out = counts["word"][0] + 1, counts["word"][1] + 1
    word = max(1.0, math.log(w_in / (w_in + t_in)) - math.log(w_out / (w_out + t_out)))
    wall = word * (counts["word"][2] + 1)
    out = {**DEFAULT_WEIGHTS, "word": word, "tag": -wall}
    for k, c in counts.items():
        if k.startswith("skip:"):
            # its words are no tokens, so that crossing it gains nothing but what stands behind it
            out[k] = max(-2 * word, min(-0.01, odds[k]))
        elif k != "word":
            rare = c[0] < 0.001 * (c[0] + c[1])
            out[k] = -wall - abs(odds[k]) if rare else min(-0.01, odds[k])
    return out


def best_region(toks: list[tuple[str, str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the first contiguous region with the largest positive score; (0, 0) if none."""
    best, span, score, start = 0.0, (0, 0), 0.0, 0
    word, other = weights["word"], weights["tag"]
    for i, (kind, x, _) in enumerate(toks):
        if kind == "text":
            w = word * len(x.split())
        else:
            w = weights.get(_class(kind, x), -word if kind == "skip" else other)
            if kind == "skip" and x.split("\0", 1)[0] in _RAW_END:
                w = -0.01
        if score <= 0:
            score, start = 0.0, i
        score += w
        if score > best:
            best, span = score, (start, i + 1)
    return span


def blocks(toks: list[tuple[str, str, int]]) -> list[str]:
    """Texts of the blocks in page order, references decoded and white space folded."""
    out: list[str] = []
    parts: list[str] = []
    def flush() -> None:
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()
    for kind, x, _ in toks:
        if kind == "text":
            parts.append(x)
        elif kind == "skip":
            if x.split("\0", 1)[0] not in INLINE:
                flush()
        elif x == "br" or x == "wbr":
            parts.append("\n" if x == "br" else "")
        elif x in BLOCKS or x not in INLINE and x not in VOID:
            flush()
    flush()
    return out


def extract(page: str | None, weights: dict[str, float] = DEFAULT_WEIGHTS) -> str:
    """Main text of one page; empty for null or a page without words."""
    if not page:
        return ""
    toks = tokens(page)
    i, j = best_region(toks, weights)
    return "\n\n".join(blocks(toks[i:j]))


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages.  What reaches the driver is one row per class of a fixed vocabulary."""
    small_batches(pages.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        acc: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for b in batches:
            for page in b.column(0):
                p = page.as_py()
                if p:
                    count_page(p, acc)
        rows = [(k, *v) for k, v in acc.items()]
        yield pa.RecordBatch.from_pydict({
            "token": pa.array([r[0] for r in rows], pa.string()),
            **{c: pa.array([r[i + 1] for r in rows], pa.float64()) for i, c in enumerate(("inside", "outside", "run"))}})

    counted = (pages.select(F.col(f"`{html_col}`").cast("string").alias("html"))
               .mapInArrow(count, "token string, inside double, outside double, run double")
               .groupBy("token").agg(F.sum("inside"), F.sum("outside"), F.max("run")))
    return weights_from({r[0]: (r[1], r[2], r[3]) for r in counted.collect()})


def extract_pages(pages: DataFrame, html_col: str = "html", *, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows and columns of ``pages`` without ``html``, plus ``text`` and ``n_chars`` (its code points).

    Null or empty html, and pages without a word, give an empty text.  Long pages are read whole.
    Repeated rows give repeated results.  Input columns named ``text`` or ``n_chars`` are replaced.
    An empty table gives an empty result (the default weights are then unused).
    """
    small_batches(pages.sparkSession)
    own = learn_weights(pages, html_col) if weights is None else weights
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    x = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("text"))
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*x.schema.fields, StructField("n_chars", LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [extract(v.as_py(), own) for v in b.column(b.num_columns - 1)]
            cols = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n_chars"])

    return x.mapInArrow(run, schema)
