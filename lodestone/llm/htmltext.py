"""Main text of HTML pages by a maximum-scoring run of words and tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.labelledpages import PAGES

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select option button textarea".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
MAIN = frozenset(("article", "main"))
SELF_CLOSING = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))?")
_END = re.compile(r"[\s/]*(>|\Z)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    """An element of a page: its features, and once weighed whether its words are noise and lie in the marked article."""

    __slots__ = ("name", "parent", "features", "noise", "inside", "words")

    def __init__(self, name: str, parent: Element | None, features: tuple[str, ...] = ()):
        self.name, self.parent, self.features = name, parent, features
        self.noise = self.inside = False
        self.words = 0


@lru_cache(maxsize=4096)
def features_of(name: str, attributes: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """The element's name and the parts of words in its class, id, role and label; html and body have none."""
    if name in ("html", "body"):
        return ()
    found = [name]
    for key, value in attributes:
        if key in ("class", "id", "role", "aria-label"):
            found += ["." + p.lower() for p in _PART.findall(value)]
        elif (key == "hidden" and value.lower() != "until-found") or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            found.append("(hidden)")
    return tuple(dict.fromkeys(found))


_TOLD = frozenset(("class", "id", "role", "aria-label", "hidden", "aria-hidden", "style"))


def read_page(html: str) -> tuple[list[Element], list[tuple[Element, str | None, str]]]:
    """The elements of a page, parents first, and its text pieces and tags in page order: (element, text or None, tag).

    Attributes go by the rules of HTML: a quote opens a value only where the
    value begins. End tags without a start tag change nothing; unclosed
    elements end with the element around them. Time and memory grow with the
    length of the page, however deep it is nested.
    """
    top = here = Element("", None)
    elements, pieces = [top], []
    opened: dict[str, int] = {}
    at, n = 0, len(html)

    def text(a: int, b: int) -> None:
        if b > a:
            pieces.append((here, html[a:b], ""))

    def close(name: str) -> None:
        nonlocal here
        while here.name != name:
            opened[here.name] -= 1
            here = here.parent
        opened[name] -= 1
        here = here.parent

    begun = 0  # where the text not yet taken begins
    while at < n:
        at = html.find("<", at)
        if at < 0:
            break
        kind = html[at + 1 : at + 2]
        if not (kind.isalpha() and kind.isascii()) and kind not in ("/", "!", "?"):
            at += 1
            continue
        if kind == "/" and not _NAME.match(html, at + 2):
            at += 1
            continue
        text(begun, at)
        if kind in ("!", "?"):
            ending = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            stop = html.find(ending, at + (4 if ending == "-->" else 2))
            begun = at = n if stop < 0 else stop + len(ending)
            continue
        if kind == "/":
            name = _NAME.match(html, at + 2)[0].lower()
            stop = html.find(">", at)
            begun = at = n if stop < 0 else stop + 1
            pieces.append((here, None, "/" + name))
            if opened.get(name):
                close(name)
            continue
        named = _NAME.match(html, at + 1)
        name, at = named[0].lower(), named.end()
        told = []
        while not (ended := _END.match(html, at)):
            attribute = _ATTR.match(html, at)
            key, at = attribute[1].lower(), attribute.end()
            if key in _TOLD:
                value = attribute[2] or ""
                told.append((key, unescape(value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value)))
        closed = html.startswith("/", ended.end() - 2)
        begun = at = ended.end()
        for other in SELF_CLOSING.get(name, ()):
            if here.name == other:
                close(other)
        if name in VOID:
            pieces.append((here, None, name))
            continue
        inside = Element(name, here, features_of(name, tuple(told)))
        elements.append(inside)
        pieces.append((inside, None, name))
        if closed and name in ("svg", "path", "iframe"):
            continue
        here = inside
        opened[name] = opened.get(name, 0) + 1
        if name in RAW:
            raw_end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            text(at, raw_end.start() if raw_end else n)
            begun = at = raw_end.end() if raw_end else n
            close(name)
    text(begun, n)
    return elements, pieces


# --- weights ---------------------------------------------------------------

#: Mean log odds of an element's features under which its words are noise.
NOISE = -1.0
#: Features whose log odds are this near to none say nothing.
NEUTRAL = 0.5
#: The score of a tag is never above this.
LEAST = -0.02


@dataclass
class Weights:
    """What is learnt from labelled pages: log odds of a feature's elements to hold content, names that never do, and scores of words and tags."""

    feature: dict[str, float]
    never: frozenset[str]
    token: dict[tuple[str, str], float]
    other: dict[str, float]

    def own_noise(self, e: Element, words: int) -> bool:
        """Whether an element's features speak against its words: its name, or what its class and id say on average.

        Parts of a class that are in no labelled page count as saying nothing,
        but they count, so that a class is judged as a whole. An element whose
        class also has such parts, or parts of content, is no noise if more
        than half of the page's words are in it.
        """
        if not e.features:
            return False
        if e.name in SILENT or e.name in self.never or "(hidden)" in e.features:
            return True
        told = [self.feature.get(f) for f in e.features[1:]]
        against = [x for x in told if x is not None and x <= -NEUTRAL]
        unseen = sum(x is None for x in told)
        if not against or sum(against) / (len(against) + unseen) >= NOISE:
            return False
        mixed = unseen or any(x >= NEUTRAL for x in told if x is not None)
        return not (mixed and 2 * e.words > words)

    def score(self, place: str, kind: str) -> float:
        """The score of a kind of word or tag; unseen tags weigh what is learnt of them together, in a marked article least."""
        return self.token.get((place, kind), LEAST if kind.endswith("+") else self.other[place])


def odds(content: float, other: float) -> float:
    return log((content + 0.25) / (other + 0.25))


def place_of(elements: list[Element], weights: Weights) -> str:
    """Weighs the elements of a page and says whether it marks its article ("marked") or not ("plain").

    An element is noise if it is itself or lies in noise. The article is
    marked by article elements outside noise, or by main elements. If all of
    those lie in what looks like noise, the elements around the longest one
    are no noise.
    """
    for e in reversed(elements[1:]):
        if e.name not in SILENT:
            e.parent.words += e.words
    words = elements[0].words

    def spread(spared: frozenset[int]) -> list[Element]:
        for e in elements[1:]:
            e.noise = e.parent.noise or (id(e) not in spared and weights.own_noise(e, words))
        return [e for e in elements if e.name in MAIN and not e.noise]

    marks = spread(frozenset())
    if not marks:
        best = max((e for e in elements if e.name in MAIN and not weights.own_noise(e, words)), key=lambda e: e.words, default=None)
        if best is not None and best.words:
            around, probe = [], best
            while probe is not None:
                if probe.name not in SILENT:
                    around.append(id(probe))
                probe = probe.parent
            marks = spread(frozenset(around))
    articles = {id(e) for e in marks if e.name == "article"} or {id(e) for e in marks}
    for e in elements[1:]:
        e.inside = e.parent.inside or id(e) in articles
    return "marked" if articles else "plain"


def kind_of(e: Element, tag: str, place: str) -> str:
    """What the score of a word or tag goes by: its place in pages that mark their article, a tag's name, whether a word is a link."""
    if tag:
        return tag + "+" if e.inside else tag
    return ("(inside)" if e.inside else "(outside)") if place == "marked" else "(linked)" if e.name == "a" else "(word)"


def counted_words(elements: list[Element], pieces: list[tuple[Element, str | None, str]]) -> list[int]:
    """The words of each piece, which its element gets too."""
    sized = [len(t.split()) if t is not None else 0 for _, t, _ in pieces]
    for (e, _, _), k in zip(pieces, sized, strict=True):
        e.words += k
    return sized


@lru_cache(maxsize=1)
def learnt() -> Weights:
    """Weights from the labelled pages.

    An element counts for its features by the share of its words that are
    content. The score of a word or tag is the log of how much more often its
    kind occurs in content than elsewhere, for pages with and without an
    element that marks the article; a tag's is never above LEAST.
    """
    weights = Weights({}, frozenset(), {}, {})
    read = []
    shares: dict[str, list[float]] = {}
    for page in PAGES:
        elements, pieces = read_page(page.replace("{{", "<wbr>").replace("}}", "<wbr>"))
        sized, content, labels = counted_words(elements, pieces), False, []
        for _, _, tag in pieces:
            content ^= tag == "wbr"
            labels.append(content)
        read.append((elements, pieces, sized, labels))
        said = {id(e): [0, 0] for e in elements}
        for (e, _, _), k, label in zip(pieces, sized, labels, strict=True):
            said[id(e)][label] += k
        for e in reversed(elements[1:]):
            for k in (0, 1):
                said[id(e.parent)][k] += said[id(e)][k]
        for e in elements:
            if sum(said[id(e)]):
                share = said[id(e)][1] / sum(said[id(e)])
                for f in e.features:
                    both = shares.setdefault(f, [0.0, 0.0])
                    both[0] += 1 - share
                    both[1] += share
    weights.feature.update((f, odds(c, b)) for f, (b, c) in shares.items())
    weights.never = frozenset(f for f, (_, c) in shares.items() if c == 0 and not f.startswith(".") and f not in INLINE)
    counts: dict[str, dict[str, list[int]]] = {"marked": {}, "plain": {}}
    for elements, pieces, sized, labels in read:
        place = place_of(elements, weights)
        for (e, _, tag), k, label in zip(pieces, sized, labels, strict=True):
            if e.name not in SILENT and tag != "wbr":
                counts[place].setdefault(kind_of(e, tag, place), [0, 0])[label] += 1 if tag else k
    for place, kinds in counts.items():
        whole = [sum(k[i] for k in kinds.values()) for i in (0, 1)]
        score = lambda b, c: log((c + 0.5) / whole[1]) - log((b + 0.5) / whole[0])  # noqa: E731, B023
        weights.token.update(((place, k), score(b, c) if k.startswith("(") else min(LEAST, score(b, c))) for k, (b, c) in kinds.items())
        weights.other[place] = min(LEAST, score(0, 0))
    return weights


def extract(html: str | None) -> str:
    """The main text of a page; empty for a null or empty page and where nothing scores above zero.

    Words in elements that are learnt to hold no article count nothing and
    are left out. Every other word and tag has a weight; a linear scan finds
    the run with the greatest sum, the earliest of equal ones, and the words
    of that run are the text.
    """
    if not html:
        return ""
    weights = learnt()
    elements, pieces = read_page(html)
    sized = counted_words(elements, pieces)
    place = place_of(elements, weights)
    low = start = best_from = best_to = 0
    total = best = 0.0
    for k, (e, _, tag) in enumerate(pieces):
        if not e.noise and (tag or sized[k]):
            total += (1 if tag else sized[k]) * weights.score(place, kind_of(e, tag, place))
        if total < low or (total <= low and k == start):
            low, start = total, k + 1
        if total - low > best:
            best, best_from, best_to = total - low, start, k + 1
    out = []
    for e, t, tag in pieces[best_from:best_to]:
        if t is None:
            if tag.lstrip("/") not in INLINE:
                out.append(" ")
        elif e.noise:
            out.append(" ")
        else:
            out.append(unescape(t) if "&" in t else t)
    return " ".join("".join(out).split())


def main_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in pages], dtype="object")

    return run(html.cast("string"))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of html_col.

    Null and empty pages give an empty text of 0 code points. Columns of pages
    named text or n_chars are replaced, all others stay; repeated rows stay
    repeated, and an empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    done = pages.select(*keep, main_text(F.col(html_col)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
