"""Posting extraction from stored pages.

S8 runs Python inside tasks, as HTML needs a real parser: a ``mapInArrow``
over the pages table whose only work is to gather the texts of a profile's
selectors (standard-library ``html.parser``; the profile is chosen per row by
host).  What becomes of the texts (defaults, trimming, salary text, positional
facts, provenance) is native column expressions.  S9 (link discovery) is pure
column expressions.
"""

from __future__ import annotations

import datetime as dt
import re
from html import unescape
from html.parser import HTMLParser
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import offers_text, positional_fields, salary_text, sentinel_default, trim_join
from ..operators.shaping import with_provenance


class Pick(NamedTuple):
    """A selector: elements matching the last step inside elements matching
    the steps before (any depth).  A step is ``tag`` or ``tag[attr=token]``,
    ``*`` being any tag.  ``deep`` takes all text below a match, else only its
    own."""

    path: str
    deep: bool = False


# Selectors of each page shape, by the name of what they gather.
PROFILES: dict[str, dict[str, Pick]] = {
    # every fact in an element that names it
    "labelled": {
        "job_title": Pick("h1[data-field=title]"), "employer_name": Pick("h2[data-field=employer]"),
        "location": Pick("div[data-field=place]"), "expiration": Pick("li[data-field=until] div[class=value]"),
        "contract_type": Pick("li[data-field=contract] div[class=value]"),
        "experience_level": Pick("li[data-field=level] div[class=value]"),
        "hybryd_full_remote": Pick("li[data-field=mode] div[class=value]"),
        "salary_range": Pick("div[data-field=amount]"), "salary_currency": Pick("div[data-field=currency]"),
        "salary_kind": Pick("div[data-field=kind]"), "technologies": Pick("section[data-field=stack] li p"),
        "responsibilities": Pick("section[data-field=tasks] li"), "requirements": Pick("section[data-field=needs] li"),
        "offering": Pick("section[data-field=offer] li"), "benefits": Pick("ul[data-field=perks] div[class=title]"),
    },
    # sections whose text may lie at any depth
    "sectioned": {
        "job_title": Pick("h1[id=offer]", True), "employer_name": Pick("a[class=company]"), "location": Pick("div[id=address]"),
        "expiration": Pick("div[id=expires]"), "contract_type": Pick("div[id=pay] p[class=contract]"),
        "experience_level": Pick("div[id=levels] span"), "hybryd_full_remote": Pick("div[id=modes] span"),
        "salary_range": Pick("div[id=pay] p[class=amount]"), "salary_kind": Pick("div[id=pay] p[class=unit]"),
        "technologies": Pick("div[class=chip] span"), "responsibilities": Pick("div[id=tasks] li", True),
        "requirements": Pick("div[id=needs] li", True), "offering": Pick("div[id=offering] li", True),
        "benefits": Pick("div[id=perks] li", True),
    },
    # unnamed facts in a fixed order, several offers
    "ordered": {
        "job_title": Pick("aside p[class=name]"), "employer_name": Pick("aside p[class=firm]"), "facts": Pick("p[class=fact]"),
        "offer_amounts": Pick("aside div[class=offer] p[class=amount]"), "offer_kinds": Pick("aside div[class=offer] p[class=kind]"),
        "responsibilities": Pick("section[id=first] ul li"), "offering": Pick("section[id=second] ul li"),
        "requirements": Pick("section[id=third] ul li"), "benefits": Pick("ul[class=perks] li"),
    },
    # any other page: headline, title, paragraphs, lists
    "article": {
        "job_title": Pick("h1", True), "employer_name": Pick("title"), "responsibilities": Pick("article p", True),
        "benefits": Pick("nav li", True), "offering": Pick("div[class=ad]"), "links_text": Pick("a", True),
    },
}
HOST_PROFILES: list[tuple[str, str]] = [("labelled.", "labelled"), ("sectioned.", "sectioned"), ("ordered.", "ordered"), ("", "article")]

LISTS = ("technologies", "responsibilities", "requirements", "offering", "benefits", "links_text")
FIELDS = ("job_title", "employer_name", "location", "expiration", "contract_type", "experience_level", "hybryd_full_remote")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_IMPLICIT = {"p", "li"}  # a new one closes an open one of the same name


def _steps(path: str) -> list[tuple[str, str, str]]:
    out = []
    for part in path.split():
        tag, _, rest = part.partition("[")
        attr, _, token = rest.rstrip("]").partition("=")
        out.append((tag, attr, token))
    return out


class _Step(NamedTuple):
    """What a start tag does below an element: steps done of each selector, the
    selectors whose match feeds its own text, those it feeds at any depth."""

    done: tuple[int, ...]
    own: tuple[int, ...]
    deep: tuple[int, ...]


class _Tag(HTMLParser):
    """Reads one tag by itself, to know it again by its text."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []
        self.feed(text)
        self.plain = len(self.seen) == 1 and not self.rawdata and self.cdata_elem is None and self.seen[0][1] not in _RAW

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.seen.append(("both", tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag, ()))

    def handle_data(self, data):
        self.seen.append(("data", data, ()))


#: Elements whose content is not markup (in some versions of the parser).
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
#: A tag with balanced quotes, and the text up to the next one.
_TAG = re.compile(r"""(</?[a-zA-Z][^<>"'&]*+(?:"[^"<>]*+"[^<>"'&]*+|'[^'<>]*+'[^<>"'&]*+)*+>)([^<]*+)""")
#: What sends a page to the parser at once.
_OTHER = re.compile("<(?:[!?]|(?:" + "|".join(sorted(_RAW)) + ")[^a-z0-9])", re.IGNORECASE)
#: Tags and steps remembered per profile; tags that differ on every page do not pile up.
_KEPT = 4096


class _Profile:
    """A profile's selectors with the tags and steps met so far: pages repeat
    them, so each is worked out once and not once for every element."""

    def __init__(self, profile: dict[str, Pick]):
        self.names = list(profile)
        self.picks = [(_steps(p.path), p.deep) for p in profile.values()]
        self.tags: dict[str, tuple | None] = {}
        self.steps: dict[tuple, _Step] = {}

    def tag(self, text: str) -> tuple | None:
        """(kind, name, attributes) of a tag's text; None if it cannot be read by itself."""
        if text in self.tags:
            return self.tags[text]
        read = _Tag(text)
        found = None
        if read.plain:
            kind, name, attrs = read.seen[0]
            found = (kind, name, _values(attrs))
        if len(self.tags) >= _KEPT:
            self.tags.clear()
        self.tags[text] = found
        return found

    def step(self, done: tuple[int, ...], tag: str, values: tuple) -> _Step:
        key = (done, tag, values)
        if key in self.steps:
            return self.steps[key]
        now, own, deep, tokens = list(done), [], [], dict(values)
        for i, (steps, whole) in enumerate(self.picks):
            want, attr, token = steps[done[i]]
            if want in (tag, "*") and (not attr or token in tokens.get(attr, ())):
                if done[i] < len(steps) - 1:
                    now[i] += 1
                else:
                    (deep if whole else own).append(i)
        if len(self.steps) >= _KEPT:
            self.steps.clear()
        found = self.steps[key] = _Step(tuple(now), tuple(own), tuple(deep))
        return found


def _values(attrs) -> tuple:
    return tuple((k, tuple((v or "").split())) for k, v in attrs)


class _Collector(HTMLParser):
    """Texts of the elements that match a profile's selectors."""

    def __init__(self, profile: _Profile):
        super().__init__(convert_charrefs=True)
        self.profile = profile
        # open element: tag, steps done of each selector, texts it feeds directly, texts it feeds at any depth
        self.stack: list[tuple[str, tuple[int, ...], list, list]] = [("", (0,) * len(profile.picks), [], [])]
        self.texts: list[list[list[str]]] = [[] for _ in profile.names]

    def read(self, html: str) -> None:
        """The page, tag by tag where each can be read by itself; else by the parser."""
        at, known = html.find("<"), self.profile.tag
        if at < 0:
            return  # text outside all elements feeds nothing
        if _OTHER.search(html, at):
            self.feed(html)
            self.close()
            return
        pieces, match = [], _TAG.match
        while m := match(html, at):
            text, after = m.groups()
            tag = known(text)
            if tag is None:
                break
            pieces.append((tag, after))
            at = m.end()
        if at < len(html):
            self.feed(html)
            self.close()
            return
        for (kind, name, values), text in pieces:
            if kind != "end":
                self.open(name, values)
            if kind != "start":
                self.handle_endtag(name)
            if text:
                self.handle_data(unescape(text) if "&" in text else text)

    def open(self, tag: str, values: tuple) -> None:
        if tag in _VOID:
            return
        stack = self.stack
        if tag in _IMPLICIT:
            self.handle_endtag(tag)
        _, done, _, deep = stack[-1]
        step = self.profile.step(done, tag, values)
        own = []
        for i in step.own:
            text: list[str] = []
            self.texts[i].append(text)
            own.append(text)
        if step.deep:
            deep = list(deep)
            for i in step.deep:
                text = []
                self.texts[i].append(text)
                deep.append(text)
        stack.append((tag, step.done, own, deep))

    def handle_starttag(self, tag, attrs):
        self.open(tag, _values(attrs))

    def handle_endtag(self, tag):
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    def handle_data(self, data):
        _, _, own, deep = self.stack[-1]
        for text in own:
            text.append(data)
        for text in deep:
            text.append(data)


#: Profiles in use; a plain dict, as a cached function would not be shipped by value.
_MET: dict[str, _Profile] = {}


def _profile(name: str) -> _Profile:
    if name not in _MET:
        _MET[name] = _Profile(PROFILES[name])
    return _MET[name]


def profile_for(url: str | None) -> str:
    host = (url or "").split("//", 1)[-1].split("/", 1)[0]
    return next(name for needle, name in HOST_PROFILES if needle in host)


def gather(url: str | None, html: str | None) -> tuple[str, dict[str, list[str]]]:
    """The profile of a page and the texts of its selectors, in page order."""
    name = profile_for(url)
    collector = _Collector(_profile(name))
    collector.read(html or "")
    return name, {field: ["".join(x) for x in texts] for field, texts in zip(collector.profile.names, collector.texts)}


_FOUND = pa.map_(pa.string(), pa.list_(pa.string()))


def _gather_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gather(u, h) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array([n for n, _ in found], pa.string()),
                               pa.array([[*t.items()] for _, t in found], _FOUND)], ["page_id", "url", "profile", "found"])


def _texts(name: str) -> Column:
    return F.coalesce(F.element_at("found", F.lit(name)), F.array().cast("array<string>"))


def _first(name: str) -> Column:
    return F.regexp_replace(F.get(_texts(name), 0), r"(?U)^\s+|\s+$", "")


def page_fields(pages: DataFrame, as_of: dt.date | str = "2024-01-02", source: str = "pages") -> DataFrame:
    """One posting-shaped row per page: first matches, lists trimmed
    and joined by ``;`` (P13), ``N/A`` where nothing matches (P12), salary
    text of its parts or of several offers (C26), positional facts (C29),
    posting date and upload id (P14).  No shuffle."""
    found = pages.select("page_id", "url", "html").mapInArrow(
        _gather_batches, "page_id long, url string, profile string, found map<string, array<string>>")
    facts = positional_fields(F.transform(_texts("facts"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    ordered = F.col("profile") == "ordered"
    amounts, kinds = _texts("offer_amounts"), _texts("offer_kinds")
    pairs = F.transform(amounts, lambda x, i: F.coalesce(F.get(kinds, i), F.lit("N/A")))
    salary = (F.when(ordered & (F.size(amounts) > 0), offers_text(F.transform(amounts, lambda x: F.trim(x)), F.transform(pairs, lambda x: F.trim(x))))
              .when(~ordered, salary_text(_first("salary_range"), _first("salary_currency"), _first("salary_kind"))))
    single = {c: _first(c) for c in FIELDS}
    for c in ("location", "expiration", "contract_type", "experience_level"):
        single[c] = F.when(ordered, facts[c]).otherwise(single[c])
    lists = {c: trim_join(F.filter(_texts(c), lambda x: F.trim(x) != "")) for c in LISTS}
    out = found.select("page_id", "url", "profile", *[sentinel_default(v).alias(c) for c, v in {**single, "salary": salary, **lists}.items()])
    return with_provenance(out, as_of, source)


ORIGIN_PATTERN = r"^(https?://[^/?#]+)"


def page_links(pages: DataFrame, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """Every anchor target matching ``pattern`` (group 1), made absolute
    like a URL join (scheme-relative, root-relative, path-relative), distinct
    per page."""
    origin = F.regexp_extract("url", ORIGIN_PATTERN, 1)
    base_dir = F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
    raw = pages.select("page_id", origin.alias("_origin"), base_dir.alias("_dir"),
                       F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("_href"))
    absolute = (F.when(F.col("_href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("_href"))
                .when(F.col("_href").startswith("//"), F.concat(F.regexp_extract("_origin", "^([a-z]+:)", 1),
                                                               F.col("_href")))
                .when(F.col("_href").startswith("/"), F.concat("_origin", "_href"))
                .when(F.col("_dir").rlike("^https?://[^/]+/"), F.concat("_dir", "_href"))
                .otherwise(F.concat("_origin", F.lit("/"), "_href")))
    return raw.select("page_id", absolute.alias("link")).distinct()
