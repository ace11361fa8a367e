"""Pages: HTML, link lists, sitemaps and embedded JSON-LD as structs, and a batch source that fetches.

Parsing is Python (there is no HTML parser in the JVM), in Arrow batches. Malformed input gives an empty
result, never an exception.
"""

from __future__ import annotations

import codecs
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Elements that hold no text, those around the main text, and markers of its neighbours.
SILENT = {"script", "style", "noscript", "template"}
AROUND = {"nav", "aside", "footer"}
BESIDE = re.compile(r"related|recommend|carousel|breadcrumb|site-footer", re.IGNORECASE)
ARTICLES = {"Article", "NewsArticle", "BlogPosting", "PressRelease", "Report"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
CHALLENGE = re.compile(r"verify you are human|captcha|access denied|checking your browser|unusual traffic|enable javascript and cookies", re.IGNORECASE)

PAGE = "struct<title: string, heading: string, text: string, links: array<struct<href: string, anchor: string>>, challenge: boolean>"


class _Events(HTMLParser):
    """A page as a flat list of events: ("open", tag, attributes), ("close", tag) and ("text", data)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("open", tag, dict(attrs)))
        if tag in VOID:
            self.events.append(("close", tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events += [("open", tag, dict(attrs)), ("close", tag)]

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self.events.append(("close", tag))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data))


@dataclass
class Page:
    """What a page says: texts by where they stand, links, embedded JSON-LD, search forms."""

    title: str = ""
    heading: str = ""
    parts: list[str] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    json_ld: list[str] = field(default_factory=list)
    forms: list[tuple[str, str, list[str]]] = field(default_factory=list)


def _is_beside(tag: str, attrs: dict) -> bool:
    return tag in AROUND or bool(BESIDE.search(f"{attrs.get('class') or ''} {attrs.get('id') or ''}"))


def parse(html: str | None) -> Page:
    """Walks the events with how deep it stands in each kind of element; an unclosed element ends with its parent."""
    reader, page = _Events(), Page()
    reader.feed(html or "")
    reader.close()
    path: list[tuple[str, str]] = []  # (tag, role) of the open elements
    depth = Counter()  # open elements by role and by tag
    title, heading, script, anchors = [], [], [], []

    def leave() -> None:
        tag, role = path.pop()
        depth[tag] -= 1
        depth[role] -= 1

    for event in reader.events:
        if event[0] == "open":
            _, tag, attrs = event
            role = "json-ld" if tag == "script" and (attrs.get("type") or "").lower() == "application/ld+json" else "silent" if tag in SILENT else "beside" if _is_beside(tag, attrs) else "plain"
            if role == "json-ld":
                script.append([])
            elif tag == "a" and attrs.get("href"):
                anchors.append((attrs["href"], []))
            elif tag == "form":
                page.forms.append((attrs.get("action") or "", (attrs.get("method") or "get").lower(), []))
            elif tag == "input" and depth["form"] and attrs.get("name"):
                page.forms[-1][2].append(attrs["name"])
            path.append((tag, role))
            depth[tag] += 1
            depth[role] += 1
        elif event[0] == "close":
            if depth[event[1]]:
                while path[-1][0] != event[1]:
                    leave()
                leave()
        elif depth["json-ld"]:
            script[-1].append(event[1])
        elif event[1].strip() and not depth["silent"]:
            if depth["title"]:
                title.append(event[1])
                continue
            if depth["h1"]:
                heading.append(event[1])
            if depth["a"] and anchors:
                anchors[-1][1].append(event[1])
            if not depth["beside"]:
                page.parts.append(" ".join(event[1].split()))
    page.title, page.heading = (" ".join("".join(x).split()) for x in (title, heading))
    page.links = [(href, " ".join(" ".join(said).split())) for href, said in anchors]
    page.json_ld = ["".join(x) for x in script]
    return page


def parsed_page(html: Column) -> Column:
    """Title, first-level heading, main text, links and whether it is an access challenge."""

    @F.pandas_udf(PAGE)
    def page(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            p = parse(t)
            head = " ".join([p.title, p.heading, *p.parts[:30]])
            rows.append((p.title, p.heading, "\n".join(p.parts), [{"href": h, "anchor": a} for h, a in p.links], bool(CHALLENGE.search(head))))
        return pd.DataFrame(rows, columns=["title", "heading", "text", "links", "challenge"])

    return page(html)


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD nodes of a page as JSON texts; scripts that aren't JSON are left out."""

    @F.pandas_udf("array<string>")
    def nodes(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[str]:
            out = []
            for script in parse(t).json_ld:
                try:
                    value = json.loads(script)
                except ValueError:
                    continue
                graph = value.get("@graph", [value]) if isinstance(value, dict) else value
                out += [json.dumps(n, sort_keys=True, ensure_ascii=False) for n in (graph if isinstance(graph, list) else [graph]) if isinstance(n, dict)]
            return out

        return texts.map(of)

    return nodes(html)


def published(html: Column, url: Column) -> Column:
    """Date of publication by the page's own JSON-LD, yyyy-mm-dd; null unless exactly one day is given.

    Only nodes count that are articles and name this page's URL and its heading.
    """

    @F.pandas_udf("string")
    def day(texts: pd.Series, urls: pd.Series) -> pd.Series:
        def of(t: str | None, u: str | None) -> str | None:
            p, days = parse(t), set()
            for script in p.json_ld:
                try:
                    value = json.loads(script)
                except ValueError:
                    continue
                graph = value.get("@graph", [value]) if isinstance(value, dict) else value
                for n in graph if isinstance(graph, list) else []:
                    kinds = n.get("@type") if isinstance(n, dict) else None
                    kinds = {kinds} if isinstance(kinds, str) else set(kinds or ())
                    own = isinstance(n, dict) and " ".join(str(n.get("headline", "")).split()).casefold() == p.heading.casefold() and str(n.get("url") or n.get("mainEntityOfPage") or u) == u
                    if kinds & ARTICLES and own and re.match(r"\d{4}-\d{2}-\d{2}", str(n.get("datePublished", ""))):
                        days.add(n["datePublished"][:10])
            return days.pop() if len(days) == 1 else None

        return pd.Series([of(*x) for x in zip(texts, urls, strict=True)], dtype=object)

    return day(html, url)


def search_url(html: Column, base: Column, field: str, domains: list[str], query: Column) -> Column:
    """The URL that a page's first search form asks for: method get, an input named ``field``, an action on an allowed domain."""

    @F.pandas_udf("string")
    def asked(texts: pd.Series, bases: pd.Series, queries: pd.Series) -> pd.Series:
        from urllib.parse import quote_plus, urlsplit

        def of(t: str | None, b: str | None, q: str | None) -> str | None:
            for action, method, inputs in parse(t).forms if q is not None else []:
                try:
                    url = urljoin(b or "", action)
                    host, scheme = (urlsplit(url).hostname or "").lower(), urlsplit(url).scheme
                except ValueError:
                    continue
                if method == "get" and field in inputs and scheme == "https" and any(host == d or host.endswith("." + d) for d in domains):
                    return f"{url.partition('?')[0].partition('#')[0]}?{field}={quote_plus(q)}"
            return None

        return pd.Series([of(*x) for x in zip(texts, bases, queries, strict=True)], dtype=object)

    return asked(html, base, query)


def sitemap(xml: Column, most_children: int = 8, most_urls: int = 2500, most_bytes: int = 1 << 20) -> Column:
    """Struct (kind, links) of a sitemap: index or urlset. Over a limit, malformed, or with a DOCTYPE or ENTITY it has no links; it is never cut."""

    @F.pandas_udf("struct<kind: string, links: array<string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        from xml.etree import ElementTree

        def of(t: str | None) -> tuple[str | None, list[str]]:
            if not t or len(t.encode("utf-8", "replace")) > most_bytes or re.search(r"<!(?:DOCTYPE|ENTITY)", t, re.IGNORECASE):
                return None, []
            try:
                root = ElementTree.fromstring(t.strip())
            except ElementTree.ParseError:
                return None, []
            kind = {"sitemapindex": "index", "urlset": "urlset"}.get(root.tag.rpartition("}")[2])
            links = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()] if kind else []
            return kind, links if len(links) <= (most_children if kind == "index" else most_urls) else []

        told = [of(t) for t in texts]
        return pd.DataFrame({"kind": [k for k, _ in told], "links": [x for _, x in told]}, dtype=object)

    return read(xml)


def sitemap_links(xml: Column) -> Column:
    """Locations of a sitemap or sitemap index; empty for malformed XML and for any DOCTYPE or ENTITY."""

    @F.pandas_udf("array<string>")
    def links(texts: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def of(t: str | None) -> list[str]:
            if not t or re.search(r"<!(?:DOCTYPE|ENTITY)", t, re.IGNORECASE):
                return []
            try:
                root = ElementTree.fromstring(t.strip())
            except ElementTree.ParseError:
                return []
            return [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()]

        return texts.map(of)

    return links(xml)


def resolved(base: Column, href: Column) -> Column:
    """Absolute URL of a link without fragment; null if it isn't http(s) or can't be resolved."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b: str | None, h: str | None) -> str | None:
            try:
                url = urljoin(b or "", h or "").partition("#")[0]
            except ValueError:
                return None
            return url if url.startswith(("http://", "https://")) else None

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return join(base, href)


def decoded_html(payload: Column, charset: Column) -> Column:
    """Bytes decoded strictly with the declared charset (UTF-8 if none); null on any doubt, U+FFFD included."""

    @F.pandas_udf("string")
    def text(payloads: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(p: bytes | None, c: str | None) -> str | None:
            try:
                t = bytes(p).decode(codecs.lookup(c or "utf-8").name) if p is not None else None
            except (UnicodeDecodeError, LookupError):
                return None
            return None if t is None or "�" in t else t

        return pd.Series([one(p, c) for p, c in zip(payloads, charsets, strict=True)], dtype=object)

    return text(payload, charset)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(urls)
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.domains = [d.lower() for d in options.get("domains", "").split()]
        self.tries, self.timeout, self.most = int(options.get("tries", 3)), float(options.get("timeout", 12)), int(options.get("maxbytes", 8 << 20))
        self.per_task, self.redirects = int(options.get("pertask", 16)), int(options.get("redirects", 5))
        self.types = [t.lower() for t in options.get("types", "").split()]

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)]

    def allowed(self, url: str) -> bool:
        from urllib.parse import urlsplit

        u = urlsplit(url)
        host = (u.hostname or "").lower()
        try:
            port = u.port
        except ValueError:
            return False
        return u.scheme == "https" and not u.username and port in (None, 443) and any(host == d or host.endswith("." + d) for d in self.domains)

    def read(self, partition: _Urls):
        import time
        import urllib.error
        import urllib.request

        class Guard(urllib.request.HTTPRedirectHandler):
            def redirect_request(guard, req, fp, code, msg, headers, newurl):  # noqa: N805
                return super().redirect_request(req, fp, code, msg, headers, newurl) if self.allowed(newurl) else None

        Guard.max_redirections = self.redirects

        opener = urllib.request.build_opener(Guard)
        for url in partition.urls:
            if not self.allowed(url):
                yield url, "REFUSED", None, None, None
                continue
            for attempt in range(self.tries):
                try:
                    with opener.open(url, timeout=self.timeout) as r:
                        body = r.read(self.most + 1)
                        outcome = "TOO_LARGE" if len(body) > self.most else "OTHER_TYPE" if self.types and r.headers.get_content_type() not in self.types else "OK"
                        yield url, outcome, r.status, r.geturl(), bytes(body) if outcome == "OK" else None
                    break
                except urllib.error.HTTPError as e:
                    if (e.code == 429 or e.code >= 500) and attempt + 1 < self.tries:
                        time.sleep((1, 3)[min(attempt, 1)])
                        continue
                    yield url, "UNAVAILABLE" if e.code in (401, 403, 404) else "ERROR", e.code, url, None
                    break
                except (urllib.error.URLError, OSError):
                    if attempt + 1 < self.tries:
                        time.sleep((1, 3)[min(attempt, 1)])
                        continue
                    yield url, "ERROR", None, url, None


class FetchSource(DataSource):
    """``spark.read.format("fetch")`` with options urls, domains, types (blank-separated), tries, timeout, maxBytes, redirects, perTask.

    Only https pages of allowed domains are fetched and redirects may not leave them; 429, 5xx and transport
    errors are tried again. One row for each URL, in partitions of ``perTask`` URLs.
    """

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, outcome string, status int, final_url string, body binary"

    def reader(self, schema) -> FetchReader:
        return FetchReader({k.lower(): v for k, v in self.options.items()})
