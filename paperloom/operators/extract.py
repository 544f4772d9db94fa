"""HTML pages to Markdown, title, headings, code, breadcrumb and meta data.

One narrow Arrow pass: pages are independent and parsing can't be a Column expression. What regular expressions can
say (title, headings, code blocks of Markdown) also exists in the JVM, in functions.text and below.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ensure_importable
from .dom import Node, parse

_DROP = "nav, header, footer, aside, script, style, noscript, iframe, .toc, .ad, .ads, .advertisement, .sidebar, .side-bar, .table-of-contents, .breadcrumb, .breadcrumbs, .cookie-banner, .cookie-consent, #cookie-banner"
_MAIN = 'main; article; [role="main"]'.split("; ")
_LIKELY = ".bd-content, .doc-content, .document, .documentation, .markdown-body, .md-content, .rst-content, #content, #docContent"
_CALLOUTS = [(f".admonition.{x}, .admonition-{x}, .theme-admonition-{x}" + f", div.{x}" * (x in ("danger", "info", "note", "tip", "warning")), x.title()) for x in ("note", "warning", "tip", "important", "caution", "danger", "info")]
_CALLOUTS.append((".md-typeset .admonition, .rst-content .admonition", "Note"))
_CALLOUT_TITLE = ".admonition-title, .admonition-heading, .theme-admonition-heading"
_HINTS = [("sql", r"\bselect\b|\binsert\b|\bcreate (?:table|index)\b"), ("python", r"\bdef \w+\("), ("javascript", r"\b(?:function|const|import)\b"), ("go", r"\b(?:package main\b|func \w+\()"), ("bash", r"\b(?:curl|wget|(?:pip|npm) install|kubectl|docker)\b")]
SCHEMA = "title string, markdown string, headings array<string>, code_blocks array<struct<language:string,content:string>>, breadcrumb array<string>, raw_metadata map<string,string>"


def _flat(text: str) -> str:
    return " ".join(text.split())


def code_language(text: str) -> str | None:
    return next((name for name, pattern in _HINTS if re.search(pattern, text, re.I)), None)


def class_language(css: str) -> str | None:
    found = re.search(r"language-([-.#+\w]+)", css, re.I) or re.search(r"highlight-(\w+)", css, re.I)
    return found[1].lower() if found else None


def density(x: Node) -> float:
    """Characters of text by tags, links counting three times."""
    inner = [y for y in x.walk() if y.tag]
    links = sum(y.tag == "a" for y in inner)
    return len(x.content().strip()) / (1 + len(inner) + 2 * max(1, links))


def main_content(root: Node, selectors: dict[str, str]) -> tuple[Node, str]:
    """The part of a page that holds its text, and how it was found."""
    tries = [(s, f"registry:{s}") for s in [selectors.get("main_content")] if s] + [(s, f"semantic:{s}") for s in _MAIN]
    for selector, method in tries:
        if found := root.select(selector):
            return found[0], method
    likely = [x for x in root.select(_LIKELY) if density(x) > 0]
    if likely:
        return max(likely, key=density), "heuristic"
    parents = {id(p.parent): p.parent for p in root.select("p") if p.parent is not None and p.parent.tag != "html" and len(p.content()) >= 25}
    if parents:
        return max(parents.values(), key=lambda x: sum(len(p.content()) for p in x.children if p.tag == "p")), "readability"
    body = root.select("body")
    return (body[0] if body else root), "body_fallback"


def _callouts(content: Node) -> None:
    for selector, default in _CALLOUTS:
        for x in content.select(selector):
            if x.parent is None or x.tag == "blockquote":
                continue
            titles = x.select(_CALLOUT_TITLE)
            label = (titles[0].content().strip() if titles else "") or default
            if label == "Note":
                css = x.attrs.get("class", "").lower()
                label = next((k.title() for k in ("warning", "tip", "important", "caution", "danger", "info") if k in css), "Note")
            for t in titles:
                t.remove()
            quote = Node("blockquote")
            quote.add(Node("strong")).add(Node("", text=f"{label}:"))
            if body := _flat(x.content()):
                quote.add(Node("", text=f" {body}"))
            x.replace(quote)


def _rows(table: Node) -> list[list[str]]:
    """Cells of each row that has some; a cell over n columns n times, row spans ignored."""
    out = []
    for tr in table.select("tr"):
        cells = [(_flat(c.content()), c.attrs.get("colspan", "1")) for c in tr.select("th, td")]
        if cells:
            out.append([text for text, n in cells for _ in range(max(1, int(n) if n.isdigit() else 1))])
    return out


class _Writer:
    """ATX Markdown with - bullets; underscores and asterisks of a text are escaped."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, x: Node) -> str:
        if not x.tag:
            return re.sub(r"([_*])", r"\\\1", re.sub(r"\s+", " ", x.text))
        inner = "".join(self.inline(c) for c in x.children)
        if x.tag in ("b", "strong"):
            return f"**{inner.strip()}**" if inner.strip() else ""
        if x.tag in ("i", "em"):
            return f"*{inner.strip()}*" if inner.strip() else ""
        if x.tag == "code":
            return f"`{x.content()}`"
        if x.tag == "br":
            return "  \n"
        if x.tag == "a" and x.attrs.get("href") and inner.strip():
            href = x.attrs["href"]
            return f"[{inner.strip()}]({href if re.match('#|mailto:|tel:|javascript:', href) else urljoin(self.base, href)})"
        if x.tag == "img":
            src = x.attrs.get("src", "")
            return f"![{x.attrs.get('alt') or x.attrs.get('title') or 'image'}]({urljoin(self.base, src) if src else ''})"
        return inner

    def blocks(self, x: Node) -> str:
        out: list[str] = []
        run: list[str] = []

        def close() -> None:
            if text := re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(run)).strip():
                out.append(text)
            run.clear()

        for c in x.children:
            if c.tag in _BLOCK_TAGS or c.tag and any(y.tag in _BLOCK_TAGS for y in c.walk()):
                close()
                if text := self.block(c):
                    out.append(text)
            else:
                run.append(self.inline(c))
        close()
        return "\n\n".join(out)

    def block(self, x: Node) -> str:
        if re.fullmatch("h[1-6]", x.tag):
            text = _flat("".join(self.inline(c) for c in x.children))
            return f"{'#' * int(x.tag[1])} {text}" if text else ""
        if x.tag == "pre":
            code = next((y for y in x.walk() if y.tag == "code"), None)
            language = class_language(x.attrs.get("class", "")) or (class_language(code.attrs.get("class", "")) or code_language(code.content()) if code else None)
            return f"```{language or ''}\n{x.content().strip(chr(10))}\n```"
        if x.tag in ("ul", "ol"):
            items, n = [], int(x.attrs.get("start", "1")) if x.attrs.get("start", "1").isdigit() else 1
            for li in (c for c in x.children if c.tag == "li"):
                mark = "- " if x.tag == "ul" else f"{n}. "
                n += 1
                items.append(mark + re.sub(r"\n+", "\n" + " " * len(mark), self.blocks(li)))
            return "\n".join(items)
        if x.tag == "blockquote":
            return "\n".join(f"> {line}" for line in self.blocks(x).split("\n"))
        if x.tag == "hr":
            return "---"
        if x.tag == "table":
            rows = _rows(x)
            line = lambda r: "| " + " | ".join(re.sub(r"([_*])", r"\\\1", c).replace("|", r"\|") for c in r) + " |"
            return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * len(rows[0])) + " |", *map(line, rows[1:])]) if rows else ""
        if x.tag == "dl":
            parts = [f"**{_flat(c.content())}**" if c.tag == "dt" else f": {_flat(c.content())}" for c in x.children if c.tag in ("dt", "dd")]
            return re.sub(r"\n(?=\*\*)", "\n\n", "\n".join(parts))
        return self.blocks(x)


_BLOCK_TAGS = set("address article blockquote body details div dl fieldset figure form h1 h2 h3 h4 h5 h6 hr main ol p pre section table ul".split())


def tidy_fences(markdown: str) -> str:
    """Names unnamed fences (text, or by content), drops line numbers inside and sets one blank line around."""
    out: list[str] = []
    block: list[str] | None = None
    after = False
    for line in markdown.split("\n"):
        if block is None and line.startswith("```"):
            block = [line[3:].strip()]
        elif block is None:
            if out and out[-1] and line and (after or line.startswith("#")):
                out.append("")
            after = after and not line
            out.append(line)
        elif line.startswith("```"):
            name, body = block[0], block[1:]
            while body and not body[-1]:
                body.pop()
            name = name if name and name != "text" else code_language("\n".join(body)) or "text"
            while len(out) > 1 and not out[-1] and not out[-2]:
                out.pop()
            out += ([""] if out and out[-1] else []) + [f"```{name}", *body, "```"]
            block, after = None, True
        else:
            block.append(re.sub(r"^(?:\s*[0-9]+\s*\|\s?)?(?:\s*[0-9]+\s\s+)?", "", line))
    if block is not None:
        out += [f"```{block[0] or 'text'}", *block[1:]]
    return "\n".join(out)


def page_title(root: Node) -> str:
    for h in root.select("h1"):
        if text := _flat(h.content()):
            return text
    for t in root.select("title"):
        if text := t.content().strip():
            cut = next((s for s in (" — ", " | ", " - ") if s in text), None)
            return _flat(text.split(cut)[0] if cut else text)
    return "Untitled"


def crumbs(root: Node, selectors: dict[str, str]) -> list[str]:
    found = [a for nav in (root.select(selectors["navigation"]) if selectors.get("navigation") else []) for a in nav.select("a")]
    found += [a for box in root.select('.breadcrumb, .breadcrumbs, [aria-label="breadcrumb"]') for a in box.select("a, span")]
    return list(dict.fromkeys(text for a in found if (text := a.content().strip())))


def html_breadcrumb(html: str, selector: str | None = None) -> list[str]:
    """Breadcrumb of a page by itself: list items, else links, else the text cut at slashes."""
    root = parse(html)
    for box in root.select(", ".join(filter(None, [selector, '.breadcrumb, .breadcrumbs, [aria-label="breadcrumb"], nav ol']))):
        for inner in ("li", "a"):
            if texts := [t for x in box.select(inner) if (t := _flat(x.content()))]:
                return texts
        if texts := [t for x in box.content().split("/") if (t := x.strip())]:
            return texts
    return []


def meta(root: Node) -> dict[str, str]:
    out = {}
    for m in root.select("meta"):
        name = m.attrs.get("name") or m.attrs.get("property")
        if name and m.attrs.get("content"):
            out[name.lower()] = m.attrs["content"]
    for link in root.select('link[rel="canonical"]')[:1]:
        if link.attrs.get("href"):
            out["canonical"] = link.attrs["href"]
    return out


def extract_page(html: str | None, url: str | None, selectors: dict[str, str] | None = None) -> dict:
    """All of SCHEMA for one page; a page that can't be parsed or is null gives an empty one."""
    root, selectors = parse(html or ""), selectors or {}
    title, breadcrumb, data = page_title(root), crumbs(root, selectors), meta(root)
    content, data["extraction_method"] = main_content(root, selectors)
    for x in content.select(_DROP):
        x.remove()
    for x in content.select(".linenos, .line-numbers, .gutter, .lineno"):
        x.remove()
    _callouts(content)
    markdown = tidy_fences(re.sub("\n\n\n+", "\n\n", _Writer(url or "").blocks(content)).strip())
    headings = [m[1].strip() for line in markdown.split("\n") if (m := re.match(r"(?:#{1,6})\s+(\S.*)$", line.strip()))]
    blocks = [{"language": m[1] or "text", "content": m[2].strip("\n")} for m in re.finditer(r"(?s)`{3}(\w*)\n(.*?)`{3}", markdown)]
    return {"title": title, "markdown": markdown, "headings": headings or [title], "code_blocks": blocks, "breadcrumb": breadcrumb, "raw_metadata": data}


def extract(fetches: DataFrame, selectors: dict[str, str] | None = None) -> DataFrame:
    """fetches (url, html, ...) with the columns of SCHEMA in place of html."""
    ensure_importable(fetches.sparkSession)

    @F.pandas_udf(f"struct<{SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_page(h, u, selectors) for h, u in zip(html, url)], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    # said to be non-deterministic so that filters aren't pushed below it, which would parse each page twice
    return fetches.withColumn("__x", run.asNondeterministic()("html", "url")).select(*[c for c in fetches.columns if c != "html"], "__x.*")


def title(html: Column) -> Column:
    """The title without a parser: text of the first h1 that has some, else of <title> up to a separator."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    h1 = strip(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    whole = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    cut = F.trim(F.regexp_replace(whole, r"( — | \| | - ).*$", ""))
    return F.when(h1 != "", h1).when(cut != "", cut).otherwise("Untitled")


def doc_score(html: Column) -> Column:
    """How much like documentation a page looks, from 0 to 1."""
    low = F.lower(html)
    has = lambda pattern, weight: F.when(html.rlike("(?i)" + pattern), F.lit(weight)).otherwise(0.0)
    out = has('<link[^>]+rel="sitemap"[^<>]*>', 0.15) + has("<h[12][^>]*>", 0.25) + has("<pre[^>]*><code", 0.25)
    out = out + has("""<nav|class=['"](?:sidebar|toc|menu)['"]""", 0.15) + has("mkdocs|sphinx|docusaurus|readthedocs|gitbook", 0.1)
    for word in ("enterprise", "login", "pricing", "sign-up", "signup"):
        out = out - F.when(low.contains(word), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))
