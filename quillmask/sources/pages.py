"""Observed pages: the elements and opaque regions of static HTML, in document order.

Only markup is read: styles count as far as they stand in ``style`` and
``hidden`` attributes, boxes are laid out as lines of a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by how they are observed.
CONTROLS = frozenset("input textarea select button".split())
CONTROL_ROLES = frozenset("button link checkbox textbox".split())
TEXT_TAGS = frozenset("p span li td th h1 h2 h3 h4 h5 h6 label dt dd div strong em b".split())
INLINE_TAGS = frozenset("span b i strong em small sub sup mark code abbr time br u s bdi bdo wbr font".split())
UNSEEN = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 article section footer nav form".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
SENSITIVE_FORM = re.compile("otp|pin|cvv|aadha+r|pan|account|ifsc|kyc|payment|card|bank", re.I)
MERGED_MOST, OPTIONS_MOST = 40, 30


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in UNSEEN or x is self:
                stack += reversed(x.children)
        return "".join(parts)

    def own(self) -> str:
        return tidy("".join(c for c in self.children if isinstance(c, str)))

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = self.nodes()[::-1]
        while stack:
            x = stack.pop()
            yield x
            stack += x.nodes()[::-1]

    def up(self) -> Iterator[Node]:
        x: Node | None = self
        while x is not None:
            yield x
            x = x.parent


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag] and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for x in self.at.up():
            if x.tag == tag and x.parent:
                self.at = x.parent
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def read(html: str | None) -> Node:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def visible(node: Node) -> bool:
    for k, x in enumerate(node.up()):
        style = re.sub(r"\s", "", x.attrs.get("style", "")).lower()
        if "hidden" in x.attrs or "display:none" in style or (k == 0 and ("visibility:hidden" in style or re.search(r"opacity:0(?:\.0*)?(?:;|$)", style))):
            return False
    return not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


def opaque_kind(node: Node) -> str | None:
    kind = {"img": "img", "canvas": "canvas", "video": "video", "iframe": "iframe"}.get(node.tag)
    if node.tag == "svg" and not node.text().strip():
        kind = "svg"
    return kind or ("background" if re.search(r"background(?:-image)?\s*:[^;]*url\(", node.attrs.get("style", "")) else None)


def interactive(node: Node) -> bool:
    return node.tag in CONTROLS or (node.tag == "a" and "href" in node.attrs) or node.attrs.get("role") in CONTROL_ROLES or node.attrs.get("contenteditable") == "true"


def input_type(node: Node) -> str:
    return node.attrs.get("type", "").lower() or "text"


def role_of(node: Node) -> str:
    if node.attrs.get("role"):
        return node.attrs["role"]
    if node.tag == "input":
        return {"checkbox": "checkbox", "radio": "radio", "submit": "button", "button": "button"}.get(input_type(node), "textbox")
    named = {"button": "button", "a": "link", "select": "combobox", "textarea": "textbox"}.get(node.tag)
    return named or ("textbox" if node.attrs.get("contenteditable") == "true" else "heading" if re.fullmatch("h[1-6]", node.tag) else "text")


def value_of(node: Node) -> str:
    if node.tag == "input":
        return "" if input_type(node) in ("checkbox", "radio", "submit", "button") else node.attrs.get("value", "")
    if node.tag == "textarea":
        return node.text()
    if node.tag == "select":
        options = [x for x in node.walk() if x.tag == "option"]
        chosen = next((x for x in options if "selected" in x.attrs), options[0] if options else None)
        return "" if chosen is None else chosen.attrs.get("value", tidy(chosen.text()))
    return node.text().strip() if node.attrs.get("contenteditable") == "true" else ""


def name_of(node: Node, ids: dict[str, Node], labels: dict[str, Node]) -> str:
    """The accessible name, by precedence."""
    a = node.attrs
    if a.get("aria-label"):
        return a["aria-label"].strip()
    by = tidy(" ".join(ids[i].text() if i in ids else "" for i in a.get("aria-labelledby", "").split()))
    if by:
        return by
    if a.get("id") in labels and labels[a["id"]].text():
        return tidy(labels[a["id"]].text())
    wrap = next((x for x in node.up() if x.tag == "label" and x is not node), None)
    if wrap is not None and wrap.own():
        return wrap.own()
    if node.tag in ("button", "a") or a.get("role") == "button":
        text = tidy(node.text())
        if text:
            return text
    if node.tag == "input" and input_type(node) in ("submit", "button"):
        return a.get("value", "")
    return a.get("placeholder", a.get("title", a.get("alt", ""))).strip()


def column_header(node: Node) -> str | None:
    cell = next((x for x in node.up() if x.tag == "td"), None)
    table = next((x for x in node.up() if x.tag == "table"), None)
    if cell is None or table is None or cell.parent is None:
        return None
    first = next((x for x in table.walk() if x.tag == "tr"), None)
    k = next(i for i, x in enumerate(cell.parent.nodes()) if x is cell)
    heads = first.nodes() if first is not None else []
    return (heads[k].text().strip() or None) if k < len(heads) and heads[k].tag == "th" else None


def observe(html: str | None) -> tuple[list[dict], list[dict]]:
    """Elements and opaque regions of a page."""
    root = read(html)
    body = next((x for x in root.walk() if x.tag == "body"), root)
    ids, labels = {}, {}
    for x in root.walk():
        ids.setdefault(x.attrs.get("id"), x)
        if x.tag == "label":
            labels.setdefault(x.attrs.get("for"), x)
    ids.pop(None, None)
    labels.pop(None, None)
    elements: list[dict] = []
    opaque: list[dict] = []
    merged: set[int] = set()
    number = 0
    for node in body.walk():
        if node.parent is not None and id(node.parent) in merged:
            merged.add(id(node))
            continue
        if node.tag in UNSEEN or any(x.tag in UNSEEN for x in node.up()) or not visible(node):
            continue
        kind = opaque_kind(node)
        if kind:
            number += 1
            alt = (node.attrs.get("alt") or node.attrs.get("aria-label") or "").strip()
            opaque.append({"nodeId": f"n{number}", "kind": kind, "src": node.attrs.get("src") or None, "name": alt or None})
            continue
        control = interactive(node)
        inner = list(node.walk()) if node.tag in TEXT_TAGS - INLINE_TAGS and not control else []
        block = 0 < len(inner) <= MERGED_MOST and all(x.tag in INLINE_TAGS for x in inner)
        if block:
            merged.add(id(node))
        text = tidy(node.text()) if block else node.own()
        if not control and not (node.tag in TEXT_TAGS and text):
            continue
        if not control and any(x.tag in ("button", "label") or (x.tag == "a" and "href" in x.attrs) for x in node.up()):
            continue
        number += 1
        a = node.attrs
        form = next((x for x in node.up() if x.tag == "form"), None)
        href = a.get("href", "").lower() if node.tag == "a" else ""
        elements.append(
            {
                "nodeId": f"n{number}", "tag": node.tag, "role": role_of(node), "name": name_of(node, ids, labels) if control else text, "text": "" if control else text, "value": value_of(node),
                "inputType": input_type(node) if node.tag == "input" else None, "autocomplete": a.get("autocomplete") or None, "htmlName": a.get("name") or None, "htmlId": a.get("id") or None,
                "placeholder": a.get("placeholder") or None, "disabled": True if "disabled" in a and node.tag in CONTROLS else None,
                "checked": "checked" in a if node.tag == "input" and input_type(node) in ("checkbox", "radio") else None,
                "insideSensitiveForm": bool(form is not None and SENSITIVE_FORM.search(f"{form.attrs.get('id', '')} {form.attrs.get('name', '')} {form.attrs.get('action', '')}")) or None,
                "context": column_header(node), "options": [t for t in (tidy(x.text()) for x in node.walk() if x.tag == "option") if t][:OPTIONS_MOST] if node.tag == "select" else None,
                "boilerplate": True if any(x.tag == "footer" or x.attrs.get("role") == "contentinfo" for x in node.up()) else None,
                "contact": "mailto" if href.startswith("mailto:") else "tel" if href.startswith("tel:") else None,
            }
        )
    return elements, opaque


FIELDS = (
    "nodeId string, tag string, role string, name string, text string, value string, inputType string, autocomplete string, htmlName string, htmlId string, placeholder string, "
    "disabled boolean, checked boolean, insideSensitiveForm boolean, context string, options array<string>, boilerplate boolean, contact string"
)
OBSERVED = f"elements array<struct<{FIELDS.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>, opaque array<struct<nodeId:string,kind:string,src:string,name:string>>"


def observed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, elements, opaque of every page, read in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [observe(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "elements": [e for e, _ in both], "opaque": [o for _, o in both]})

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, {OBSERVED}")


def element_rows(seen: DataFrame) -> DataFrame:
    """A row per element with scope, pos (from 1) and a box: lines of a list, as no layout is known."""
    rows = seen.select(F.col("page_id").cast("string").alias("scope"), "url", F.posexplode("elements").alias("at", "e"))
    box = {"x": F.lit(10.0), "y": 10.0 + 30.0 * F.col("at"), "w": F.lit(400.0), "h": F.lit(24.0), "viewport_w": F.lit(1280.0), "viewport_h": F.lit(800.0)}
    return rows.select("scope", (F.col("at") + 1).alias("pos"), "url", "e.*", *(v.alias(k) for k, v in box.items()))


def opaque_rows(seen: DataFrame) -> DataFrame:
    return seen.select(F.col("page_id").cast("string").alias("scope"), F.posexplode("opaque").alias("at", "o")).select("scope", "at", "o.*")


def screen_rows(seen: DataFrame) -> DataFrame:
    """The elements of pages, then their opaque regions as rows with a ``kind``, whose name is the alternative text."""
    after = seen.select(F.col("page_id").cast("string").alias("scope"), "url", F.size("elements").alias("n"), F.posexplode("opaque").alias("at", "o"))
    box = {"x": 10.0, "y": 10.0, "w": 400.0, "h": 24.0, "viewport_w": 1280.0, "viewport_h": 800.0}
    regions = after.select(
        "scope", (F.col("n") + F.col("at") + 1).alias("pos"), "url", "o.nodeId", F.col("o.kind").alias("kind"), F.lit("image").alias("role"), F.coalesce("o.name", F.lit("")).alias("name"),
        F.lit("").alias("text"), F.lit("").alias("value"), F.lit(False).alias("boilerplate"), *(F.lit(v).alias(k) for k, v in box.items()),
    )
    return element_rows(seen).unionByName(regions, allowMissingColumns=True)
