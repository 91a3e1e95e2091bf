"""Links, images, forms and hidden text of web pages and HTML mail."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
PAGE_DDL = (
    "anchors array<struct<href:string,label:string>>, images array<string>, "
    "forms array<struct<action:string,method:string>>, hidden_text array<string>"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0", re.I)


def anchors(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Fast path for links only: a regular expression inside the JVM, one row per anchor."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2)).alias("label"),
    )
    rows = df.select(key, F.posexplode(pairs).alias("pos", "a"))
    return rows.select(
        key, "pos", F.trim("a.href").alias("href"), F.trim(F.regexp_replace("a.label", "<[^>]*>", "")).alias("label")
    )


class _Page(HTMLParser):
    """Collects what the detectors read from one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, str]] = []
        self.images: list[str] = []
        self.forms: list[tuple[str, str]] = []
        self.hidden: list[str] = []
        self._open: list[dict] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: (v or "") for k, v in attrs}
        if tag == "img" and a.get("src", "").strip():
            self.images.append(a["src"].strip())
        elif tag == "form":
            self.forms.append((a.get("action", "").strip(), (a.get("method") or "get").lower()))
        elif tag == "input" and a.get("type") == "hidden":
            name, value = a.get("name", "").strip(), a.get("value", "").strip()
            if name or value:
                self.hidden.append(f"{name or '(unnamed)'}={value}")
        if tag in _VOID:
            return
        concealed = "hidden" in a or a.get("aria-hidden") == "true" or bool(_CONCEALED.search(a.get("style", "")))
        self._open.append({"tag": tag, "href": a.get("href") if tag == "a" else None, "hidden": concealed, "text": []})

    def handle_data(self, data: str) -> None:
        for node in self._open:
            if node["href"] is not None or node["hidden"]:
                node["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self._open):
            while self._open:
                node = self._open.pop()
                self._finish(node)
                if node["tag"] == tag:
                    break

    def _finish(self, node: dict) -> None:
        text = "".join(node["text"]).strip()
        if node["href"] is not None:
            self.anchors.append((node["href"].strip(), text))
        if node["hidden"] and text:
            self.hidden.append(text)

    def finish(self) -> dict:
        self.close()
        while self._open:
            self._finish(self._open.pop())
        unique = lambda xs: list(dict.fromkeys(xs))
        return {
            "anchors": [{"href": h, "label": t} for h, t in self.anchors],
            "images": unique(self.images),
            "forms": [{"action": x, "method": m} for x, m in self.forms],
            "hidden_text": unique(self.hidden),
        }


def parse_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    return page.finish()


def extract_html(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key`` and the page parts of ``PAGE_DDL``; parsed in Arrow batches where the rows are."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = pd.DataFrame([parse_page(h) for h in frame[html]], index=frame.index)
            if parsed.empty:
                parsed = pd.DataFrame({c: [] for c in ("anchors", "images", "forms", "hidden_text")})
            yield pd.concat([frame[[key]], parsed], axis=1)

    kind = dict(df.dtypes)[key]
    return df.select(key, html).mapInPandas(batches, f"`{key}` {kind}, {PAGE_DDL}")
