"""Budgets, packing, chunking and HTML blocks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix(rows: DataFrame, group: str, order: str, need: str, budget: int) -> DataFrame:
    """The rows of each group, in order, whose running need stays within the budget."""
    used = F.sum(need).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def largest_remainder(rows: DataFrame, group: str, item: str, weight: str, budget: int) -> DataFrame:
    """(group, item, budget): whole shares of ``budget`` by weight, what is left going to the largest fractions."""
    w = Window.partitionBy(group)
    exact = F.lit(float(budget)) * F.col(weight) / F.sum(weight).over(w)
    shares = rows.withColumn("_e", exact).withColumn("_b", F.floor("_e").cast("long"))
    order = w.orderBy(F.desc(F.col("_e") - F.col("_b")), item)
    placed = shares.withColumn("_r", F.row_number().over(order)).withColumn("_rest", budget - F.sum("_b").over(w))
    return placed.select(group, item, (F.col("_b") + (F.col("_r") <= F.col("_rest")).cast("long")).alias("budget"))


#: The order in which unused room is lent to sections that had to drop something.
LEND = ("Evidence", "Key Results", "Learnings", "Workflow", "Assets & Entities", "Current State", "Errors & Corrections", "Task Spec")


def words_needed(text: str) -> int:
    return len(text.split())


def longest_prefix(text: str, budget: int, need: Callable[[str], int] = words_needed) -> tuple[str, str]:
    """(the longest prefix within ``budget``, the rest), cut at a space where that leaves anything; ``need`` must not fall as text grows."""
    if budget <= 0 or not text:
        return "", text
    if need(text) <= budget:
        return text, ""
    cut = bisect_right(range(len(text) + 1), budget, key=lambda n: need(text[:n])) - 1
    space = text.rfind(" ", 0, cut) if cut and text[cut - 1].isascii() else -1
    cut = space if space > 0 else cut
    return text[:cut].rstrip(), text[cut:].lstrip()


def _fit(items: list[tuple[int, str, bool]], budget: int, need: Callable[[str], int]) -> tuple[list[tuple[int, str]], bool]:
    """((item, text) in order, whether anything was left out): required items whole, others while they fit, the first that does not in part."""
    kept, used, short = [], 0, False
    for item, text, required in items:
        n = need(text)
        if not required and used + n > budget:
            short = True
            text, n = (lambda t: (t, need(t)))(longest_prefix(text, budget - used, need)[0])
            if not text:
                continue
        kept.append((item, text))
        used += n
    return kept, short


def sections(items: DataFrame, budgets: dict[str, int], total: int, need: Callable[[str], int] = words_needed) -> DataFrame:
    """(case_id, section, place, item, text): what of (case_id, section, item, text, required) fits a context of ``total``.

    Each section first takes what its own budget holds, by item number; then room that is left of ``total`` is lent to
    sections that dropped something, in the order of ``LEND``. Required items are never dropped. A case is one group:
    it is what goes into one prompt.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        given = {n: [(i, t or "", bool(r)) for i, t, r, s in zip(frame["item"], frame["text"], frame["required"], frame["section"], strict=True) if s == n] for n in budgets}
        own = dict(budgets)
        fitted = {n: _fit(given[n], own[n], need) for n in budgets}
        used = {n: sum(need(t) for _, t in fitted[n][0]) for n in budgets}
        left = max(0, total - sum(used.values()))
        for n in (n for n in LEND if n in budgets and fitted[n][1]):
            missing = sum(need(t) for _, t, _ in given[n]) - used[n]
            own[n] += max(0, min(left, missing))
            fitted[n] = _fit(given[n], own[n], need)
            now = sum(need(t) for _, t in fitted[n][0])
            left, used[n] = max(0, left - max(0, now - used[n])), now
        rows = [(frame["case_id"].iloc[0], n, place, i, t) for n in budgets for place, (i, t) in enumerate(fitted[n][0], 1)]
        return pd.DataFrame(rows, columns=["case_id", "section", "place", "item", "text"])

    return items.groupBy("case_id").applyInPandas(run, "case_id long, section string, place long, item long, text string")


_BLOCKS = ("h1", "h2", "h3", "h4", "p", "li", "pre", "td")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "nav")
        if tag in _BLOCKS:
            self.close_block()
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "nav") and self.skip > 0
        if tag in _BLOCKS:
            self.close_block()
            if self.open:
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip and self.open:
            self.text.append(data)

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.open:
            self.out.append((self.open[-1], text))
        self.text = []


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, place, tag, text): headings, paragraphs, items and cells in order, without scripts and menus."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                reader = _Reader()
                reader.feed(html or "")
                reader.close_block()
                rows += [(page, i, tag, text) for i, (tag, text) in enumerate(reader.out)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "tag", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, tag string, text string")


def chunks(blocks: DataFrame, target: int = 800, least: int = 60) -> DataFrame:
    """(page_id, chunk, text): blocks packed to ``target`` characters, never across a first or second heading.

    A last chunk of a section below ``least`` characters joins the one before it.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sections: list[list[str]] = []
        for tag, text in frame.sort_values("place")[["tag", "text"]].itertuples(index=False):
            if tag in ("h1", "h2") or not sections:
                sections.append([])
            sections[-1].append(text)
        out: list[str] = []
        for section in sections:
            own: list[str] = []
            for text in section:
                if own and len(own[-1]) + 1 + len(text) <= target:
                    own[-1] += " " + text
                else:
                    own.append(text)
            if len(own) > 1 and len(own[-1]) < least:
                own[-2:] = [own[-2] + " " + own[-1]]
            out += own
        return pd.DataFrame({"page_id": frame["page_id"].iloc[0], "chunk": range(len(out)), "text": out})

    return blocks.groupBy("page_id").applyInPandas(run, "page_id long, chunk int, text string")
