"""Corpora from pages and records: tables of contents, field precedence, and headers for chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOC = "place int, parent int, depth int, href string, title string, path array<string>"


class _Lists(HTMLParser):
    """The links of nested lists: each below the last link of the list around its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.href, self.text = 0, None, []
        self.above: list[tuple[int, int, str]] = []
        self.out: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("ul", "ol"):
            self.depth += 1
        elif tag == "a" and self.depth:
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("ul", "ol") and self.depth:
            self.depth -= 1
        elif tag == "a" and self.href is not None:
            title, href = " ".join("".join(self.text).split()), self.href
            self.href = None
            if title and href:
                self.above = [x for x in self.above if x[0] < self.depth]
                parent = self.above[-1][1] if self.above else None
                self.out.append((len(self.out), parent, self.depth, href, title, [*(x[2] for x in self.above), title]))
                self.above.append((self.depth, len(self.out) - 1, title))


@F.udtf(returnType=TOC)
class _Toc:
    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Lists()
        reader.feed(html or "")
        yield from reader.out


def toc(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, parent, depth, href, title, path) of every link in the lists of each page, in order.

    ``parent`` is the place of the entry above, ``path`` the titles from the top down to its own.
    Pages without lists, and null ones, have no entries.
    """
    return pages.select(key, F.col(html).alias("_h")).lateralJoin(_Toc(F.col("_h").outer())).drop("_h")


def sections(entries: DataFrame) -> DataFrame:
    """(href, title, path): of an href's occurrences that with the longest path, the first by path on ties."""
    rank = F.row_number().over(Window.partitionBy("href").orderBy(F.desc(F.size("path")), "path"))
    return entries.withColumn("_r", rank).where("_r = 1").select("href", "title", "path")


def breadcrumb(path: Column) -> Column:
    """The titles of a path, one that repeats the one before it left out."""
    kept = F.filter(F.transform(path, lambda t, i: F.struct(t.alias("t"), F.get(path, i - 1).alias("b"))), lambda x: x["b"].isNull() | (x["t"] != x["b"]))
    return F.array_join(F.transform(kept, lambda x: x["t"]), " > ")


def headed(chunks: DataFrame, sections_: DataFrame, href: str = "href") -> DataFrame:
    """``chunks`` with ``header``, the breadcrumb of their page's section (empty where the table of contents has none), and ``cr_text`` under it."""
    met = chunks.join(sections_.select(F.col("href").alias("_h"), "path"), F.col(href) == F.col("_h"), "left")
    told = met.withColumn("header", F.coalesce(breadcrumb(F.col("path")), F.lit(""))).drop("_h", "path")
    return told.withColumn("cr_text", F.concat(F.when(F.col("header") != "", F.concat("header", F.lit("\n"))).otherwise(""), "text"))


def normalised(records: DataFrame, id_field: str = "id", text_field: str | None = None, contextual: bool = True) -> DataFrame:
    """(doc_id, text, metadata) of records of any columns.

    The text is that of ``text_field``; else of ``cr_text``, of ``context_header`` before ``text`` if
    ``contextual``, of ``text``: the first that a record has. All other columns go to ``metadata`` as
    JSON. Records without an id or any text are left out.
    """
    has = lambda c: c in records.columns
    if not has(id_field):
        raise ValueError(f"no column {id_field}")
    wanted = [text_field] if text_field else ["cr_text", "context_header", "text"]
    if not any(has(c) for c in wanted if text_field or c != "context_header"):
        raise ValueError("the records have no column of text")
    col = lambda c: F.col(f"`{c}`").cast("string") if has(c) else F.lit(None).cast("string")
    if text_field:
        text = col(text_field)
    else:
        under = F.when(F.coalesce(col("context_header"), F.lit("")) != "", F.concat_ws("\n", col("context_header"), col("text"))) if contextual else F.lit(None).cast("string")
        text = F.coalesce(col("cr_text"), F.when(col("text").isNotNull(), under), col("text"))
    used = {id_field, *(c for c in wanted if has(c))}
    rest = [c for c in records.columns if c not in used]
    metadata = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")
    rows = records.select(F.col(f"`{id_field}`").cast("string").alias("doc_id"), text.alias("text"), metadata.alias("metadata"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
