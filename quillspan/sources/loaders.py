"""Documents from files: text, Markdown, JSON, JSON lines, CSV, HTML, Word, and folders of them.

Every loader returns documents(id, content, source, title, metadata map<string,string>, checksum, lossy, error). Files are
listed and read by Spark, so that a folder is read in parallel; a file that can't be read or parsed gives a row with
`error` instead of failing the others.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.columns import stable_uuid

# Which keys of a record are its content, id and title, in order of preference.
CONTENT_KEYS = ("content", "text", "body", "page_content", "description", "answer")
ID_KEYS = ("id", "_id", "uuid", "doc_id", "document_id", "key")
TITLE_KEYS = ("title", "name", "headline", "subject")
LARGEST = 20_000_000
_SCHEMA = "path string, part int, content string, title string, record_id string, metadata map<string,string>, lossy boolean, error string"


def decoded(raw: bytes) -> tuple[str, bool]:
    """The text, and whether characters were lost: UTF-8 (with or without a mark) first, replacement characters else."""
    try:
        return raw.decode("utf-8-sig"), False
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace"), True


def collapsed(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The `key: value` lines between --- marks at the top, and what follows; lists in brackets or on lines with a dash become comma-separated."""
    m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    out: dict[str, str] = {}
    key = ""
    for line in m.group(1).split("\n"):
        if (item := re.match(r"\s*-\s+(.*)", line)) and key:
            out[key] = ", ".join(x for x in (out[key], item.group(1).strip().strip("\"'")) if x)
        elif pair := re.match(r"([\w.-]+)\s*:\s*(.*)$", line):
            key, value = pair.group(1), pair.group(2).strip()
            out[key] = ", ".join(x.strip().strip("\"'") for x in value[1:-1].split(",")) if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    return out, text[m.end() :]


def _text(text: str, **_) -> Iterator[dict]:
    yield {"content": collapsed(text)}


def _markdown(text: str, **_) -> Iterator[dict]:
    meta, body = front_matter(text)
    heading = re.search(r"(?m)^#\s+(.+?)\s*#*$", body)
    yield {"content": collapsed(body), "title": meta.pop("title", None) or (heading.group(1) if heading else None), "metadata": meta}


def record(value: object) -> dict:
    """A record's content, id and title by the preferred keys; the other keys are its metadata. Without a content key all pairs are rendered as lines."""
    if not isinstance(value, dict):
        return {"content": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)}
    pick = lambda keys: next((k for k in keys if value.get(k) not in (None, "")), None)
    text, own, title = pick(CONTENT_KEYS), pick(ID_KEYS), pick(TITLE_KEYS)
    plain = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    rest = {str(k): plain(v) for k, v in value.items() if k not in (text, own, title) and v is not None}
    content = plain(value[text]) if text else "\n".join(f"{k}: {plain(v)}" for k, v in value.items() if v not in (None, ""))
    return {"content": collapsed(content), "record_id": str(value[own]) if own else None, "title": str(value[title]) if title else None, "metadata": rest if text else {}}


def _json(text: str, **_) -> Iterator[dict]:
    value = json.loads(text)
    for one in value if isinstance(value, list) else [value]:
        yield record(one)


def _json_lines(text: str, **_) -> Iterator[dict]:
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            try:
                yield record(json.loads(line))
            except ValueError as e:
                yield {"content": None, "error": f"line {n}: {e}"}


def delimiter(head: str) -> str:
    """Of , ; tab and | the one that all of the first lines have most often, outside of quotes."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in head.splitlines()[:10] if x.strip()]
    return max(",;\t|", key=lambda d: (min((x.count(d) for x in lines), default=0), -",;\t|".index(d)))


def _csv(text: str, whole: bool = False, **_) -> Iterator[dict]:
    rows = list(csv.DictReader(io.StringIO(text), delimiter=delimiter(text[:20_000])))
    made = [record({k: v for k, v in r.items() if k is not None}) for r in rows]
    if whole:
        yield {"content": "\n\n".join(m["content"] for m in made), "metadata": {"rows": str(len(rows))}}
    else:
        yield from made


class _Page(HTMLParser):
    """The text of the main part of a page, with its title, language, canonical address and meta fields."""

    CHROME = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "iframe", "button"}
    BREAKS = {"p", "div", "br", "li", "tr", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
    EMPTY = {"br", "hr", "img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed", "track"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.parts: dict[str, list[str]] = {"main": [], "article": [], "body": []}
        self.title, self.heading, self.meta = "", "", {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.meta["lang"] = a["lang"]
        if tag == "meta" and (a.get("name") or a.get("property")) and a.get("content"):
            self.meta[(a.get("name") or a["property"]).lower()] = a["content"]
        if tag == "link" and a.get("rel") == "canonical":
            self.meta["canonical"] = a.get("href", "")
        if tag not in self.EMPTY:
            self.stack.append("main" if a.get("role") == "main" or a.get("id") in ("main", "content") else tag)
        self._said("\n" if tag in self.BREAKS else "")
        if tag == "li":
            self._said("- ")

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag or (self.stack[i] == "main" and tag in ("div", "section", "main")):
                del self.stack[i:]
                break
        self._said("\n" if tag in self.BREAKS else "\t" if tag in ("td", "th") else "")

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] == "title":
            self.title += data
        else:
            if self.stack and self.stack[-1] == "h1":
                self.heading += data
            self._said(data if "pre" in self.stack else re.sub(r"\s+", " ", data))

    def _said(self, text: str) -> None:
        if text and not self.CHROME.intersection(self.stack) and "head" not in self.stack and "title" not in self.stack:
            self.parts["body"].append(text)
            for region in ("main", "article"):
                if region in self.stack:
                    self.parts[region].append(text)


def _html(text: str, **_) -> Iterator[dict]:
    page = _Page()
    page.feed(text)
    page.close()
    texts = {k: collapsed(re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(v))) for k, v in page.parts.items()}
    content = next((texts[k] for k in ("main", "article", "body") if texts[k]), "")
    yield {"content": content, "title": (page.title or page.heading).strip() or None, "metadata": page.meta}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _said(node) -> str:
    """The text of a Word paragraph: runs, tabs and breaks in order."""
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(x.tag.removeprefix(_W), "") for x in node.iter())


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells between bars; line breaks and bars within cells don't break the table."""
    return "\n".join("| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in r) + " |" for r in rows)


def _word(raw: bytes) -> Iterator[dict]:
    """Paragraphs and tables of a Word document in order; headings of level n are lines with n marks of Markdown."""
    with zipfile.ZipFile(io.BytesIO(raw)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(packed.read("docProps/core.xml")) if "docProps/core.xml" in packed.namelist() else None
    parts = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            parts.append(table_text([["\n".join(_said(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]))
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            parts.append("#" * int(level.group(1)) + " " + _said(node) if level else _said(node))
    meta = {x.tag.rpartition("}")[2]: x.text for x in core if x.text} if core is not None else {}
    yield {"content": collapsed("\n\n".join(parts)), "title": meta.pop("title", None), "metadata": meta}


LOADERS: dict[str, Callable[..., Iterator[dict]]] = {"txt": _text, "md": _markdown, "markdown": _markdown, "json": _json, "jsonl": _json_lines, "ndjson": _json_lines, "csv": _csv, "tsv": _csv, "html": _html, "htm": _html}


def loader_for(suffix: str) -> Callable[..., Iterator[dict]]:
    """The loader of a file name's suffix; text for any other."""
    return LOADERS.get(suffix.lower().lstrip("."), _text)


def load(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None, tenant: str | None = None, largest: int = LARGEST, **options) -> DataFrame:
    """Documents of a file or, with all folders below it, of a folder.

    `include` is a glob on names, `exclude` a regular expression on paths. Files above `largest` bytes and binary files
    give a row with an error; hidden files are passed over.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include)
    files = reader.load(path).where(~F.col("path").rlike(r"/[._][^/]*$"))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, size, raw in zip(f["path"], f["length"], f["content"], strict=True):
                row = {"path": path, "part": 0, "content": None, "title": None, "record_id": None, "metadata": {}, "lossy": False, "error": None}
                if size > largest:
                    out.append(row | {"error": f"{size} bytes"})
                    continue
                if path.lower().endswith(".docx"):
                    try:
                        out += [row | made for made in _word(raw)]
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                        out.append(row | {"error": str(e)})
                    continue
                if b"\0" in raw[:8000]:
                    out.append(row | {"error": "binary"})
                    continue
                text, lossy = decoded(raw)
                try:
                    for i, made in enumerate(loader_for(path.rpartition(".")[2])(text, **options)):
                        out.append(row | {"part": i, "lossy": lossy} | made)
                except (ValueError, csv.Error) as e:
                    out.append(row | {"error": str(e)})
            yield pd.DataFrame(out, columns=["path", "part", "content", "title", "record_id", "metadata", "lossy", "error"])

    # Files above the limit are never read whole: their content isn't asked for.
    small = files.select("path", "length", F.when(F.col("length") <= largest, F.col("content")).otherwise(F.lit(b"")).alias("content"))
    rows = small.mapInPandas(run, _SCHEMA)
    source = F.when(F.col("part") > 0, F.concat_ws("#", "path", F.col("part").cast("string"))).otherwise(F.col("path"))
    own = F.coalesce("record_id", stable_uuid(F.lit("doc"), F.lit(tenant or ""), source, F.coalesce("content", F.lit(""))))
    return rows.select(own.alias("id"), "content", source.alias("source"), "title", "metadata", F.sha2("content", 256).alias("checksum"), "lossy", "error", F.lit(tenant).cast("string").alias("tenant_id"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected_answer, expected_chunk_ids, metadata) of JSON lines; blank lines and those that begin with # are passed over."""
    lines = spark.read.text(path).where("length(trim(value)) > 0 and not ltrim(value) like '#%'")
    fields = "id string, question string, expected_answer string, expected_chunk_ids array<string>, metadata map<string,string>"
    return lines.select(F.from_json("value", fields).alias("c")).select("c.*")
