"""HTML as rows: a fragment's tree of elements and texts, and its blocks with their own texts.

An end tag closes the innermost open element of its name and all that is open inside; one without such an element is passed over.
Elements that nothing closes end with the element around them or the page. Comments and declarations are no nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import ship

#: Elements without an end.
VOID = ("br", "img", "hr", "meta", "link", "input")
#: Elements whose texts are blocks of their own.
BLOCK = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
NODES = "node int, parent int, depth int, tag string, style string, block int, text string"
_TOKEN = re.compile(
    r"(?P<skip><!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z))"
    r"|<(?P<raw>script|style)\b(?P<raw_attrs>[^>]*)>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_STYLE = re.compile(r"""(?<![\w-])style\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def nodes_of(page: str) -> Iterator[tuple]:
    """(node, parent, depth, tag, style, block, text) in order; parent and block (the innermost block around or at the node) are node numbers, or None.

    Elements have no text, texts no tag; a line break is an element like any other.
    """
    open_: list[tuple[str, int, int | None]] = []  # tag, node, block
    names: Counter[str] = Counter()
    number = 0

    def made(tag: str | None, style: str | None, text: str | None) -> tuple:
        nonlocal number
        parent, block = (open_[-1][1], open_[-1][2]) if open_ else (None, None)
        row = (number, parent, len(open_), tag, style, number if tag in BLOCK else block, text)
        number += 1
        return row

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield made(None, None, entities.unescape(m["text"]))
        elif m["raw"] is not None:
            row = made(m["raw"].lower(), _style(m["raw_attrs"]), None)
            yield row
            if m["inside"]:
                open_.append((row[3], row[0], row[5]))
                yield made(None, None, m["inside"])
                open_.pop()
        elif m["tag"] is not None:
            row = made(m["tag"].lower(), _style(m["attrs"]), None)
            yield row
            if row[3] not in VOID and not m["attrs"].endswith("/"):
                open_.append((row[3], row[0], row[5]))
                names[row[3]] += 1
        elif m["end"] is not None and names[tag := m["end"].lower()]:
            while True:
                last = open_.pop()[0]
                names[last] -= 1
                if last == tag:
                    break


def _style(attrs: str) -> str | None:
    m = _STYLE.search(attrs)
    return entities.unescape(next(x for x in m.groups() if x is not None)) if m else None


def _each(pages: DataFrame, key: str, html: str, make, schema: str) -> DataFrame:
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, page in enumerate(b.column(1).to_pylist()):
                if got := make(page or ""):
                    owner = b.column(0).slice(i, 1).take(pa.array([0] * len(got)))
                    columns = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, pa.string() if "string" in f else pa.int32()) for c, f in zip(columns, schema.split(", "), strict=True))], [key, *names])

    return pages.select(key, html).mapInArrow(rows, f"{key} {kind}, {schema}")


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The tree of each page: key and the columns of nodes_of(). Null and empty pages have no nodes; a page is parsed whole, in its task."""
    return _each(pages, key, html, lambda page: list(nodes_of(page)), NODES)


def blocks_of(page: str) -> list[tuple]:
    """(pos, tag, level, parent_pos, style, text) of each block in order: text is its own, without that of blocks inside; white space is one space."""
    place: dict[int, int] = {}
    rows: list[list] = []
    last = None
    tags = {}
    for node, parent, _, tag, style, block, text in nodes_of(page):
        tags[node] = (parent, block)
        if block != last:  # a block begins or ends here
            for b in (last, block):
                if b in place:
                    rows[place[b]][5].append(" ")
            last = block
        if block == node:
            outer = tags[parent][1] if parent is not None else None
            place[node] = len(rows)
            rows.append([len(rows), tag, int(tag[1]) if tag[0] == "h" else 0, place.get(outer), style, []])
        elif block is not None:
            rows[place[block]][5].append(" " if tag == "br" else text or "")
    return [(*r[:5], " ".join("".join(r[5]).split())) for r in rows]


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Headings, paragraphs and list items: key and the columns of blocks_of(); level of headings 1 to 6, else 0."""
    return _each(pages, key, html, blocks_of, "pos int, tag string, level int, parent_pos int, style string, text string")


_NAME = "lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
_BLOCKS = "('" + "', '".join(BLOCK) + "')"
#: html_blocks() by recursion over a page's tokens, with the open elements as a list. The style of a tag is not told apart from other attributes by quoting rules.
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT page_id, unnest(x) AS tok, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>|[^<]+|<') AS x FROM pages)),
c AS (SELECT page_id, k, n, tok, {_NAME} AS name, CASE WHEN regexp_matches(tok, '(?i)^<(!|script|style|\?)') THEN 'skip' WHEN regexp_matches(tok, '^</[a-zA-Z].*>$', 's') THEN 'end' WHEN regexp_matches(tok, '^<[a-zA-Z].*>$', 's') THEN 'tag' ELSE 'text' END AS kind FROM t),
f AS (SELECT page_id, 0::BIGINT AS k, []::VARCHAR[] AS tags, []::INT[] AS owners, 0 AS made, NULL::INT AS owner, NULL::INT AS before, NULL::INT AS begun, ''::VARCHAR AS piece, ''::VARCHAR AS tok FROM (SELECT DISTINCT page_id FROM t)
  UNION ALL SELECT page_id, k,
    CASE WHEN kind = 'end' AND spot > 0 THEN tags[: spot - 1] WHEN opens THEN list_append(tags, name) ELSE tags END,
    CASE WHEN kind = 'end' AND spot > 0 THEN owners[: spot - 1] WHEN opens THEN list_append(owners, CASE WHEN block THEN made ELSE owner END) ELSE owners END,
    made + block::INT,
    CASE WHEN kind = 'end' AND spot > 1 THEN owners[spot - 1] WHEN kind = 'end' AND spot = 1 THEN NULL WHEN block THEN made ELSE owner END,
    owner, CASE WHEN block THEN made END, CASE WHEN kind = 'text' THEN tok WHEN name = 'br' THEN ' ' ELSE '' END, tok
  FROM (SELECT f.tags, f.owners, f.made, f.owner, c.*, c.kind = 'tag' AND c.name IN {_BLOCKS} AS block, c.kind = 'tag' AND c.name NOT IN ('{"', '".join(VOID)}') AND NOT ends_with(c.tok, '/>') AS opens,
    CASE WHEN list_contains(f.tags, c.name) THEN len(f.tags) + 1 - list_position(list_reverse(f.tags), c.name) ELSE 0 END AS spot FROM f JOIN c ON c.page_id = f.page_id AND c.k = f.k + 1)),
p AS (SELECT page_id, k, owner AS pos, CASE WHEN owner IS DISTINCT FROM before THEN ' ' ELSE '' END || piece AS piece FROM f UNION ALL SELECT page_id, k, before, ' ' FROM f WHERE owner IS DISTINCT FROM before),
x AS (SELECT page_id, pos, string_agg(piece, '' ORDER BY k) AS text FROM p WHERE pos IS NOT NULL GROUP BY page_id, pos),
b AS (SELECT page_id, begun AS pos, lower(regexp_extract(tok, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, before AS parent_pos, nullif(regexp_extract(tok, 'style="([^"]*)"', 1), '') AS style FROM f WHERE begun IS NOT NULL)
SELECT b.page_id, b.pos, tag, CASE WHEN tag[1] = 'h' THEN tag[2]::INT ELSE 0 END AS level, parent_pos, style,
  trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(text, '&quot;?', '"', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b JOIN x USING (page_id, pos)
"""
