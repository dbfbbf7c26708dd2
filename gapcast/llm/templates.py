"""Main text of pages by equivalence classes of template tokens.

1. A page is read into blocks: runs of text between block-level tags, each with the path of
   its open block-level tags. Paths and (path, text) pairs are the tokens.
2. Tokens of a host with the same occurrence vector, that is the same number of occurrences
   on each of its pages, form an equivalence class. Vectors are compared by a sum of hashes
   of (page, count), so no host's pages are gathered.
3. Classes of at least two tokens on at least two pages and half of the host's pages (those
   with any text) are large and frequent. They are valid if they are ordered and nested
   (``valid_classes``): tokens that change places with others of their class leave it, and of
   two classes that interleave, or where one stands in several slots of the other, the smaller
   is dropped. This is told from the sequence of such tokens on each page, of which a host
   has few different ones.
4. The texts of valid classes are the template, whatever the other pages are. What remains
   are slots. Of these, the main text takes
   those under an article or main element if the page has one, and there the class decides
   nothing, as an article that is copied all over a host is still an article. Else it takes those
   not under menus, headers, footers, sidebars, notices, adverts, forms or comments, which are
   told by tag, role, class and id. A page without any slot, as on a host of copies, is not split.

Null or empty html gives empty text. A page without a host is a template of its own kind
with those alike. Repeated rows are pages of their own. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.url_lists import host_of
from gapcast.plans.scratch import store

SHARE = 0.5  # of a host's pages
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|math|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCK = frozenset(
    "html head body nav header footer aside main article section div ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption p h1 h2 h3 h4 h5 h6 blockquote pre form fieldset figure figcaption address details summary dialog menu center".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li td th tr".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("head nav header footer aside form fieldset menu dialog button figcaption".split())
#: What a class, id or role says of an element, as the whole name, its beginning or its end.
BESIDE = (
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu\w*|nav\w*|breadcrumbs?|footer|sidebar|side|aside|widget\w*|"
    r"cookies?\w*|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|"
    r"recommend\w*|comments?|commentlist|comment\w*|respon[sd]\w*|replies|reply|disqus|copyright|legal|toolbar|pagination|"
    r"pager|skip|hidden|banner|complementary|navigation|contentinfo)"
)
MARKS = re.compile(rf"{BESIDE}(?:[_-].*)?|(?!(?:has|no|not|with|without|is)[_-]).*[_-]{BESIDE}", re.I | re.S)
HEAD = re.compile(r"(?:.*[_-])?header(?:[_-].*)?", re.I | re.S)
#: An article as a whole is only beside the text if it is a reader's.
READER = re.compile(r"comments?|reply|replies|responses?", re.I)
NEVER = frozenset("html body main".split())


def beside_by_name(tag: str, names: list[str], main: bool) -> bool:
    """Whether an element's names put it beside the main text; ``main`` if it stands in a main element."""
    if tag in NEVER:
        return False
    if tag == "article":
        return any(READER.fullmatch(n) for n in names)
    return any(MARKS.fullmatch(n) or (not main and HEAD.fullmatch(n)) for n in names)


class Block:
    """A block's path, text, and whether it is in the main element or beside the main text."""

    __slots__ = ("path", "text", "main", "beside")

    def __init__(self, path: str, text: str, main: bool, beside: bool):
        self.path, self.text, self.main, self.beside = path, text, main, beside


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; white space is one space, character references are decoded."""
    found: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, in the main element, beside
    text: list[str] = []

    def end() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            _, path, main, beside = stack[-1] if stack else ("", "", False, False)
            found.append(Block(path, words, main, beside))

    for token in TOKEN.finditer(page):
        raw = token.group()
        closing, tag = token.group(2), (token.group(3) or "").lower()
        if raw[0] != "<" or raw == "<":
            text.append(raw)
        elif tag in ("br", "wbr"):
            text.append(" ")
        elif tag == "hr":
            end()
        elif tag not in BLOCK:
            continue
        elif closing:
            end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            end()
            if tag in PLAIN or tag in BLOCK:
                while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
            if stack and stack[-1][0] == tag and tag in PLAIN:
                stack.pop()
            named = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(token.group(4) or "")}
            marks = re.sub(r"\d+", "0", " ".join(named.get(n, "") for n in ("class", "id", "role")).strip().lower())
            _, path, main, beside = stack[-1] if stack else ("", "", False, False)
            is_main = tag in MAIN or named.get("role", "").lower() == "main"
            names = " ".join(named.get(n, "") for n in ("class", "id", "role")).split()
            is_beside = (tag in ASIDE and not (main and tag in ("header", "figcaption"))) or beside_by_name(tag, names, main)
            stack.append((tag, f"{path}>{tag}{'.' + marks if marks else ''}", main or is_main, beside or is_beside))
    end()
    return found


def token_hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _vector_part(page: int, count: int) -> int:
    return token_hash(str(page), str(count)) >> 20  # room for the sum over 2^19 pages and more, modulo 2^64 beyond


def tokens(pages: DataFrame) -> DataFrame:
    """(host, kind, token, path, vector, pages): occurrence vectors of paths and texts for each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, int, str], list[int]] = {}
            for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = blocks(page or "")
                # The root of a page, if there is anything on it.
                counts: Counter[tuple[str, int, str]] = Counter({("path", token_hash(""), ""): 1} if found else {})
                for b in found:
                    steps = b.path.split(">")
                    for k in range(2, len(steps) + 1):
                        path = ">".join(steps[:k])
                        counts["path", token_hash(path), path] += k == len(steps)
                    counts["text", token_hash(b.path, b.text), b.path] += 1
                for (kind, token, path), n in counts.items():
                    entry = sums.setdefault((host, kind, token, path), [0, 0])
                    entry[0] += _vector_part(key, n)
                    entry[1] += 1
            rows = [(*k, (v + 2**63) % 2**64 - 2**63, n) for k, (v, n) in sums.items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(made, names=["host", "kind", "token", "path", "vector", "pages"])

    parsed = _keyed(pages).select("host", "key", "html").mapInArrow(
        run, "host string, kind string, token bigint, path string, vector bigint, pages bigint"
    )
    # Sums of 44-bit numbers, as decimals so that they can't overflow.
    total = F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector")
    return parsed.groupBy("host", "kind", "token", "path").agg(total, F.sum("pages").alias("pages"))


def _keyed(pages: DataFrame) -> DataFrame:
    key = F.xxhash64(F.col("page_id").cast("string"), "url", "html")
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), key.alias("key"), "html")


def templates(found: DataFrame) -> DataFrame:
    """(host, vector, pages, paths, inside): valid classes of ``tokens``, and the path each is nested in."""
    paths = found.where("kind = 'path' AND path <> ''")
    classes = paths.groupBy("host", "vector", "pages").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    valid = classes.where((F.size("paths") >= 2) & (F.col("pages") >= 2))
    outer = F.regexp_replace(F.col("paths")[0], r">[^>]*$", "")
    return valid.select("host", "vector", "pages", "paths", outer.alias("inside"))


def frequent_classes(found: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``tokens`` in classes of two tokens or more on ``share`` of the host's pages; ``size`` is the class's.

    Such tokens are at most 1 / share times as many as a page has, which bounds a host's list.
    """
    hosts = found.where("kind = 'path' AND path = ''").select(F.col("host").alias("of"), F.col("pages").alias("all"))
    frequent = found.join(hosts, F.col("host") == F.col("of")).where((F.col("pages") >= 2) & (F.col("pages") >= share * F.col("all")))
    return _large(frequent.select("host", "kind", "token", "vector"))


def _large(members: DataFrame) -> DataFrame:
    """Members of classes of two tokens or more, with the class's size."""
    sizes = members.groupBy("host", "vector").agg(F.count("*").alias("size")).where("size >= 2")
    sizes = sizes.withColumnsRenamed({"host": "of", "vector": "class"})
    return members.drop("size").join(sizes, (F.col("host") == F.col("of")) & (F.col("vector") == F.col("class"))).drop("of", "class")


def fixed_texts(found: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, fixed): the texts of large and frequent classes."""
    return _texts(frequent_classes(found, share))


def _texts(members: DataFrame) -> DataFrame:
    return members.where("kind = 'text'").groupBy("host").agg(F.collect_list("token").alias("fixed"))


def occurrences(found: list[Block]) -> list[int]:
    """The tokens of a page in order: each block's path and text, and paths without own blocks where they begin."""
    direct, seen = {b.path for b in found}, set()
    out = [token_hash("")] if found else []
    for b in found:
        steps = b.path.split(">")
        for k in range(2, len(steps) + 1):
            path = ">".join(steps[:k])
            if k == len(steps) or not (path in direct or path in seen):
                seen.add(path)
                out.append(token_hash(path))
        out.append(token_hash(b.path, b.text))
    return out


def _by_host(rows: DataFrame, members: DataFrame, function, out: str) -> DataFrame:
    """``function`` of the second column of ``rows`` and the (token, class) pairs of its host; equal results of a batch once."""
    listed = F.collect_list(F.struct("token", F.col("vector").cast("string").alias("class"))).alias("members")
    lists = members.groupBy(F.col("host").alias("of")).agg(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps: dict[str, dict[int, str]] = {}
            made: dict[tuple, None] = {}
            for host, value, pairs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if host not in maps:
                    maps[host] = {p["token"]: p["class"] for p in pairs.as_py()}
                made |= dict.fromkeys((host, *row) for row in function(value.as_py(), maps[host]))
            columns = list(zip(*made)) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    names = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    kinds = {c.split()[0]: names[c.split()[1]] for c in out.split(", ")}
    value = rows.columns[1]
    return rows.join(lists, F.col("host") == F.col("of")).select("host", value, "members").mapInArrow(run, out)


def _sequence(page: str | None, of: dict[int, str]) -> Iterator[tuple]:
    """The page's tokens that are in a class."""
    yield (tuple(t for t in occurrences(blocks(page or "")) if t in of),)


def _class_places(sequence: list[int], of: dict[int, str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, token in enumerate(sequence):
        if token in of:
            places.setdefault(of[token], []).append(i)
    return places


def _ranks(sequence: list[int], of: dict[int, str]) -> Iterator[tuple]:
    """(token, rank): the place of each occurrence in its round of the class."""
    sizes = Counter(of.values())
    for name, places in _class_places(sequence, of).items():
        for i, place in enumerate(places):
            yield sequence[place], i % sizes[name]


def _slots(sequence: list[int], of: dict[int, str]) -> Iterator[tuple]:
    """(vector, outer, slot): where each round of a class stands in each larger class, 0 outside and -1 if across its tokens."""
    sizes = Counter(of.values())
    places = _class_places(sequence, of)
    for outer, around in places.items():
        for name, at in places.items():
            n, m = sizes[name], sizes[outer]
            if (m, outer) > (n, name):
                for i in range(0, len(at), n):
                    first, last = bisect(around, at[i]), bisect(around, at[min(i + n, len(at)) - 1])
                    yield name, outer, first % m if first == last else -1


def valid_classes(pages: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` without tokens that are out of order in their class, and without classes that are not nested."""
    rows = _keyed(pages).select("host", "html")
    sequences = store(_by_host(rows, members, _sequence, "host string, sequence array<bigint>").distinct(), "sequences")
    ranks = _by_host(sequences, members, _ranks, "host string, token bigint, rank bigint").groupBy("host", "token")
    steady = ranks.agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low = high").select("host", "token")
    ordered = store(_large(members.join(steady, ["host", "token"]).select(*members.columns)), "ordered")
    slots = _by_host(sequences, ordered, _slots, "host string, vector string, outer string, slot bigint")
    slots = slots.groupBy("host", "vector", "outer").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    crossing = slots.where("low < 0 OR low < high").select(F.col("host").alias("of"), F.col("vector").alias("class")).distinct()
    same = (F.col("host") == F.col("of")) & (F.col("vector").cast("string") == F.col("class"))
    return ordered.join(crossing, same, "left_anti")


def main_text(page: str, fixed: frozenset[int]) -> str:
    """The blocks of the main text, joined by two line breaks."""
    found = blocks(page)
    in_main = any(b.main and not b.beside for b in found)
    if in_main:
        return "\n\n".join(b.text for b in found if b.main and not b.beside)
    slots = [b for b in found if not fixed or token_hash(b.path, b.text) not in fixed]
    return "\n\n".join(b.text for b in slots or found if not b.beside)


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    members = store(frequent_classes(store(tokens(pages), "tokens"), share), "classes")
    fixed = store(_texts(valid_classes(pages, members)), "fixed-texts").withColumnRenamed("host", "of")
    rows = _keyed(pages).join(fixed, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, frozenset[int]] = {}
            texts = []
            hosts, fixed_lists = batch.column(3).to_pylist(), batch.column(4)
            for i, page in enumerate(batch.column(2)):
                if hosts[i] not in sets:
                    sets[hosts[i]] = frozenset(fixed_lists[i].as_py() or ())
                texts.append(main_text(page.as_py() or "", sets[hosts[i]]))
            sizes = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
