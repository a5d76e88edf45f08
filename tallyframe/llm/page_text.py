"""Main text of pages by template deduction: equivalence classes of tokens across the pages of a host.

A page is a sequence of tokens: elements, told apart by their role, the path of elements around them with classes,
ids and ARIA roles (parts with digits left out), and texts, told apart by the element around them. Tokens of a host with
equal occurrence vectors (the counts on each page, held as summed fingerprints, so that a host of any size is summed up
in parts) form a class. A class is valid if its tokens occur once on each page that has them, on a tenth of the
host's pages at least, and in one order on all of them; an element is the pair of its opening and its end, so
elements of valid classes nest by their paths. Nested, they are the host's template.

The template cuts a page into slots, and what slots hold is summed up over the host: from the page down, the template's
container that holds most of the text takes over as long as it holds half of it and leaves no heading behind that varies
over the pages; where that ends is the main element. Names of elements and words in classes break ties only:
navigation, adverts, comments and the like never take over, and the walk ends at an article.

The text of a page is what the slots of the main element hold, without scripts, styles, and the elements in it that
are named as navigation, forms, asides, adverts or comments. A block of the template in it with a class, id or role goes
if all its texts are constant words (on half of the host's pages, and three at least), unless nothing would be left;
constant words elsewhere in it stay. A page without the main element gives what is in none of the template's other
elements with such names, without constant words. A host without a template gives all its text.

Blocks are joined in page order by one space, character references are decoded, white space inside a block is
one space. A null page is empty and gives the empty text. Rows without a url form one host. Pages repeated are
rows of their own. Templates are broadcast up to ``MOST_TEMPLATE_TOKENS``, else joined by host, each host dealt to
``SALTS`` parts.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import SALTS, columns, renamed, salt, slices, texts, written

MOST_TEMPLATE_TOKENS = 1_000_000
LEAST_SHARE = 10  # one page in so many

# The names of elements.
#: What these hold is no text: the first run to their end or the page's, the others to their end, if there is one.
ENDLESS = ("script", "style", "textarea", "title")
RAW = (*ENDLESS, "noscript", "template", "iframe", "svg", "select")
OUT = {"nav", "footer", "header", "aside", "form", "menu", "button", "dialog", "head", *RAW}
MAIN = {"article", "main"}
#: What can hold an article, and what heads one.
CONTAINERS = {"html", "body", "div", "section", "td", "center", *MAIN}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends, if only inline elements, paragraphs and plain divisions are open since.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Block elements that end an open paragraph.
ENDS_P = set("address article aside blockquote center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that name what is not the article.
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|nav|navbar|navigation|newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsored|subscribe)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*>", re.S | re.I
)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) in page order: kinds open, close, raw and text. For open tags the content is the
    class and id; comments and declarations are left out."""
    at = 0
    unended: set[str] = set()  # names of RAW with no end in the rest of the page
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at, tag = m.end(), m[0]
        if m["raw"]:
            raw = m["raw"].lower()
            if raw in ENDLESS or not tag.endswith("/>"):
                stop = None if raw in unended else _END[raw].search(page, at)
                if stop is not None:
                    at = stop.end()
                else:
                    unended.add(raw)
                    at = len(page) if raw in ENDLESS else at
            yield "raw", raw, ""
        elif (name := _NAME.match(tag)) is not None:
            if tag[1] == "/":
                yield "close", name[1].lower(), ""
            else:
                marks = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _MARK.findall(tag)) if "=" in tag else ""
                yield "open", name[1].lower(), marks
    if at < len(page):
        yield "text", "", page[at:]


@lru_cache(20_000)
def _named_out(name: str, marks: str) -> bool:
    return name in OUT or bool(marks and OUT_NAMES.search(" ".join(x.split("=", 1)[-1] for x in marks.split())))


@lru_cache(20_000)
def role(above: int, name: str, marks: str) -> int:
    """An element's role: a positive number from its path."""
    kept = " ".join(w for w in marks.split() if not any(c.isdigit() for c in w))
    return 1 + (xxhash.xxh3_64_intdigest(f"{above} {name} {kept}") >> 2)


def text_key(above: int, content: str) -> int:
    return -1 - (xxhash.xxh3_64_intdigest(content.strip(), above) >> 2)


def walk(page: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, key, name, content) in page order. Kinds: open and close of a block, with its role, and for open its marks;
    text, with the role of the block around it; break and edge (of an inline element that ends a word or not). Ends
    that pages leave out are put in."""
    path: list[tuple[str, int, bool]] = []  # name, role (the block around an inline element's), named out
    opened: Counter[str] = Counter()
    out: list[tuple[str, int, str, str]] = []

    def pop(at: int) -> None:
        while len(path) > at:
            name, key, flagged = path.pop()
            opened[name] -= 1
            if flagged or name not in INLINE:
                out.append(("close", key, name, ""))

    def end(names: set[str], through: set[str]) -> None:
        """Close the innermost of ``names`` with what is in it, if only elements of ``through`` are."""
        for at in range(len(path) - 1, -1, -1):
            if path[at][0] in names:
                return pop(at)
            if path[at][0] not in through:
                return None

    for kind, name, content in tokens(page):
        here = path[-1][1] if path else 0
        if kind == "text":
            out.append(("text", here, "", content))
        elif kind == "raw" or name == "br":
            out.append(("break", here, name, ""))
        elif kind == "open":
            if name in ENDS_P and opened["p"]:
                end({"p"}, INLINE)
            if name in ENDS and any(opened[n] for n in ENDS[name]):
                end(ENDS[name], INLINE | {"p", "div", "address"})
            if name in MAIN and not any(opened[n] for n in MAIN):
                # An article ends an advert or the like that was left open before it.
                pop(next((i for i, x in enumerate(path) if x[2]), len(path)))
            here = path[-1][1] if path else 0
            if name in VOID:
                if name not in INLINE:
                    out.append(("edge", here, name, ""))
            elif name in INLINE:
                path.append((name, here, False))
                opened[name] += 1
                if _named_out(name, content):
                    path[-1] = (name, here, True)
                    out.append(("open", role(here, name, content), name, content))
            else:
                key = role(here, name, content)
                path.append((name, key, _named_out(name, content)))
                opened[name] += 1
                out.append(("open", key, name, content))
        elif opened[name]:
            at = next(i for i in range(len(path) - 1, -1, -1) if path[i][0] == name)
            if name in INLINE and any(p[0] not in INLINE for p in path[at + 1 :]):
                # The end of an inline element leaves blocks opened in it open; one that is named out goes on around them.
                if not path[at][2]:
                    del path[at]
                    opened[name] -= 1
            else:
                pop(at)
        if out:
            yield from out
            out.clear()
    pop(0)
    yield from out


class Template:
    """A host's template: the class of each of its elements and constant texts, and its main element (0: none)."""

    def __init__(self, classes: dict[int, int], main: int = 0) -> None:
        self.classes, self.main = classes, main
        self.has_words = any(k < 0 for k in classes)

    def constant(self, above: int, content: str) -> bool:
        """Whether a text is constant words of the host."""
        return self.has_words and text_key(above, content) in self.classes

    def __contains__(self, key: int) -> bool:
        return key in self.classes


def main_text(page: str, template: Template) -> str:
    """The text that the slots of the template's main element hold."""
    parts = list(walk(page))
    has_main = any(k == "open" and key == template.main for k, key, _, _ in parts)
    blocks: list[str] = []
    block: list[str] = []
    cut: list[int] = []  # blocks of constant slots
    # Open blocks: whether it is no text, whether it is the main element, and of a template's block the first block of
    # text in it and how many texts varied before.
    path: list[tuple[bool, bool, tuple[int, int] | None]] = []
    out = main = slots = varied = 0
    any_template = bool(template.classes)

    def flush() -> None:
        if text := " ".join("".join(block).split()):
            blocks.append(text)
        block.clear()

    for kind, key, name, content in parts:
        if kind == "text":
            if not out and (main or not has_main):
                blank = content.isspace()
                constant = not blank and template.constant(key, content)
                varied += bool(slots and not blank and not constant)
                if main or not constant:
                    block.append(html.unescape(content))
        elif kind == "break":
            if name == "br":
                block.append(" ")
            else:
                flush()
        elif kind == "edge":
            flush()
        elif kind == "open":
            if name not in INLINE:
                flush()
            is_main = key == template.main and not main
            inside = main or not has_main
            drop = any_template and not is_main and inside and _named_out(name, content) and not (name == "header" and main)
            slot = (len(blocks), varied) if inside and not is_main and not out and not drop and content and name not in INLINE and key in template else None
            path.append((drop, is_main, slot))
            out, main, slots = out + drop, main + is_main, slots + (slot is not None)
        elif path:
            if name not in INLINE:
                flush()
            drop, was_main, slot = path.pop()
            out, main, slots = out - drop, main - was_main, slots - (slot is not None)
            if slot is not None and slot[1] == varied:
                cut.extend(range(slot[0], len(blocks)))
    flush()
    gone = set(cut)
    return " ".join([b for i, b in enumerate(blocks) if i not in gone] or blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def count_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, above, name, n, pages, one, two) by host and token; token 0 counts a host's pages. ``one`` and ``two`` are
    the occurrence vector's fingerprint."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "html", 1 << 22):
            found: dict[tuple[str, int], list] = {}
            for host, t in zip(columns(batch, ["host"])[0].to_pylist(), texts(batch, "html"), strict=True):
                page = xxhash.xxh3_128_intdigest(t or b"")
                one, two = page & 0x7FFFFFFF, (page >> 64) & 0x7FFFFFFF
                seen: dict[int, list] = {0: [1, 0, ""]}
                around = [0]
                for kind, key, name, content in walk((t or b"").decode(errors="replace")):
                    if kind == "text" and not content.isspace():
                        seen.setdefault(text_key(key, content), [0, key, ""])[0] += 1
                    elif kind == "open":
                        if name not in INLINE:
                            mark = "-" if _named_out(name, content) else ""
                            seen.setdefault(key, [0, around[-1], mark + name])[0] += 1
                            around.append(key)
                    elif kind == "close" and name not in INLINE:
                        around.pop()
                for key, (n, above, name) in seen.items():
                    row = found.setdefault((host, key), [above, name, 0, 0, 0, 0])
                    row[2] += n
                    row[3] += 1
                    row[4] += one * n
                    row[5] += two * n
            if found:
                rows = [(*k, *v) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=_COUNTED)

    counted = pages.select("host", "html").mapInArrow(count, "host string, token long, above long, name string, n long, pages long, one long, two long")
    sums = [F.sum(c).alias(c) for c in ("n", "pages", "one", "two")]
    return counted.groupBy("host", "token").agg(F.min("above").alias("above"), F.min("name").alias("name"), *sums)


_COUNTED = ["host", "token", "above", "name", "n", "pages", "one", "two"]


def candidates(pages: DataFrame) -> DataFrame:
    """(host, token, above, name, class) of the classes that occur as valid ones do; their order is not known yet."""
    once = written(count_tokens(pages).where("n = pages"), "tokens-once")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
    sizes = once.where("token = 0").select("host", F.col("pages").alias("all_pages"), parts)
    dealt = once.where("token <> 0").withColumn("part", salt("token")).join(sizes, ["host", "part"])
    dealt = dealt.where(F.col("pages") * LEAST_SHARE >= F.col("all_pages")).withColumn("class", F.xxhash64("one", "two", "pages"))
    # A class of one element is no template of its own, unless it is on every page.
    big = dealt.where("token > 0").groupBy("host", "class").agg(F.count(F.lit(1)).alias("members"))
    kept = dealt.join(big, ["host", "class"], "left")
    element = (F.col("token") > 0) & ((F.col("members") > 1) | (F.col("pages") == F.col("all_pages")))
    constant = (F.col("token") < 0) & (F.col("pages") > 2) & (F.col("pages") * 2 >= F.col("all_pages"))
    return kept.where(element | constant).select("host", "token", "above", "name", "class")


Lookup = Callable[[pa.RecordBatch], list[Template]]


def _shipped(rows: DataFrame, listed: DataFrame, most_tokens: int) -> tuple[DataFrame, Lookup]:
    """The rows, and what finds the template of each row of a batch; ``listed`` has (host, tokens, classes, main)."""
    total = listed.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if total <= most_tokens:
        by_host = {r.host: (r.tokens, r.classes, r.main) for r in listed.toLocalIterator()}
        shipped = rows.sparkSession.sparkContext.broadcast(by_host)
        built: dict[str, Template] = {}

        def find(batch: pa.RecordBatch) -> list[Template]:
            hosts = columns(batch, ["pt_host"])[0].to_pylist()
            for h in set(hosts) - built.keys():
                tokens_, classes, main = shipped.value.get(h, ((), (), 0))
                built[h] = Template(dict(zip(tokens_, classes, strict=True)), main)
            return [built[h] for h in hosts]

        return rows, find
    spread = listed.select(F.col("host").alias("pt_host"), "tokens", "classes", "main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("pt_part"))
    joined = rows.withColumn("pt_part", salt("pt_html")).join(spread, ["pt_host", "pt_part"], "left").drop("pt_part")

    def own(batch: pa.RecordBatch) -> list[Template]:
        known: dict[str, Template] = {}
        hosts = columns(batch, ["pt_host"])[0].to_pylist()
        for i, h in enumerate(hosts):
            if h not in known:
                t, c, m = (x[i].as_py() for x in columns(batch, ["tokens", "classes", "main"]))
                known[h] = Template(dict(zip(t or (), c or (), strict=True)), m or 0)
        return [known[h] for h in hosts]

    return joined, own


def _listed(found: DataFrame) -> DataFrame:
    """A row for each host. A host's tokens are few: each is on a tenth of its pages."""
    return found.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("t"), F.max(F.col("main")).alias("main")).select(
        "host", F.col("t.token").alias("tokens"), F.col("t.class").alias("classes"), "main"
    )


def templates(rows: DataFrame, most_tokens: int = MOST_TEMPLATE_TOKENS) -> DataFrame:
    """(host, token, class, main) of the valid classes of every host. ``rows`` has pt_host and pt_html."""
    found = written(candidates(rows.select(F.col("pt_host").alias("host"), F.col("pt_html").alias("html"))), "template-candidates")
    shipped, find = _shipped(rows.select("pt_host", "pt_html"), _listed(found.withColumn("main", F.lit(0).cast("long"))), most_tokens)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By host: the order of each class on pages, as (class, order, 0), and what template elements hold, as (0, element, characters)."""
        for batch in slices(batches, 512, "pt_html", 1 << 22):
            sums: Counter[tuple[str, int, int]] = Counter()
            hosts = columns(batch, ["pt_host"])[0].to_pylist()
            for host, t, known in zip(hosts, texts(batch, "pt_html"), find(batch), strict=True):
                orders: defaultdict[int, list[int]] = defaultdict(list)
                around = [0]
                for kind, key, name, content in walk((t or b"").decode(errors="replace")):
                    if kind == "text":
                        sums[host, 0, around[-1]] += len(content) if not content.isspace() else 0
                        if known.constant(key, content):
                            key = text_key(key, content)
                            orders[known.classes[key]].append(key)
                    elif kind == "open" and name not in INLINE:
                        if key in known:
                            orders[known.classes[key]].append(key)
                        around.append(key if key in known else around[-1])
                    elif kind == "close" and name not in INLINE:
                        around.pop()
                for c, order in orders.items():
                    sums[host, c, xxhash.xxh3_64_intdigest(str(order)) >> 1] += 0
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*k, v) for k, v in sums.items()], strict=True)], names=["host", "class", "what", "chars"])

    measured = written(shipped.mapInArrow(measure, "host string, class long, what long, chars long").groupBy("host", "class", "what").agg(F.sum("chars").alias("chars")), "template-slots")
    unordered = measured.where("class <> 0").groupBy("host", "class").agg(F.count(F.lit(1)).alias("orders")).where("orders > 1")
    valid = found.join(unordered, ["host", "class"], "left_anti").withColumn("ok", F.lit(True))
    held = measured.where("class = 0").select("host", F.col("what").alias("token"), "chars")
    tree = found.join(valid.select("host", "token", "ok"), ["host", "token"], "left").join(held, ["host", "token"], "full")
    none = {"above": 0, "name": "", "class": 0, "chars": 0, "ok": False}
    tree = tree.select("host", "token", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in none.items()])
    return tree.groupBy("host").applyInPandas(_deduce, "host string, token long, class long, main long")


def _deduce(tree: pd.DataFrame) -> pd.DataFrame:
    """A host's valid tokens with its main element."""
    classes = dict(zip(tree["token"], tree["class"], strict=True))
    rows = {int(r.token): r for r in tree.rename(columns={"class": "kind"}).itertuples(index=False)}
    elements = {k: r for k, r in rows.items() if k > 0}
    valid = {k for k, r in rows.items() if r.ok}

    def up(k: int) -> int:
        """The closest valid element around one."""
        while k and k not in valid:
            k = int(elements[k].above) if k in elements else 0
        return k

    around = {k: up(int(r.above)) for k, r in elements.items() if k in valid}
    own: Counter[int] = Counter()
    for k, r in rows.items():
        if k >= 0:
            own[up(k)] += int(r.chars)
    below: defaultdict[int, list[int]] = defaultdict(list)
    for k, above in around.items():
        below[above].append(k)
    out = {k for k in around if elements[k].name.startswith("-")}
    constant = {int(r.above) for k, r in rows.items() if k < 0 and k in valid}

    def held(k: int) -> int:
        total, todo = 0, [k]
        while todo:
            k = todo.pop()
            total += own[k]
            todo += [c for c in below[k] if c not in out]
        return total

    main = 0
    while not main or elements[main].name not in MAIN:
        inner = sorted((-held(c), c) for c in below[main] if c not in out and elements[c].name in CONTAINERS)
        heads = main and any(elements[c].name in HEADINGS and c not in constant for c in below[main])
        if not inner or heads or -2 * inner[0][0] < held(main):
            break
        main = inner[0][1]
    main = 0 if main and elements[main].name in ("html", "body") else main
    kept = sorted(valid)
    return pd.DataFrame({"host": tree["host"].iloc[0], "token": kept, "class": [classes[k] for k in kept], "main": main})


def extract(pages: DataFrame, carry: list[str], url_col: str = "url", html_col: str = "html", most_tokens: int = MOST_TEMPLATE_TOKENS) -> DataFrame:
    """Columns ``carry`` of every page, whatever their names, then pt_text."""
    plain, kept = renamed(pages, carry)
    url, body = (plain.columns[pages.columns.index(c)] for c in (url_col, html_col))
    rows = plain.select(*kept, host_of(F.col(url).cast("string")).alias("pt_host"), F.col(body).cast("string").alias("pt_html"))
    found = written(templates(rows, most_tokens), "templates")
    shipped, find = _shipped(rows, _listed(found), most_tokens)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("pt_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "pt_html", 1 << 22):
            got = [main_text((t or b"").decode(errors="replace"), k) for t, k in zip(texts(batch, "pt_html"), find(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns(batch, kept), pa.array(got, pa.string())], names=schema.names)

    return shipped.mapInArrow(run, schema).toDF(*carry, "pt_text")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("pt_text").alias("text"), F.length("pt_text").cast("long").alias("n_chars"))
