"""HTML extraction: two-pass block rules. Stop-word density, length and link density classify a page's blocks;
ambiguous blocks then inherit from the nearest decided neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import free

#: Function words by language: what prose is full of and menus, titles and listings are not.
STOP_WORDS = {
    "en": """a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in
        into is it its just like more most my no not of on one only or other our out over she should so some such than that the their them then there these they
        this those to under up was we were what when where which while who will with would you your""",
    "de": """aber als am an auch auf aus bei bin bis da das dass dem den der des die dieser diese doch du durch ein eine einem einen einer eines er es für
        hat hatte ich ihr im in ist ja kann man mehr mit nach nicht noch nur ob oder schon sein seine sich sie sind so über um und uns unter
        vom von vor war waren was wenn werden wie wird wir wurde zu zum zur""",
    "fr": """à au aussi aux avec ce ces cette comme dans de des du elle elles en entre est et était été être fait il ils je la le les leur leurs
        lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur tous tout très un une vous""",
    "es": """a al como con cuando de del desde donde el ella ellos en entre era es esta este están está fue ha había han hasta hay la las le les lo los
        más me muy ni no nos o para pero por porque que qué se ser si sin sobre son su sus también un una uno y ya""",
    "it": """a al alla anche che chi ci come con cui da dal dalla degli dei del della delle di e è gli ha hanno i il in io la le lo ma mi nel
        nella non o per più quando quello questa questo se si sono su sua suo tra un una uno""",
    "pt": """a ao aos as às até com como da das de do dos e é ela ele em entre era essa esse está eu foi há isso já mais mas na não nas no nos
        o os ou para pela pelo por que quem se sem ser seu só sua são também um uma""",
    "nl": """aan al als bij dan dat de den der deze die dit door een en er had heb heeft het hij hun ik in is je kan maar meer met na naar niet nog of
        om onder ook op over te tot uit van voor was wat we werd wie wordt zal ze zich zij zijn zo""",
}
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_WORDS = re.compile(r"[^\W\d_]+")

BLOCKS = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre
    figure figcaption address details summary fieldset legend center header""".split())  # fmt: skip
#: Elements whose whole content is no main text.
DROPPED = frozenset("""head script style noscript template nav footer aside form menu dialog select option datalist textarea button iframe object svg
    canvas audio video map""".split())  # fmt: skip
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that name what is around a text, by kind.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense adunit sponsor sponsors sponsored promo promos promotion banner",
    "menu": "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager skiplink skiplinks",
    "around": "masthead topbar header footer colophon copyright siteheader sitefooter pageheader pagefooter",
    "side": "sidebar sidebars aside widget widgets related recommended recommendations trending share sharing social sharebar",
    "notice": "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer newsletter subscribe subscription paywall login signin signup",
    "form": "form forms search searchbox searchform",
    "comment": "comment comments commentlist commentform disqus respond reply replies discussion",
    "hidden": "hidden invisible offscreen",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_NAMES = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_NOT = frozenset("has have no not without with non".split())
_CLOSES_P = BLOCKS - {"html", "body"}
_BOXES = BLOCKS - _HEADINGS - frozenset("p li dt dd tr td th pre address caption figcaption summary legend".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Blocks of fewer characters are ambiguous; from LONG on, prose needs the lower density only.
SHORT, LONG = 70, 200
PROSE, NEARLY_PROSE = 0.2, 0.12
LINKS = 0.5
#: Under this share of function words, a page is in a language that has no list: density says nothing then.
FOREIGN = 0.03


def _kind(attrs: list[tuple[str, str | None]]) -> str | None:
    """What an element's attributes say it is, if not main text."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _UNSEEN.search(value):
            return "hidden"
        if not value:
            continue
        if name == "role" and value.lower() in _ROLES:
            return "role"
        if name in ("class", "id"):
            for part in value.split():
                names = [x.lower() for x in _NAMES.findall(part)]
                for i, x in enumerate(names):
                    if i and names[i - 1] in _NOT:
                        continue
                    found = _HINT.get(x) or (_HINT.get(x + names[i + 1]) if i + 1 < len(names) else None)
                    if found and (found != "hidden" or i == len(names) - 1):  # hidden-xs is hidden on some screens
                        return found
    return None


class Block:
    """text, characters of links in it, element, number of the article and of the box (section, div, list ...) around it; kept: None if undecided."""

    __slots__ = ("text", "links", "tag", "root", "box", "kept")

    def __init__(self, text: str, links: int, tag: str, root: int, box: int, kept: bool | None = None):
        self.text, self.links, self.tag, self.root, self.box, self.kept = text, links, tag, root, box, kept


class _Reader(HTMLParser):
    """A page's blocks in order: text between block-level tags, with the characters of it that are links. What is left out by its tag or by its class, id
    or role becomes an empty block that is decided."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, str | None, int, int]] = []  # tag, why it is left out, numbers of its article (0: none) and box
        self.open: dict[str, int] = {}
        self.out, self.links, self.roots, self.root, self.boxes, self.box = 0, 0, 0, 0, 0, 0
        self.parts: list[str] = []
        self.linked = 0
        self.tag = "body"
        self.lang = ""

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.tag, self.root, self.box))
            self.parts, self.linked = [], 0
        self.tag = next((x[0] for x in reversed(self.stack) if x[0] in BLOCKS), "body")

    def push(self, tag: str, why: str | None) -> None:
        if tag in ("article", "main"):
            self.roots += 1
            self.root = self.roots
        if tag in _BOXES:
            self.boxes += 1
            self.box = self.boxes
        self.stack.append((tag, why, self.root, self.box))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        if why:
            if not self.out and not (self.blocks and self.blocks[-1].kept is False and not self.blocks[-1].text):
                self.blocks.append(Block("", 0, tag, self.root, self.box, False))
            self.out += 1
        if tag in BLOCKS:
            self.tag = tag

    def cut(self, at: int) -> None:
        """The elements of the stack from `at` on end."""
        for tag, why, _, _ in self.stack[at:]:
            self.open[tag] -= 1
            self.links -= tag == "a"
            self.out -= why is not None
        del self.stack[at:]
        self.root, self.box = self.stack[-1][2:] if self.stack else (0, 0)

    def close_(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        if self.open.get(tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    return self.cut(i)
                if self.stack[i][0] in within:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            if tag in ("br", "hr") and not self.out:
                self.parts.append(" ")
            return
        if self.open.get("head") and tag not in _IN_HEAD and tag != "head":
            self.close_("head")
        if tag == "html":
            self.lang = self.lang or next((v or "" for k, v in attrs if k == "lang"), "")[:2].lower()
        block = tag in BLOCKS or tag in DROPPED
        if not block and tag != "a" and not attrs:
            return
        if block:
            self.flush()
            if tag in _CLOSES_P or tag in DROPPED:
                self.close_("p", within=frozenset(("article", "main", "section", "div", "td", "th", "li", "body", "button", "form")))
            if tag == "li":
                self.close_("li", within=frozenset(("ul", "ol", "menu")))
            elif tag in ("td", "th", "tr"):
                for x in ("td", "th") + (("tr",) if tag == "tr" else ()):
                    self.close_(x, within=frozenset(("table",)))
            elif tag in ("dt", "dd"):
                for x in ("dt", "dd"):
                    self.close_(x, within=frozenset(("dl",)))
            elif tag == "option":
                self.close_("option", within=frozenset(("select", "datalist")))
        if tag == "a":
            self.close_("a")
        if tag in ("article", "main"):
            self.reopen(tag)
        why = None
        if tag in DROPPED:
            why = tag
        elif tag not in ("html", "body", "main") and attrs:
            why = _kind(attrs)
            if why == "around" and self.root or tag == "article" and why != "comment" and why != "hidden":
                why = None
        if tag == "header" and not self.root:
            why = why or "header"
        if block or tag == "a" or why:
            self.push(tag, why)
            if block:
                self.flush()

    def reopen(self, tag: str) -> None:
        """An article or main element ends what was opened around it and is no place for one: an unclosed menu or advert, the form that
        some servers wrap a page in. What readers write, side columns and hidden parts hold articles of their own; those stay out."""
        never = {"comment", "side", "aside", "hidden", "template", "noscript", "dialog"}
        if self.out and (tag == "main" or not any(x[1] in never for x in self.stack)):
            self.stack = [(t, None, r, b) for t, _, r, b in self.stack if t != "a"]
            self.open["a"] = self.links = self.out = 0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" and not self.out:
            self.parts.append(" ")
        if not self.open.get(tag):
            if tag in BLOCKS:
                self.flush()
            return
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        self.close_(tag)
        if tag in BLOCKS or tag in DROPPED:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> tuple[list[Block], str]:
    """The blocks of a page, undecided but for those left out, and the language that it names."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks, reader.lang


def classify(blocks: list[Block], lang: str) -> None:
    """First pass: decides blocks of links, and long ones by the density of function words; the others stay None."""
    words = [_WORDS.findall(b.text.lower()) if b.text else [] for b in blocks]
    total = sum(map(len, words))
    counts = {x: [sum(map(stops.__contains__, w)) for w in words] for x, stops in _STOPS.items() if x == lang or lang not in _STOPS}
    best = max(counts.values(), key=sum)
    foreign = total >= 20 and sum(best) < FOREIGN * total
    if foreign and lang in _STOPS:  # the page names the wrong language
        counts = {x: [sum(map(stops.__contains__, w)) for w in words] for x, stops in _STOPS.items()}
        best = max(counts.values(), key=sum)
        foreign = sum(best) < FOREIGN * total
    for b, w, n in zip(blocks, words, best):
        if b.kept is not None:
            continue
        size = len(b.text)
        if b.links > LINKS * size or "©" in b.text and size < LONG:
            b.kept = False
        elif size >= SHORT:
            density = n / len(w) if w else 0.0
            if foreign or density >= PROSE or size >= LONG and density >= NEARLY_PROSE:
                b.kept = True


def _nearest(blocks: list[Block], decided: list[int], i: int, at: int) -> bool | None:
    """The label that undecided block i inherits from decided ones (places in order; `at`: how many come before i)."""
    before, after = decided[at - 1] if at else None, decided[at] if at < len(decided) else None
    if before is None or after is None:
        return None if before is after else blocks[after if before is None else before].kept
    if blocks[i].tag in _HEADINGS:  # a heading belongs to what follows
        return blocks[after].kept
    if i - before != after - i:
        return blocks[before if i - before < after - i else after].kept
    return blocks[before].kept if blocks[before].kept == blocks[after].kept else blocks[before if blocks[before].kept else after].box == blocks[i].box


def inherit(blocks: list[Block]) -> None:
    """Second pass: an undecided block takes the label of the nearest decided one, of its own article first, else of the page; between equally near ones that
    differ it is kept if the kept one stands in the same box; headings take the label of what follows. Where nothing is decided, blocks in an article are kept, and
    all if the page has no decided block with text."""
    of: dict[int, list[int]] = {0: []}
    for i, b in enumerate(blocks):
        if b.kept is not None:
            of[0].append(i)
            if b.root and b.text:
                of.setdefault(b.root, []).append(i)
    seen = dict.fromkeys(of, 0)
    labels: list[tuple[int, bool]] = []
    any_text = any(blocks[i].text for i in of[0])
    for i, b in enumerate(blocks):
        if b.kept is None:
            label = None
            if b.root:
                own = of.get(b.root)
                label = _nearest(blocks, own, i, seen[b.root]) if own else True
            else:
                label = _nearest(blocks, of[0], i, seen[0]) if any_text else True
            labels.append((i, bool(label)))
        else:
            seen[0] += 1
            if b.root and b.text:
                seen[b.root] += 1
    for i, label in labels:
        blocks[i].kept = label


def main_text(html: str | None) -> str:
    """The text of a page's article: its blocks joined by one space. Null and empty pages: empty."""
    if not html:
        return ""
    blocks, lang = blocks_of(html)
    if not any(b.text for b in blocks):
        return ""
    classify(blocks, lang)
    inherit(blocks)
    return " ".join(b.text for b in blocks if b.kept and b.text)


def _extract(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            start, held = 0, 0
            for i, html in enumerate(batch.column(batch.num_columns - 1)):
                texts.append(main_text(html.as_py()))
                held += len(texts[-1])
                if held > most or i == batch.num_rows - 1:
                    columns = [batch.column(c).slice(start, len(texts)) for c in range(batch.num_columns - 1)]
                    columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[f"c{c}" for c in range(len(columns))])
                    texts, start, held = [], i + 1, 0

    return run


def extracted(pages: DataFrame, html_col: str = "html", most: int = 1 << 22) -> DataFrame:
    """The rows of pages without their html, and two columns more, the last ones: the article's text and its length in code points (text and
    n_chars, with underscores in front if pages has such names).

    No shuffle: each task reads its pages one by one, and hands on `most` characters at a time. A null or empty page has an empty text, as has one without main
    text. Repeated pages each keep their row; an empty table gives none. Pages are read whole, however long; unclosed and cut off elements end where HTML lets them
    end, or with the page."""
    kept = [c for c in pages.columns if c != html_col]
    text, n = free(pages.drop(html_col), "text", "n_chars")
    schema = ", ".join([f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"c{len(kept)} string", f"c{len(kept) + 1} long"])
    given = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(html_col))
    out = given.mapInArrow(_extract(most), schema)
    return out.toDF(*kept, text, n)


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
