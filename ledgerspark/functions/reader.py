"""A description's HTML as blocks to read: headings, paragraphs and list items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matches import let

#: Elements that are dropped with all they hold, elements that part blocks, and marks of typed lists.
DROPPED = ("script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math", "head", "title", "select", "textarea", "button", "form")
BLOCKS = (
    "p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote", "pre", "ul", "ol", "dl", "dt", "dd",
    "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption", "hr", "address", "center",
)
BULLET = r"^[•·●▪◦‣∙*–-]\s+"
#: Entities by name; numeric ones are decoded, too.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "middot": "·", "trade": "™", "reg": "®", "copy": "©",
    "eacute": "é", "egrave": "è", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "uuml": "ü", "ouml": "ö", "auml": "ä", "ccedil": "ç", "deg": "°", "plusmn": "±", "times": "×", "zwnj": "", "zwj": "", "shy": "", "ensp": " ", "emsp": " ", "thinsp": " ",
}
#: The longest text that is a heading by emphasis, and by a colon.
LONGEST_BOLD, LONGEST_COLON = 90, 60

#: Marks, which are no characters of any text: PART and a letter begin a block, STRONG and WEAK emphasis and its end, GONE is any other tag.
PART, STRONG, WEAK, GONE, OPEN, CLOSE = "﷒", "﷓", "﷔", "﷕", "﷖", "﷗"
_tag = lambda names, closing: rf"(?i)<\s*{closing}\s*(?:{names})(?![a-z0-9-])[^>]*>"
#: (pattern, what it becomes). h, i and p begin blocks of these kinds; o goes on with a list item, and b with anything but a heading.
STEPS = [
    (r"(?s)<!--.*?(?:-->|$)", " "), *((rf"(?is)<{name}\b.*?(?:</{name}\s*>|$)", " ") for name in DROPPED),
    (_tag("h[1-6]", ""), PART + "h"), (_tag("li", ""), PART + "i"), (_tag("h[1-6]|li", "/"), PART + "p"), (_tag("br", "/?"), PART + "b"), (_tag("|".join(BLOCKS), ""), PART + "o"), (_tag("|".join(BLOCKS), "/"), PART + "p"),
    (_tag("strong|b", ""), STRONG), (_tag("strong|b", "/"), WEAK), (r"(?i)<\s*/?\s*[a-z][^>]*>", GONE),
]


def entities(text: Column) -> Column:
    """text with its entities decoded once: by name, whatever the case, and by number; unknown names stay, impossible numbers go."""
    names = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def char(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")

    def decoded(part: Column) -> Column:
        name = F.lower(F.substring_index(part, CLOSE, 1))
        number = F.when(name.startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("long")).when(name.startswith("#"), F.substr(name, F.lit(2)).try_cast("long"))
        value = F.when(name.startswith("#"), F.coalesce(char(number), F.lit(""))).otherwise(F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), F.substring_index(part, CLOSE, 1), F.lit(";"))))
        return F.concat(value, F.substr(part, F.length(F.substring_index(part, CLOSE, 1)) + 2))

    marked = F.split(F.regexp_replace(text, "(?i)&(#x[0-9a-f]+|#[0-9]+|[a-z]+);", f"{OPEN}$1{CLOSE}"), OPEN, -1)
    return F.when(F.contains(text, F.lit("&")), let(marked, lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), "")))).otherwise(text)


def blocks(html: Column) -> Column:
    """(kind, text) of each block with text, in order. Paragraphs that are all emphasis or end with a colon are headings where
    they are short, without the colon; typed bullets make items; a block within an item goes on with it."""
    out = F.concat(F.lit(PART + "p"), html)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    visible = lambda t: F.length(F.regexp_replace(t, rf"(?U)[\s{STRONG}{WEAK}{GONE}]", ""))

    def strong(depth: Column, part: Column) -> tuple[Column, Column]:
        """Of a block that begins with so much emphasis: how much it ends with, and how many visible characters have some."""
        none = F.struct(depth.alias("depth"), F.lit(0).alias("n"))

        def run(so_far: Column, s: Column) -> Column:
            now = F.when(s.startswith(STRONG), so_far["depth"] + 1).when(s.startswith(WEAK), F.greatest(so_far["depth"] - 1, F.lit(0))).otherwise(so_far["depth"])
            return F.struct(now.alias("depth"), (so_far["n"] + F.when(now > 0, visible(s)).otherwise(0)).alias("n"))

        return F.aggregate(F.split(part, f"(?=[{STRONG}{WEAK}])", -1), none, run)

    def read(so_far: Column, part: Column) -> Column:
        mark, text = F.left(part, F.lit(1)), entities(F.substr(part, F.lit(2)))
        kind = F.when(mark == "h", "heading").when(mark == "i", "item").when(mark.isin("o", "b") & (so_far["kind"] == "item"), "item").otherwise("paragraph")
        said = strong(so_far["depth"], text)
        shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"[{STRONG}{WEAK}{GONE}]", ""), r"(?U)\s+", " "), "^ | $", "")
        block = F.struct(kind.alias("kind"), shown.alias("text"), (said["n"] >= visible(shown)).alias("strong"))
        return F.struct(kind.alias("kind"), said["depth"].alias("depth"), F.when(shown != "", F.concat(so_far["blocks"], F.array(block))).otherwise(so_far["blocks"]).alias("blocks"))

    none = F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("depth"), F.array().cast("array<struct<kind:string,text:string,strong:boolean>>").alias("blocks"))
    parts = F.slice(F.split(out, PART, -1), F.lit(2), F.length(out) + 1)
    found = F.aggregate(parts, none, read, lambda s: s["blocks"])
    plain = lambda b: b["kind"] == "paragraph"
    item = lambda b: plain(b) & b["text"].rlike("(?U)" + BULLET)
    bold = lambda b: (F.length(b["text"]) <= LONGEST_BOLD) & b["strong"] & ~b["text"].rlike("[.!?]$")
    heading = lambda b: (b["kind"] == "heading") | (plain(b) & (bold(b) | (b["text"].endswith(":") & (F.length(b["text"]) <= LONGEST_COLON))))
    text = lambda b: F.when(item(b), F.regexp_replace(b["text"], "(?U)" + BULLET, "")).when(heading(b), F.rtrim(F.regexp_replace(b["text"], ":$", ""))).otherwise(b["text"])
    return F.transform(found, lambda b: F.struct(F.when(item(b), "item").when(heading(b), "heading").otherwise(b["kind"]).alias("kind"), text(b).alias("text")))
