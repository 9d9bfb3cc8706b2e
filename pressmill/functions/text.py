"""Scalar text functions as Column expressions; Python only where SQL can't say it.

Java's \\s, \\d and \\w are ASCII, so patterns carry (?U), and (?iu) for letters
in either case.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib
from difflib import SequenceMatcher
from email.utils import parseaddr
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import bounded_batches

#: Line ends as Python's splitlines has them.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
#: Characters that Java's (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Headings that are no articles.
NOISE_HEADINGS = ("the wall street journal.", "what’s news", "business & finance", "worldwide", "journal report", "sports", "u.s. news", "u.s.watch", "iowa", "contents", "insid")
#: Marks of a page where an article goes on or began, and of images.
TO_PAGE = r"(?iu)please(?U:\s*)turn(?U:\s*)to(?U:\s*)page(?U:\s*)([A-Z]\d+)"
FROM_PAGE = r"(?iu)continued(?U:\s*)from(?U:\s*)(PageOne|page(?U:\s*)[A-Z]\d+)"
TO_MARK, FROM_MARK = r"(?U)[►▶]\s*(\d+)\s*$", r"(?U)^\s*[◄◀]\s*(\d+)"
IMAGE, IMAGE_SUFFIX = r"!\[[^\]]*\]\(([^)]+)\)", r"(?i)\.(?:png|jpg|jpeg|webp)$"
#: What tells an advertisement.
AD_TOKENS = r"(?iu)(\b[\w-]+\.(?:com|net|org)\b|\(\d{3}\)\s?\d{3}|\bFINRA\b|\bSIPC\b|Member\s*[-–]\s*NYSE|Past performance|marketing purposes|informational purposes|BOOK NOW|Learn more at)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """A text's lines; the last line end starts no further line."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), f"({LINE_END})$", ""), LINE_END)


def parts(c: Column) -> Column:
    """A text's lines for those who skip empty ones: any character that ends a line parts it."""
    return F.split(F.coalesce(c, F.lit("")), LINE_END[LINE_END.index("[") :])


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, '' without a match."""
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def continued_to_page(body: Column) -> Column:
    return F.coalesce(nullif_empty(F.upper(match(body, TO_PAGE))), match(body, TO_MARK))


def continued_from_page(body: Column) -> Column:
    """PageOne, or the page without its prefix (only ``page`` and ``Page`` go)."""
    said = F.regexp_replace(match(body, FROM_PAGE), r"(?U)\s+", "")
    page = F.when(F.lower(said) == "pageone", F.lit("PageOne")).otherwise(F.regexp_replace(F.regexp_replace(said, "^page", ""), "^Page", ""))
    return F.when(said != "", page).otherwise(match(body, FROM_MARK))


def merged_body(front: Column, back: Column) -> Column:
    """Both bodies in turn, without the marks that tie them."""
    head = F.regexp_replace(front, r"(?iu)\n?please(?U:\s*)turn(?U:\s*)to(?U:\s*)page(?U:\s*)[A-Z]\d+(?U:\s*)$", "")
    head = F.regexp_replace(F.regexp_replace(head, r"(?U)\s*[►▶]\s*\d+\s*$", ""), r"(?U)\s+$", "")
    tail = F.regexp_replace(back, r"(?iu)^continued(?U:\s*)from(?U:\s*)(?:PageOne|page(?U:\s*)[A-Z]\d+)(?U:\s*)", "")
    tail = F.regexp_replace(F.regexp_replace(tail, r"(?U)^\s*[◄◀]\s*\d+\s*", ""), r"(?U)^\s+", "")
    return F.concat(head, F.lit("\n"), tail)


def is_byline_heading(c: Column) -> Column:
    return F.upper(c).startswith("BY ") & (F.length(c) > 3)


def is_noise_heading(c: Column) -> Column:
    return ~c.rlike(r"[\p{L}\p{N}]") | F.lower(c).isin(*NOISE_HEADINGS)


def leader_dots(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))) >= 8


def is_promo_label(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (letters >= 3) & (F.size(words(c)) <= 3) & (F.upper(c) == c)


def is_page_blurb(c: Column) -> Column:
    last = F.regexp_replace(F.element_at(words(c), -1), r"[.,;:]+$", "")
    return (F.size(words(c)) >= 4) & last.rlike(r"^\p{L}\p{Nd}{1,2}$")


def is_paragraph(c: Column) -> Column:
    n = F.size(words(c))
    return (n >= 8) | ((n >= 6) & c.rlike(r"[.!?]$"))


def is_teaser(body: Column) -> Column:
    """Two lines of leader dots and no paragraph, or with two labels and two blurbs."""
    body = F.filter(body, lambda x: ~x.startswith("![]("))
    kind = F.transform(body, lambda x: F.when(leader_dots(x), "dots").when(is_promo_label(x), "label").when(is_page_blurb(x), "blurb").when(is_paragraph(x), "text").otherwise(""))
    of = lambda k: F.size(F.filter(kind, lambda x: x == k))
    return (of("dots") >= 2) & ((of("text") == 0) | ((of("label") >= 2) & (of("blurb") >= 2)))


def local_path(c: Column) -> Column:
    """A local image's path, null for anything else."""
    bare = F.regexp_replace(strip(c), "^[\"']+|[\"']+$", "")
    return F.when(c.rlike(IMAGE_SUFFIX[:-1]) & ~c.contains("://") & bare.rlike(IMAGE_SUFFIX), bare)  # the cheap test first


def image_paths(c: Column) -> Column:
    """Local image paths of a text, in order, once each."""
    def of_line(line: Column) -> Column:
        inline = F.transform(F.regexp_extract_all(line, F.lit(IMAGE), F.lit(1)), lambda x: local_path(x))
        return F.array_compact(F.concat(inline, F.array(local_path(strip(without_images(line))))))
    # Lines without an image's suffix have no path.
    return F.array_distinct(F.flatten(F.transform(F.filter(parts(c), lambda x: x.rlike(IMAGE_SUFFIX[:-1])), of_line)))


def without_images(line: Column) -> Column:
    gone = F.regexp_replace(line, r"(?i)!\[[^\]]*\]\((?![^)]*://)\s*[\"']?[^)]*\.(?:png|jpg|jpeg|webp)[\"']?\s*\)", "")
    return F.when(line.contains("!["), gone).otherwise(line)


def clean_text(c: Column) -> Column:
    """The text without local images, blank lines and outer blanks."""
    kept = F.filter(F.transform(parts(c), lambda x: strip(without_images(x))), lambda x: (x != "") & local_path(x).isNull())
    return F.array_join(kept, "\n")


def repair_dropcap(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^([B-HJ-Z])\s+([a-z])", "$1$2")


def trim_end_marker(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)(?U:\s*)<BW>.*$", ""), r"(?U)\s+$", "")


def demirror(c: Column) -> Column:
    """A title whose first one to three words come twice loses the first time."""
    w = words(c)
    out = c
    for k in (1, 2, 3):
        out = F.when((F.size(w) >= 2 * k) & (F.slice(w, 1, k) == F.slice(w, k + 1, k)), F.array_join(F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))), " ")).otherwise(out)
    return out


def excerpt(c: Column, n: int = 700) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)


def link_id(url: Column) -> Column:
    return F.concat(F.lit("link:body-"), F.substring(F.sha2(strip(url).cast("binary"), 256), 1, 24))


def host(url: Column) -> Column:
    """The host in lower case, null without one; names may hold marks that DNS forbids."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:\[\]]*))", 0)
    return nullif_empty(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", ""), "^.*@", ""), r"[\[\]]", "")))


def url_path(url: Column) -> Column:
    """The path without parameters, whatever marks it holds; '' without one."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def filename_from_url(url: Column) -> Column:
    path = url_path(url)
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    name = F.coalesce(nullif_empty(F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)), F.lit("download.pdf"))
    return F.when(name.rlike(r"(^|/)[^/]+\.[^./]+$"), name).otherwise(F.concat(name, F.lit(".pdf")))  # any suffix stays


def looks_like_pdf_url(url: Column) -> Column:
    return F.lower(url_path(url)).endswith(".pdf")


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s\"'<>]+"), F.lit(0)))


def base64_url(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG header, null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452") & (number(17) > 0) & (number(21) > 0)
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height")))


def normalized_tags(c: Column) -> Column:
    """Tags stripped and distinct; null unless three to eight are left."""
    found = F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))
    return F.when(F.size(found).between(3, 8), found)


# Python semantics that SQL lacks, in Arrow batches.


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


#: ASCII and the Latin letters that NFKC leaves as they are.
SETTLED = r"\A[\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]*\z"


def folded(c: Column) -> Column:
    """NFKC; only texts that it may change go to Python."""
    return F.coalesce(nfkc(F.when(~c.rlike(SETTLED), c)), c)


def title_key(c: Column) -> Column:
    """NFKC, lower case, other characters than ASCII letters and digits to blanks."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), "[^0-9a-z]+", " "))


@F.pandas_udf(T.StringType())
def identity_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else "".join(x.casefold().split()))


#: Places of a text's three-letter sequences, in words of 64 bits.
GRAM_WORDS = 16


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_bits(s: pd.Series) -> pd.Series:
    """A bit for each sequence of three characters, by its crc32."""
    def one(x):
        bits = 0
        for i in range(len(x) - 2):
            bits |= 1 << zlib.crc32(x[i : i + 3].encode("utf-8", "surrogatepass")) % (64 * GRAM_WORDS)
        return struct.unpack(f"<{GRAM_WORDS}q", bits.to_bytes(8 * GRAM_WORDS, "little"))
    return s.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; 0 if either is empty."""
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def sender_address(s: pd.Series) -> pd.Series:
    """The address in a header as it is spelled; the header itself where it has none."""
    return s.map(lambda x: parseaddr(x or "")[1] or (x or ""))


@F.pandas_udf(T.StringType())
def input_hash(key: pd.Series, date: pd.Series, title: pd.Series, body: pd.Series) -> pd.Series:
    """sha256 of the four fields as JSON with sorted keys and Python's separators."""
    rows = zip(key, date, title, body, strict=True)
    said = [json.dumps({"article_key": k, "publication_date": d, "title_en": t, "body_text_en": b}, sort_keys=True, ensure_ascii=False) for k, d, t, b in rows]
    return pd.Series([hashlib.sha256(x.encode()).hexdigest() for x in said])


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.href: str | None = None
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.parts = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.parts.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append({"href": self.href, "label": "".join(self.parts).strip()})
            self.href = None


@F.pandas_udf(T.ArrayType(T.StructType().add("href", "string").add("label", "string")))
def _anchors(html: pd.Series) -> pd.Series:
    """Links of a page with their texts, in order."""
    def one(x):
        parser = _Links()
        parser.feed(x or "")
        return parser.found
    return html.map(one)


def anchors(html: Column | str) -> Column:
    """Links of pages, which are long: few come to Python at once."""
    bounded_batches(SparkSession.active())
    return _anchors(html)


@F.pandas_udf(T.StructType().add("width", "long").add("height", "long"))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Pixels of a PNG or JPEG from its first 64 KiB; nulls if unreadable."""
    found = [_size(bytes(x or b"")[:65536]) or (None, None) for x in content]
    return pd.DataFrame(found, columns=["width", "height"])


def _size(data: bytes) -> tuple[int, int] | None:
    big = lambda a, b: int.from_bytes(data[a:b], "big")
    size = None
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        size = (big(16, 20), big(20, 24)) if len(data) >= 24 and data[12:16] == b"IHDR" else None
    elif data.startswith(b"\xff\xd8"):
        at = 2
        while at + 8 < len(data):
            mark = data[at + 1]
            if data[at] != 0xFF:
                at += 1
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame header
                size = (big(at + 7, at + 9), big(at + 5, at + 7))
                break
            elif 0xD0 <= mark <= 0xD9:  # marks without a length
                at += 2
            elif not big(at + 2, at + 4):
                break
            else:
                at += 2 + big(at + 2, at + 4)
    return size if size and min(size) > 0 else None
