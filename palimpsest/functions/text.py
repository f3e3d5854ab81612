"""Scalar text functions: identities, slugs, percent coding and excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """Identity of content: SHA-256 with a prefix that names the hash."""
    return F.concat(F.lit("s256:"), F.sha2(text, 256))


def slug(text: Column) -> Column:
    """File name part of at most 64: ASCII letters and digits in lower case, runs of others as one dash; ``article`` if none is left."""
    dashed = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(F.lower(dashed), 1, 64)
    return F.when(cut == "", "article").otherwise(cut)


def percent_encode(text: Column) -> Column:
    """URL coding of UTF-8 bytes; only letters, digits and ``-._~`` stay."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def source_url(endpoint: Column, title: Column, revision: Column) -> Column:
    """Permanent address of a revision, from the address of the site's API."""
    base = F.regexp_replace(F.regexp_extract(endpoint, r"\A[^?#]*", 0), r"api\.php$", "index.php")
    return F.concat(base, F.lit("?title="), percent_encode(title), F.lit("&oldid="), revision.cast("string"))


#: White space of Unicode, for a character class.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), "^ | $", "")


def excerpt(text: Column, limit: int = 240) -> Column:
    """The start of a text: white space collapsed, ``limit`` characters, then an ellipsis if there was more."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def query_excerpt(text: Column, query: str, limit: int = 200) -> Column:
    """The first line with a term of the query (of more than one byte), else the first that is not blank; at most ``limit`` characters, ellipsis included."""
    terms = [t.lower() for t in re.findall(r"[^\W_]+", query) if len(t.encode()) > 1]
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")

    def hit(x: Column) -> Column:
        found = F.lit(False)
        for t in terms:
            found = found | F.contains(F.lower(x), F.lit(t))
        return found

    line = F.coalesce(F.get(F.filter(lines, hit), F.lit(0)), F.get(F.filter(lines, lambda x: collapse(x) != ""), F.lit(0)), F.lit(""))
    flat = collapse(line)
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)
    return F.when(text.isNotNull(), cut)


def escape_html(text: Column) -> Column:
    """The five characters that HTML reads as markup, as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_markdown(text: Column) -> Column:
    """Backslashes and brackets with a backslash before them."""
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def format_bytes(size: Column) -> Column:
    """A byte count for readers: bytes as they are, from 1024 on with one decimal, TiB the largest unit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1 << 10 * k, F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1 << 10 * k)), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def loose_path(digest: Column) -> Column:
    """Place of a loose object from its hex digest: two levels of two digits."""
    return F.concat_ws("/", F.lit("objects/loose/b3"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def timestamp_name(seconds: Column, nanos: Column) -> Column:
    """Output name of an instant; a fraction shows only where there is one."""
    return F.when(nanos == 0, F.concat(F.lit("at-time-unix-"), seconds.cast("string"))).otherwise(F.format_string("at-time-unix-%d-%09d", seconds, nanos))


def valid_title(text: Column) -> Column:
    """The title without white space at its ends; null where nothing is left or a control character is inside."""
    bare = F.regexp_replace(text, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")
    return F.when((bare != "") & ~bare.rlike(r"[\x00-\x1f\x7f-\x{9f}]"), bare)


def strict_timestamp(text: Column) -> Column:
    """Whether a text is ``YYYY-MM-DDTHH:MM:SSZ``, a real UTC time of the years 1 to 9999."""
    shape = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z") & ~text.startswith("0000")
    return shape & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()


def base36_sha1(text: Column) -> Column:
    """SHA-1 in base 36, padded to 31 digits: long division of five 32-bit limbs, in expressions alone."""
    digest = F.sha1(text)
    limbs = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(5)])
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def divide(state: Column, _: Column) -> Column:
        q, rest = [], F.lit(0).cast("long")
        for k in range(5):
            here = rest * (1 << 32) + F.get(state["n"], F.lit(k))
            q.append(F.floor(here / 36).cast("long"))  # below 2 ** 38, so the quotient of doubles has the right floor
            rest = F.pmod(here, F.lit(36))
        return F.struct(F.array(*q).alias("n"), F.concat(F.substring(F.lit(digits), (rest + 1).cast("int"), F.lit(1)), state["s"]).alias("s"))

    start = F.struct(limbs.alias("n"), F.lit("").alias("s"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, divide, lambda state: state["s"])
    return F.when(text.isNotNull(), out)


def headings(source: Column) -> Column:
    """Heading texts of a page's source, in order."""
    return F.transform(F.regexp_extract_all(source, F.lit(r"(?m)^={1,6}[ \t]*(.+?)[ \t]*={1,6}[ \t]*$"), 1), lambda h: F.trim(h))
