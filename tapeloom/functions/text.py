"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"
#: Unicode's space separators, which SQL's trim takes off.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Pieces between white space, none of them empty."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), 1))


def sentences(text: Column) -> Column:
    """Split at white space after a full stop, an exclamation or a question mark."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentences_at_spaces(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?]) +")


def statements(text: Column) -> Column:
    """Split at runs of end marks, which are dropped; empty pieces stay, so that positions count them."""
    return F.split(text, r"[.!?]+")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def cleaned(text: Column, least: int = 10) -> Column:
    """Collapsed text; '' if that has no more than `least` characters."""
    flat = collapse(text)
    return F.when(F.length(flat) > least, flat).otherwise("")


def trimmed(text: Column) -> Column:
    """Without spaces at both ends. One argument only: F.transform hands F.trim an element's place as what to take off."""
    return F.trim(text, F.lit(SPACES))


def dedupe_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def truncated(text: Column, n: int) -> Column:
    """At most n characters and dots if some are left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def topic_label(text: Column) -> Column:
    return F.concat(first_words(text, 5), F.lit("..."))


# Shapes of video links, in the order in which they are tried.
VIDEO_ID = r"([a-zA-Z0-9_-]{11})"
LINKS = (r"youtube\.com/watch\?.*v=", r"youtu\.be/", r"youtube\.com/embed/", r"youtube\.com/shorts/", r"youtube\.com/live/")
# A paragraph that opens so goes on without a pause.
CONNECTIVES = ("Additionally", "Furthermore", "Moreover", "However", "In contrast")


def video_id(link: Column) -> Column:
    """A bare id as it is, else the id in the first link shape found, else the trimmed input."""
    text = F.trim(link)
    found = [F.nullif(F.regexp_extract(text, shape + VIDEO_ID, 1), F.lit("")) for shape in LINKS]
    return F.when(text.rlike(f"^{VIDEO_ID}$"), text).otherwise(F.coalesce(*found, text))


def loose_video_id(link: Column) -> Column:
    """What follows v= or the short host up to the next delimiter; '' if neither is there."""
    return F.regexp_extract(link, r"(?:youtube\.com/.*v=|youtu\.be/)([^&\n?#]+)", 1)


def narration(text: Column) -> Column:
    """Paragraphs with a pause before each one but the first that doesn't open with a connective."""
    opens = lambda p: F.lit(False) if not CONNECTIVES else p.rlike("^(" + "|".join(CONNECTIVES) + ")")
    parts = F.transform(F.split(text, "\n\n"), lambda p, i: F.struct(F.trim(p).alias("p"), i.alias("i")))
    kept = F.filter(parts, lambda x: x["p"] != "")
    return F.array_join(F.transform(kept, lambda x: F.when((x["i"] > 0) & ~opens(x["p"]), F.concat(F.lit("... "), x["p"])).otherwise(x["p"])), "\n\n")


def clock(seconds: Column) -> Column:
    """HH:MM:SS, from zero again after a day."""
    s = F.floor(seconds) % 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))
