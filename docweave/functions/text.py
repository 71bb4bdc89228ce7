"""Text functions as column expressions: keys, predicates, tokens, splits, similarities.

Null in, null out, unless a docstring says otherwise. Everything is evaluated inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
#: Marks that start a numbered item, and bullets.
PRIMARY = r"^[ \t]*([①-⑳]|\([0-9]{1,3}\)|[0-9]{1,3}[.)]|[가-하][.)])[ \t]*"
BULLET = r"^[ \t]*([-•·○●▪◦□■])[ \t]+"
SENTENCE_END = r"[.!?:;,][\"')\]]*[ \t]*$"


def norm(t: Column) -> Column:
    """White space collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(t, SPACE, " "))


def sig(t: Column) -> Column:
    """Only digits, ASCII letters and Hangul syllables, case kept: a key for comparison."""
    return F.regexp_replace(t, "[^0-9A-Za-z가-힣]+", "")


def looks_like_code(t: Column) -> Column:
    n = norm(t)
    return (F.length(n) <= 12) & n.rlike(r"^[A-Za-z0-9가-힣]{0,6}[_\-/.]?[0-9]{1,4}$")


def bullets(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[•·○●▪◦□■]"))


def valid_label(t: Column) -> Column:
    """A short heading: not empty, at most 48 characters, fewer than two bullets, no sentence end. Null is no label."""
    n = norm(t)
    return F.coalesce((F.length(n) > 0) & (F.length(n) <= 48) & (bullets(n) < 2) & ~n.rlike("[.!?]$"), F.lit(False))


def junk_detail(t: Column) -> Column:
    """Under three characters, a page number, a date, or a dotted contents line. Null is junk."""
    n = norm(t)
    return F.coalesce((F.length(n) < 3) | n.rlike(r"^[-–( ]*[0-9]{1,4}[-–) ]*$") | n.rlike(r"^[0-9]{4}[./-][0-9]{1,2}([./-][0-9]{1,2})?\.?$") | n.rlike(r"[.·…]{4,} ?[0-9]{1,4}$"), F.lit(True))


def normalized_lines(t: Column) -> Column:
    """CRLF to LF, blanks at line ends gone, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def first_line(t: Column, most: int = 120) -> Column:
    """The first line with more than white space, trimmed and cut; null if there is none."""
    return F.substring(F.trim(F.get(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \t\r]")), F.lit(0))), 1, most)


def words(t: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscore of at least `least` characters, in any script."""
    return F.regexp_extract_all(F.lower(t), F.lit(f"[\\p{{L}}\\p{{N}}_]{{{least},}}"), F.lit(0))


def tech_words(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9가-힣:+#._-]{2,}"), F.lit(0)), lambda x: F.lower(x))


def keywords(t: Column, most: int = 8) -> Column:
    """The first distinct words."""
    return F.slice(F.array_distinct(words(t)), 1, most)


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: lambdas evaluate what they refer to for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Set before a line that starts a piece; taken out of texts that have it.
START = "\x01"


def glued(lines: Column, starts, glue: str) -> Column:
    """Lines joined by glue, with START before those that start a piece; starts takes a line and its number from 0.

    Joining once and cutting at START is linear in the text; slices of an array are not.
    """
    return F.array_join(F.transform(lines, lambda x, i: F.when(starts(x, i), F.concat(F.lit(START), x)).otherwise(x)), glue)


def full_lines(t: Column) -> Column:
    return F.filter(F.split(F.replace(t, F.lit(START), F.lit("")), "\n"), lambda x: x.rlike("[^ \t\r]"))


def marker_pieces(t: Column) -> Column:
    """Pieces of a cell: numbered marks start one; bullets do only in a cell without numbered marks; text before the first is one.

    Empty lines are dropped, other lines are appended to the piece before them. An empty cell has no pieces.
    """

    def cut(lines: Column) -> Column:
        joined = bound(F.exists(lines, lambda x: x.rlike(PRIMARY)), lambda numbered: glued(lines, lambda x, i: (i == 0) | F.when(numbered, x.rlike(PRIMARY)).otherwise(x.rlike(BULLET)), "\n"))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split(F.substr(joined, F.lit(2)), "\n" + START))

    return bound(full_lines(t), cut)


def joined_lines(t: Column) -> Column:
    """Broken lines joined: a line stays apart if it starts with a mark, or the line before ends a sentence or clause."""

    def join(lines: Column) -> Column:
        joined = glued(lines, lambda x, i: (i == 0) | x.rlike(PRIMARY) | x.rlike(BULLET) | F.get(lines, i - 1).rlike(SENTENCE_END), " ")
        return F.substr(F.replace(joined, F.lit(" " + START), F.lit("\n")), F.lit(2))

    return bound(F.transform(full_lines(t), lambda x: F.trim(x)), join)


def bullet_pieces(t: Column) -> Column:
    """Lines, cut before inline dashes and bullets; pieces trimmed, empty ones dropped."""
    cut = F.flatten(F.transform(F.split(t, "\n"), lambda x: F.split(x, r"(?<=[ \t])[-•·○●▪◦□■][ \t]+")))
    return F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(x, BULLET, ""))), lambda x: x != "")


def fixed_chunks(t: Column, size: int = 1000, overlap: int = 200) -> Column:
    """(no, start, text) windows of size characters, moved by size - overlap; the last one ends with the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(t) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    cut = lambda chars: F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), (i * step).alias("start"), F.array_join(F.slice(chars, i * step + 1, F.lit(size)), "").alias("text")))
    return F.when(F.length(t) > 0, bound(F.split(t, ""), cut))  # a substring would walk from the start for every chunk


def windows(items: Column, n: int, glue: str = "") -> Column:
    """All runs of n items, joined; items is an array with at least n. Linear: elements are read by place."""
    return bound(items, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat_ws(glue, *(F.get(a, i + k) for k in range(n)))))


def runs(t: Column, n: int) -> Column:
    """All n-grams of characters, in one pass; a shorter text is its own gram, an empty one has none."""
    made = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(t) >= n, made).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def grams(t: Column, n: int) -> Column:
    """Distinct n-grams."""
    return F.array_distinct(runs(t, n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def label_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the shared beginning (3 characters at least) by the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(a == b, F.lit(1.0)).when((F.least(F.length(a), F.length(b)) > 0) & (a.contains(b) | b.contains(a)), F.lit(0.9)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(F.when(shared >= 3, shared / longest).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Norms of 0 count as 1."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def code_prefix(label: Column) -> Column:
    """First four ASCII letters or digits, upper case; REQ if there are none."""
    p = F.upper(F.substring(F.regexp_replace(label, "[^A-Za-z0-9]+", ""), 1, 4))
    return F.when(F.coalesce(F.length(p), F.lit(0)) == 0, "REQ").otherwise(p)


def judgement(mean: Column) -> Column:
    """O up to 2.2, △ up to 3.5, X beyond; no mean, no mark."""
    return F.when(mean.isNull(), "").when(mean <= 2.2, "O").when(mean <= 3.5, "△").otherwise("X")
