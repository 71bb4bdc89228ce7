"""Line dedup with a log-template tree of fixed depth.

A line's words that hold a digit are variable fields and become <*>. The tree has two levels: number of words, then the
first LEAD words; a leaf holds the lines that agree in both. A leaf has many templates: at each of STEPS a line's words
that less than that share of the leaf has at their place (in MIN_DOCS documents at least) become fields; the lines with
equal words elsewhere are a template, if words are left at SIMILAR of the places.

A line or a template recurs, and all its lines are dropped, if it is in MIN_DOCS independent documents. That tells
boilerplate, in blocks of any length, from lines that recur only because whole documents are copies. A line is a
document's own if its leaf has no line that MIN_DOCS documents share; a changed line of a copy is mostly not, as the
line it was stands in the same leaf. A document is independent if an OWN-th of its words are in own lines, and documents
with the same longest own line (the first of these) count once. So copies do not count, and a hot group of copies does
not outvote others.

Only DataFrame functions are used. Texts are cut into lines once. Lines are counted per document, then per line, each
with map-side aggregation, so a line in a third of all documents is never gathered in one task. Decisions go back to
documents by the hash of their text, as lines dropped depend on the text only.

Defined cases: a null text stays null and has no lines; lines with fewer than MIN_WORDS words are never dropped; an empty
text stays empty; rows with equal text are one document in all counts; a document may lose all its lines; a line stays if
all its documents but MIN_DOCS are boilerplate for more than OWN - 1 parts of OWN; a template needs constant leading words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import free_name, scratch, staged

LEAD = 3
MIN_WORDS = 3
MIN_DOCS = 6
#: A document is independent if one word in so many, or more, is in a line of its own.
OWN = 5
SIMILAR = 0.6
#: Shares of a leaf from which a word at its place is constant; 0 leaves MIN_DOCS documents.
STEPS = (0.4, 0.2, 0.1, 0.05, 0.02, 0.01, 0.0)


SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Lines with MIN_WORDS words or more.
ENOUGH = f"^{SPACE}*+" + f"{NOT_SPACE}++{SPACE}++" * (MIN_WORDS - 1) + NOT_SPACE


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once: a plain projection would be merged into all that refer to it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, at, m, size, n, line, path): every line with enough words; at counts from 0, n its words, size its bytes."""
    text = F.col(f"`{text_col}`")
    cut = docs.filter(text.isNotNull()).select(*text_keys(text), F.posexplode(F.split(text, "\n")).alias("at", "l")).filter(F.col("l").rlike(ENOUGH))
    l = F.col("l")  # noqa: E741
    flat = once(cut, "flat", F.when(l.contains("  ") | l.rlike(r"[\x09-\x0D]|^ | $"), F.trim(F.regexp_replace(l, f"{SPACE}+", " "))).otherwise(l))
    masked = F.when(F.col("flat").rlike("[0-9]"), F.regexp_replace("flat", "[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.col("flat"))
    words = F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    counted = once(once(flat, "m", masked), "n", words)
    return counted.select("k1", "k2", "at", "m", F.octet_length("m").alias("size"), "n", F.xxhash64("m").alias("line"), F.xxhash64("n", F.substring_index("m", " ", LEAD)).alias("path"))


def independent(flat: DataFrame, busy: DataFrame, min_docs: int) -> DataFrame:
    """(path, line, own): the lines of busy leaves by independent document, which goes by its longest own line."""
    often = staged(busy.filter(F.col("docs") >= min_docs).select("path").distinct(), "frequent_leaves")
    marked = flat.join(often.withColumn("often", F.lit(True)), "path", "left")
    alone = F.col("often").isNull()
    longest = F.max(F.when(alone, F.struct("size", (-F.col("at")).alias("at"), "line")))
    per_doc = marked.groupBy("k1", "k2").agg(F.sum("n").alias("words"), F.sum(F.when(alone, F.col("n"))).alias("own_words"), longest.alias("longest"))
    apart = staged(per_doc.filter(OWN * F.col("own_words") >= F.col("words")).select("k1", "k2", F.col("longest.line").alias("own")), "independent")
    held = flat.join(busy.select("line"), "line", "left_semi").select("path", "line", "k1", "k2")
    return staged(held.join(apart, ["k1", "k2"]).select("path", "line", "own").distinct(), "independent_lines")


def templates_of_leaves(members: DataFrame, min_docs: int) -> DataFrame:
    """(template, path, line): for each of STEPS the template of each line, if enough of its words are constant."""
    tokens = members.select("path", "line", "docs", "leaf_docs", F.posexplode("words").alias("at", "word")).filter(F.col("at") >= LEAD)
    votes = tokens.groupBy("path", "at", "word").agg(F.sum("docs").alias("votes")).filter(F.col("votes") >= min_docs)
    often = tokens.join(votes, ["path", "at", "word"]).groupBy("path", "line").agg(F.map_from_entries(F.collect_list(F.struct("at", "votes"))).alias("votes"))
    found = members.join(often, ["path", "line"], "left")
    stepped = found.select("path", "line", "words", "votes", F.posexplode(F.array(*(F.lit(s) * F.col("leaf_docs") for s in STEPS))).alias("step", "least"))
    constant = F.transform("words", lambda w, i: F.when((i < LEAD) | (F.coalesce(F.try_element_at(F.col("votes"), i), F.lit(0)) >= F.greatest("least", F.lit(1))), w))
    shaped = stepped.select("path", "line", "step", constant.alias("shape")).filter(F.size(F.filter("shape", lambda w: w.isNotNull())) >= SIMILAR * F.size("shape"))
    template = F.xxhash64("path", "step", F.transform("shape", lambda w: F.coalesce(w, F.lit("\n"))))  # no word has a line break
    return staged(shaped.select(template.alias("template"), "path", "line"), "templates")


def recurring(flat: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line): hashes of the masked lines that recur by themselves or through a template; flat is lines()."""
    in_doc = flat.select("path", "line", "k1", "k2").distinct()
    per_line = in_doc.groupBy("path", "line").agg(F.count("*").alias("docs"))
    leaves = per_line.groupBy("path").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("leaf_lines")).filter(F.col("leaf_docs") >= min_docs)
    busy = staged(per_line.join(leaves, "path"), "busy_lines")
    apart = independent(flat, busy, min_docs)
    enough = F.col("documents") >= min_docs
    alone = apart.groupBy("line").agg(F.count("*").alias("documents")).filter(enough).select("line")

    mixed = busy.filter("leaf_lines > 1").select("path", "line", "docs", "leaf_docs")
    texts = flat.select("line", "m").join(mixed.select("line"), "line", "left_semi").groupBy("line").agg(F.max("m").alias("m"))
    members = staged(texts.join(mixed, "line").select("path", "line", "docs", "leaf_docs", F.split("m", " ").alias("words")), "leaf_texts")
    made = templates_of_leaves(members, min_docs)
    by_template = made.join(apart, ["path", "line"]).select("template", "own").distinct().groupBy("template").agg(F.count("*").alias("documents"))
    through = made.join(by_template.filter(enough), "template", "left_semi").select("line")
    return staged(alone.union(through).distinct(), "recurring")


def dropped(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, gone): per text, the numbers of the lines to drop."""
    with scratch(docs.sparkSession):
        flat = staged(lines(docs, text_col), "lines")
        hit = flat.join(recurring(flat, min_docs), "line", "left_semi")
        return staged(hit.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")), "dropped", keep=True)  # as many as the text has lines


def without_recurring(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with the recurring lines cut out of the text; counts adds n_lines and n_dropped (free names)."""
    text = F.col(f"`{text_col}`")
    k1, k2, gone = (free_name(docs, x) for x in ("k1", "k2", "gone"))
    cuts = dropped(docs, text_col, min_docs).select(F.struct("k1", "k2", "gone").alias(gone))
    keyed = docs.withColumn(k1, text_keys(text)[0]).withColumn(k2, text_keys(text)[1])
    found = keyed.join(cuts, (F.col(k1) == F.col(f"{gone}.k1")) & (F.col(k2) == F.col(f"{gone}.k2")), "left")
    parts = F.split(text, "\n")

    def rest(ls: Column) -> Column:  # ls is bound once: a lambda evaluates what it refers to for every element
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(f"{gone}.gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    kept = F.when(F.col(gone).isNull(), text).otherwise(F.get(F.transform(F.array(parts), rest), F.lit(0)))
    more = []
    if counts:
        more = [F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias(free_name(docs, "n_lines")), F.coalesce(F.size(F.col(f"{gone}.gone")), F.lit(0)).cast("long").alias(free_name(docs, "n_dropped"))]
    return found.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *more)
