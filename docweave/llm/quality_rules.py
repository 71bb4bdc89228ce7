"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule, and can be
stored. Policies are versioned sets of rules, given here or in a table (version, rule): a verdict is a bitwise AND of
ledger and policy mask, and ablations (what one rule alone rejects) are bitwise aggregations over the ledger, stored or
not, without a second look at any text.

Defined cases: a null text counts as an empty one (no words, base_failed true); repeated rows and doc_ids are judged row
by row; null doc_ids stay; an empty table gives an empty ledger; other columns of the input are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import free_name

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BULLETS, ELLIPSES = (b"-", b"*", "•".encode()), (b"...", "…".encode())

MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_bangs", "longest_word", "n_urls", "n_bullet_lines", "n_ellipsis_lines")])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = at[:-2] * len(ids) + at[1:-1]
    if len(ids) > 2_000_000:  # three ids would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()  # splits at ASCII white space only
    lines = [x for x in data.split(b"\n") if x.strip()]
    trimmed = [x.strip() for x in lines]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(map(bytes.isupper, words)),
        text.count("!"),
        max(map(len, words), default=0),
        text.count("http://") + text.count("https://"),
        sum(x.startswith(BULLETS) for x in trimmed),
        sum(x.endswith(ELLIPSES) for x in trimmed),
    )


@F.pandas_udf(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES.names, dtype="int64")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements; true means failed."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("upper_case", "2 * n_upper_words > n_words"),
    Rule("exclamations", "2 * n_bangs > n_words"),
    Rule("blob", "longest_word > 2000"),
    Rule("no_sentence", "n_words < 5"),
    Rule("urls", "5 * n_urls > n_words"),
    Rule("bullets", "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipses", "n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines"),
)

#: Version to the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case", "exclamations", "blob"),
    # A short text is not junk by itself: of the labelled good documents v1 rejects one in 18, nearly all for few_words alone.
    "v2": ("no_sentence", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case", "exclamations", "blob", "urls", "bullets", "ellipses"),
}


def mask(names: Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bit[x] for x in set(names))


def fail_bits(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """One bit per rule; prefix is where the measurements are, such as "m."."""
    import re

    names = "|".join(MEASURES.names)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        sql = re.sub(rf"\b({names})\b", rf"{prefix}\1", rule.fails)
        bits = bits + F.when(F.expr(sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, the measurements and fail_bits, one row for each row of docs."""
    m = docs.select(F.col(id_col), measures(F.col(text_col)).alias("__m"))
    return m.select(id_col, *(F.col(f"__m.{c}").alias(c) for c in MEASURES.names), fail_bits(rules, "__m.").alias("fail_bits"))


def rejected(bits: Column, policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy], rules)).cast("long")) != 0


def ablations(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, and documents that only it rejects. One pass, one short row per partition shuffled."""
    whole = mask(POLICIES[policy], rules)
    hit = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    one = book.agg(
        *(F.count_if(hit.bitwiseAND(F.lit(mask([r], rules)).cast("long")) != 0).alias(f"f_{r}") for r in POLICIES[policy]),
        *(F.count_if(hit == mask([r], rules)).alias(f"a_{r}") for r in POLICIES[policy]),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"a_{r}").alias("n_alone")) for r in POLICIES[policy]))
    return one.select(F.inline(rows))


def stored(book: DataFrame, path: str) -> DataFrame:
    """The ledger, written once and read again: later policies and ablations need no text."""
    book.write.mode("overwrite").parquet(path)
    return book.sparkSession.read.schema(book.schema).parquet(path)


def masks(policies: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, mask) of a table (version, rule); names that are no rule count nothing, repeated ones once."""
    bit = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(1 << i).cast("long"))))
    return policies.select("version", F.try_element_at(bit, F.col("rule")).alias("bit")).groupBy("version").agg(F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("mask"))


def verdicts(book: DataFrame, policies: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows for every version of the table, with version and kept."""
    few = [(r["version"], r["mask"]) for r in masks(policies, rules).collect()]  # a row a version
    each = F.array(*(F.struct(F.lit(v).alias("version"), (F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == 0).alias("kept")) for v, m in sorted(few)))
    return book.select("*", F.inline(each)) if few else book.withColumn("version", F.lit(None).cast("string")).withColumn("kept", F.lit(None).cast("boolean")).limit(0)


def all_ablations(book: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_alone) of all POLICIES, in one pass over the ledger: documents with equal bits are counted first."""
    by_bits = book.groupBy("fail_bits").count()  # at most 2 to the number of rules
    out = None
    for version in POLICIES:
        whole = F.lit(mask(POLICIES[version], rules)).cast("long")
        hit = F.col("fail_bits").bitwiseAND(whole)
        cells = F.array(*(F.struct(F.lit(version).alias("version"), F.lit(r).alias("rule"), (hit.bitwiseAND(F.lit(mask([r], rules)).cast("long")) != 0).alias("failed"), (hit == mask([r], rules)).alias("alone")) for r in POLICIES[version]))
        part = by_bits.select("count", F.inline(cells))
        out = part if out is None else out.unionByName(part)
    zero = F.lit(0).cast("long")
    return out.groupBy("version", "rule").agg(F.sum(F.when(F.col("failed"), F.col("count")).otherwise(zero)).alias("n_failed"), F.sum(F.when(F.col("alone"), F.col("count")).otherwise(zero)).alias("n_alone"))


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the policy does not reject, with all their columns."""
    name = free_name(docs, "measured")
    m = docs.withColumn(name, measures(F.col(text_col)))
    return m.filter(~rejected(fail_bits(rules, f"`{name}`."), policy, rules)).select(*(F.col(f"`{c}`") for c in docs.columns))
