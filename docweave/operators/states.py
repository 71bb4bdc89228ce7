"""Operators whose output for a row depends on the rows before: pages by the nearest match, labels by their anchor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx

#: Fixed value: marks that begin a bullet.
BULLET = r"^\s*(?:[-•·○●▪◦□■]|\d{1,3}\))"


def nearest(found: list[list[int]]) -> list[int | None]:
    """Of the places where each item was found, the one nearest to the place before (forward of equals); null if none."""
    out, last = [], 0
    for places in found:
        if not places:
            out.append(None)
            continue
        last = min(places, key=lambda p: (abs(p - last), p < last))
        out.append(last)
    return out


def settled(pages: list[int | None], eligible: int, least: float = 0.7) -> list[int | None]:
    """Gaps take the page before (the first ones the first known); if enough was found, lone jumps are undone and pages never go back."""
    known = [p for p in pages if p is not None]
    if not known:
        return pages
    out, carry = [], known[0]
    for p in pages:
        carry = carry if p is None else p
        out.append(carry)
    if eligible and len(known) / eligible >= least:
        for i in range(1, len(out) - 1):
            if out[i - 1] == out[i + 1] != out[i]:
                out[i] = out[i - 1]
        for i in range(1, len(out)):
            out[i] = max(out[i], out[i - 1])
    return out


def paged(rows: DataFrame, pages: DataFrame, doc: str, seq: str, text: str, page: str, page_text: str, chars: int = 40, least: int = 6) -> DataFrame:
    """rows with oracle_page: the page whose text has the row's beginning, nearest to the row before.

    The candidates are a join within the document; only the choice among them, a list of numbers per document, is in Python.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", ""))
    r = rows.select(F.col(doc).alias("d"), F.col(seq).alias("s"), F.substring(key(F.col(text)), 1, chars).alias("k"))
    p = pages.select(F.col(doc).alias("d"), F.col(page).alias("p"), key(F.col(page_text)).alias("t"))
    hits = r.filter(F.length("k") >= least).join(p, "d").filter(F.col("t").contains(F.col("k"))).groupBy("d", "s").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    both = r.join(hits, ["d", "s"], "left").select("d", "s", "ps", (F.length("k") >= least).alias("e"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        found = nearest([[] if x is None else list(x) for x in pdf["ps"]])
        return pd.DataFrame({"d": pdf["d"], "s": pdf["s"], "oracle_page": pd.array(settled(found, int(pdf["e"].sum())), dtype="Int64")})

    kinds = f"d {rows.schema[doc].dataType.simpleString()}, s {rows.schema[seq].dataType.simpleString()}, oracle_page long"
    chosen = both.groupBy("d").applyInPandas(choose, kinds)
    return rows.join(chosen, (rows[doc] == chosen.d) & (rows[seq] == chosen.s), "left").drop("d", "s")


def spacing(rows: DataFrame, doc: str, seq: str, tab: str, top: str, mid: str, detail: str) -> DataFrame:
    """Labels of bullets are blanked after their anchor: only the first bullet of a mid keeps them.

    A run of rows of one tab remembers one label: that of the last bullet that had one, or of the last other row of two
    letters or more, if any. It is a last value over the rows before, so two windows do.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    w = Window.partitionBy(doc).orderBy(seq)
    r = rows.select(doc, seq, *(empty(c).alias(c) for c in (tab, top, mid, detail)))
    r = r.withColumn("__run", F.sum(F.when(F.lag(tab).over(w).eqNullSafe(F.col(tab)), 0).otherwise(1)).over(w))
    bullet, t, m = F.col(detail).rlike(BULLET), F.col(top), F.col(mid)
    label = F.when(bullet, F.nullif(m, F.lit(""))).when(F.length(tx.sig(F.col(detail))) >= 2, m)
    before = F.last(label, ignorenulls=True).over(Window.partitionBy(doc, "__run").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("__last", F.coalesce(before, F.lit("")))
    blank = bullet & (F.col("__last") != "") & ((m == "") | (m == F.col("__last")))
    return r.select(doc, seq, tab, F.when(blank, "").otherwise(t).alias(top), F.when(blank, "").otherwise(m).alias(mid), detail)
