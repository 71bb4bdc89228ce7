"""Model calls as batch scorers: injected functions over distinct inputs, with retry and a deterministic default.

A scorer takes a list of texts and returns as many results, None where it has none. The engine ships rule scorers; a
client of a remote model has the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[str | None]]


def rule_keep(texts: list[str]) -> list[str | None]:
    """The default: keep what has a verb-like ending or a number, drop what is under three characters, undecided else."""
    return ["drop" if len(t.strip()) < 3 else "keep" if any(c.isdigit() for c in t) or t.rstrip().endswith((".", "다", "함")) else None for t in texts]


def scored(rows: DataFrame, text: str, scorer: Scorer, name: str = "verdict", batch: int = 32, tries: int = 1, default: str = "keep") -> DataFrame:
    """rows with the scorer's result for their text; equal texts are asked once.

    What a batch leaves open, or a batch that fails, is asked again one by one up to `tries` times, then takes the default.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, out = pdf["__asked"].tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    got = list(scorer(part))
                except Exception:  # a remote model may fail on a batch; its rows are asked alone
                    got = [None] * len(part)
                for k, g in enumerate(got):
                    for _ in range(tries):
                        if g is not None:
                            break
                        try:
                            g = scorer([part[k]])[0]
                        except Exception:
                            g = None
                    got[k] = default if g is None else g
                out += got
            yield pd.DataFrame({"__asked": texts, name: out})

    asked = rows.select(F.coalesce(text, F.lit("")).alias("__asked")).distinct().mapInPandas(ask, f"__asked string, `{name}` string")
    return rows.withColumn("__t", F.coalesce(text, F.lit(""))).join(asked, F.col("__t") == F.col("__asked"), "left").drop("__t", "__asked")


def verbatim(pieces: DataFrame, piece: str, source: str) -> DataFrame:
    """Only pieces whose signature is in that of their source: what a model made up goes."""
    from docweave.functions.text import sig

    return pieces.filter(F.contains(sig(F.col(source)), sig(F.col(piece))) & (sig(F.col(piece)) != ""))


def accepted_split(source: str, parts: list[str], least: float = 0.8) -> bool:
    """At least two parts, each within the source but for white space, together at least `least` of it."""
    squeeze = lambda s: "".join(s.split())
    whole = squeeze(source)
    return len(parts) >= 2 and all(squeeze(p) in whole for p in parts) and sum(len(squeeze(p)) for p in parts) >= least * len(whole)
