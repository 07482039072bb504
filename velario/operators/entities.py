"""Entities of a recogniser, cleaned: from a table of predictions, or from a provider that runs on the executors.

A provider is any object with ``entities(text) -> list[(start, end, label)]``. A provider that fails leaves the document without
entities; the pipeline goes on and the reason is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.operators.names import is_person, without_junk
from velario.operators.spans import lookup, span

#: Labels of recognisers and the types they stand for; other labels are left out (fixed values).
LABELS = {"PER": "PER", "PERSON": "PER", "LOC": "LOC", "GPE": "LOC", "ORG": "ORG"}


class Provider(Protocol):
    def entities(self, text: str) -> list[tuple[int, int, str]]: ...


def predict(docs: DataFrame, make: Callable[[], Provider], text: str = "text") -> DataFrame:
    """doc_id, start, end, label, error: the provider is made once for each Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, why = None, None
        try:
            provider = make()
        except Exception as e:  # noqa: BLE001 - an absent model must not stop the job
            why = str(e)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b[text], strict=True):
                try:
                    if provider is None:
                        raise RuntimeError(why)
                    rows += [(i, a, z, label, None) for a, z, label in provider.entities(t or "")]
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "label", "error"])

    return docs.select("doc_id", text).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start int, end int, label string, error string")


def entity_spans(text: Column, found: Column, types: tuple[str, ...] = ("PER",)) -> Column:
    """Spans of array<struct<start,end,label>>: known labels of the wanted types, two letters or more, junk at the end cut off, no stop
    words among persons."""

    def made(e: Column) -> Column:
        kind = lookup(e["label"], LABELS)
        raw = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        clean = F.when(kind == "PER", without_junk(raw)).otherwise(raw)
        return span(start=e["start"], end=e["start"] + F.length(clean), text=clean, type=kind, source=F.lit("ner"), confidence=F.lit(0.7))

    good = lambda s: s["type"].isin(*types) & (F.length(s["text"]) >= 2) & ((s["type"] != "PER") | is_person(s["text"]))
    return F.filter(F.transform(found, made), good)
