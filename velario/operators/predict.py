"""Predictions of a language model: requests in batches, answers parsed without trust, and fallbacks that fail closed.

Answers may come from a table (reproducible) or from a client that is called on the executors; both are parsed by the same expressions.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.operators.roles import UNKNOWN, parse_role

BATCH, RETRIES, BACKOFF, MAX_CHARS = 10, 2, 1.5, 40_000
ANSWER = "resultados array<struct<id: int, rol: string, confianza: double>>"


class Client(Protocol):
    def chat(self, system: str, user: str) -> str: ...


class HttpClient:
    """A chat endpoint of the usual kind, asked without sampling. An empty answer is an error."""

    def __init__(self, base_url: str = "http://localhost:1234/v1", model: str = "local-model", timeout: float = 120, max_tokens: int = 8192):
        self.base_url, self.model, self.timeout, self.max_tokens = base_url.rstrip("/"), model, timeout, max_tokens

    def chat(self, system: str, user: str) -> str:
        body = {
            "model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": 0, "top_p": 1, "top_k": 1, "max_tokens": self.max_tokens,
            "response_format": {"type": "text"},
        }
        request = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - the address is the caller's
            said = json.loads(answer.read())["choices"][0]["message"].get("content")
        if not said:
            raise RuntimeError("empty answer")
        return said


def asked(ask: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF) -> tuple[str | None, str | None]:
    """(answer, error) after up to ``retries`` more attempts with linear pauses."""
    why = None
    for k in range(retries + 1):
        try:
            return ask(), None
        except Exception as e:  # noqa: BLE001 - any failure of a client falls back
            why = str(e)
            if k < retries and backoff:
                time.sleep(backoff * (k + 1))
    return None, why


def requests(cards: DataFrame, batch: int = BATCH) -> DataFrame:
    """doc_id, batch_no, prompt: cards of a document in order, ``batch`` to a request."""
    from velario.operators.cards import prompt

    made = cards.withColumn("batch_no", F.floor((F.col("card_id") - 1) / batch).cast("int")).withColumn(
        "p", F.struct("card_id", prompt(F.struct(*[F.col(c) for c in cards.columns])).alias("j"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["j"]), ", ")
    return made.groupBy("doc_id", "batch_no").agg(F.concat(F.lit('{"fichas": ['), joined, F.lit("]}")).alias("prompt"))


def answers(reqs: DataFrame, make: Callable[[], Client], system: str, retries: int = RETRIES, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, batch_no, raw, error of every request; the client is made once for each Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            got = [asked(lambda p=p: client.chat(system, p), retries, backoff) for p in b["prompt"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "batch_no": b["batch_no"], "raw": [a for a, _ in got], "error": [e for _, e in got]})

    return reqs.mapInPandas(run, f"doc_id {dict(reqs.dtypes)['doc_id']}, batch_no int, raw string, error string")


def classified(cards: DataFrame, said: DataFrame, policy: DataFrame, batch: int = BATCH) -> DataFrame:
    """Cards with role, anonymize, confidence, source and raw_role.

    One invalid item (no id or role, a confidence outside 0..1) rejects the whole batch; of repeated ids the last counts; ids that were
    not asked are dropped; missing ones are unknown, with the reason. Unknown is anonymised: the step fails closed.
    """
    a = said.withColumn("j", F.from_json("raw", ANSWER))
    items = F.transform(F.col("j.resultados"), lambda x: F.struct(x["id"].alias("id"), x["rol"].alias("rol"), F.coalesce(x["confianza"], F.lit(0.5)).alias("confianza")))
    ok = F.col("j.resultados").isNotNull() & F.forall(items, lambda x: x["id"].isNotNull() & x["rol"].isNotNull() & x["confianza"].between(0, 1))
    a = a.select("doc_id", "batch_no", F.when(ok, items).alias("items"), F.coalesce("error", F.when(~F.coalesce(ok, F.lit(False)), F.lit("invalid_json"))).alias("why"))
    rows = cards.withColumn("batch_no", F.floor((F.col("card_id") - 1) / batch).cast("int")).join(a, ["doc_id", "batch_no"], "left")
    item = F.try_element_at(F.filter("items", lambda x: x["id"] == F.col("card_id")), F.lit(-1))
    rows = rows.withColumn("item", item)
    rows = rows.select(
        *cards.columns,
        F.when(F.col("item").isNotNull(), parse_role(F.col("item.rol"))).otherwise(F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("item.confianza"), F.lit(0.0)).alias("confidence"),
        F.when(F.col("item").isNotNull(), F.lit("llm")).otherwise(F.lit("fallback")).alias("source"),
        F.coalesce(F.col("item.rol"), F.concat(F.lit("FALLBACK:"), F.coalesce("why", F.lit("omitted")))).alias("raw_role"),
    )
    return rows.join(F.broadcast(policy.select("role", "anonymize")), "role", "left").select(*cards.columns, "role", "anonymize", "confidence", "source", "raw_role")


def parties_said(raw: Column) -> Column:
    """array<struct<nombre, rol>> of an answer: code fences and words before the first brace are dropped; anything invalid is no party."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(raw, r"```json\s*", ""), r"```\s*", ""))
    body = F.when(F.instr(clean, "{") > 1, F.substring(clean, F.instr(clean, "{"), F.length(clean))).otherwise(clean)
    parsed = F.from_json(body, "partes array<struct<nombre: string, rol: string>>")["partes"]
    good = F.filter(F.coalesce(parsed, F.expr("cast(array() as array<struct<nombre:string,rol:string>>)")), lambda p: p["nombre"].isNotNull())
    whole = body.rlike(r"^\{[\s\S]*\}\s*$")
    made = F.transform(good, lambda p: F.struct(F.trim(p["nombre"]).alias("nombre"), F.lower(F.trim(F.coalesce(p["rol"], F.lit("desconocido")))).alias("rol")))
    return F.when(F.coalesce(whole, F.lit(False)), made).otherwise(F.expr("cast(array() as array<struct<nombre:string,rol:string>>)"))


def party_prompts(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The first characters of each text, which is what a model is shown; answers are checked against the whole text."""
    return docs.select("doc_id", F.lit(0).alias("batch_no"), F.left("text", F.lit(max_chars)).alias("prompt"))
