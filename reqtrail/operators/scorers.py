"""Model calls as operators: a scorer maps rows to structs, with retries, bounded concurrency and a cache.

The core makes no network calls: the scorers here are rules. Others implement Scorer.
"""

from __future__ import annotations

import asyncio
import functools
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE

# Roles a requirement may name, and rows in flight for each kind of call.
ROLES = ("Client", "Server", "Proxy", "Gateway", "Cache", "Sender", "Recipient", "Origin Server")
ROLE_ROWS, CONSTRAINT_ROWS, DUAL_WORKERS = 104, 90, 20


class Scorer(Protocol):
    """name and version key the cache; schema is the DDL of the result; answer() returns a dict for a row."""

    name: str
    schema: str

    async def answer(self, row: Mapping[str, Any]) -> Mapping[str, Any]: ...


class PartAnswer(Exception):
    """A row that failed half-way: answer holds what was there before, and the message says why."""

    def __init__(self, answer: Mapping[str, Any], why: str):
        super().__init__(why)
        self.answer = answer


def parse_answer(said: str) -> Any:
    """JSON from a model's answer: a fenced block or the whole text, else what lies between the outer braces."""
    said = said.strip()
    if fence := re.search(FENCE, said):
        said = fence[1].strip()
    try:
        return json.loads(said)
    except json.JSONDecodeError:
        low, high = said.find("{"), said.rfind("}")
        if low < 0 or high < low:
            raise ValueError("the answer has no JSON") from None
        return json.loads(said[low : high + 1])


async def with_retry(call: Callable, prompt: str) -> Any:
    """call(prompt, json_mode=True); upon any error once more without JSON mode."""
    try:
        return parse_answer(await call(prompt, json_mode=True))
    except Exception:  # noqa: BLE001  models that refuse the mode raise errors of many kinds
        return parse_answer(await call(prompt, json_mode=False))


class PromptScorer:
    """A scorer from a prompt and a client: call(prompt, json_mode=...) is a coroutine that returns the model's text.

    prompt(row) makes the text that is sent; answers are JSON objects with the fields of schema.
    """

    def __init__(self, name: str, schema: str, prompt: Callable[[Mapping[str, Any]], str], call: Callable):
        self.name, self.schema, self.prompt, self.call = name, schema, prompt, call

    async def answer(self, row):
        found = await with_retry(self.call, self.prompt(row))
        if not isinstance(found, dict):
            raise ValueError("the answer is no JSON object")
        return found


class DualScorer:
    """Keywords and subcategories of a function by two calls, the first for the keyword columns, the second for the rest.

    Both answers must be JSON, else the row fails; keywords of a good first answer stay when the second is bad. A call
    that fails leaves all empty. ask(kind, row) is a coroutine that returns text; kind is 'keywords' or 'classes'.
    """

    SECOND = "matched_subcategories"

    def __init__(self, name: str, columns: Sequence[str], ask: Callable):
        self.name, self.ask = name, ask
        self.columns = [c for c in columns if c != self.SECOND]
        self.schema = ", ".join(f"`{c}` array<string>" for c in [*self.columns, self.SECOND])

    async def answer(self, row):
        said = [await self.ask(kind, row) for kind in ("keywords", "classes")]
        out: dict[str, Any] = {}
        for text, columns in zip(said, (self.columns, [self.SECOND]), strict=True):
            try:
                fence = re.search(FENCE, text)
                found = json.loads(fence[1].strip() if fence else text)
            except json.JSONDecodeError as e:
                raise PartAnswer(out, f"JSON parsing error: {e}") from e
            out |= {c: found.get(c, []) for c in columns}
        return out


class RoleRules:
    """Roles that a requirement names, as whole words."""

    name, schema = "role-rules-1", "roles array<string>"

    async def answer(self, row):
        return {"roles": [r for r in ROLES if re.search(rf"\b{r}\b", row.get("sr") or "", re.IGNORECASE)]}


class ConstraintRules:
    """Conditions are clauses that open with if, when or unless; the rest is the action."""

    name, schema = "constraint-rules-1", "conditions array<string>, actions array<string>"

    async def answer(self, row):
        clauses = [c.strip(" .") for c in re.split(r"[,;]", row.get("sr") or "") if c.strip(" .")]
        is_condition = [bool(re.match(r"(?i)(if|when|unless)\b", c)) for c in clauses]
        return {"conditions": [c for c, k in zip(clauses, is_condition, strict=True) if k], "actions": [c for c, k in zip(clauses, is_condition, strict=True) if not k]}


class DualRules:
    """Keywords of a function by category, and subcategories whose words it has."""

    def __init__(self, keywords: Mapping[str, Sequence[str]], subcategories: Mapping[str, Sequence[str]]):
        self.keywords, self.subcategories = keywords, subcategories
        self.name = "dual-rules-" + hashlib.md5(json.dumps([keywords, subcategories], sort_keys=True).encode(), usedforsecurity=False).hexdigest()
        self.schema = ", ".join(f"`{c}` array<string>" for c in [*keywords, "matched_subcategories"])

    async def answer(self, row):
        low = (row.get("source_code") or "").lower()
        return {c: [k for k in v if k and k.lower() in low] for c, v in self.keywords.items()} | {"matched_subcategories": [s for s, v in self.subcategories.items() if any(w.lower() in low for w in v)]}


@functools.lru_cache(maxsize=256)
def _tokens(text: str) -> frozenset[str]:
    """Tokens of a text, which pairs of one function and of few requirements ask for again and again."""
    return frozenset(x.upper() for x in re.findall("[A-Za-z_][A-Za-z0-9_]+", text))


class OverlapVerifier:
    """Outcome of a pair of requirement and function: free text; here by the share of the requirement's tokens."""

    name, schema = "overlap-verify-1", "outcome string, reason string"

    def __init__(self, full: float = 0.8, part: float = 0.3):
        self.full, self.part = full, part

    async def answer(self, row):
        a, b, c = (_tokens(row.get(x) or "") for x in ("sr", "source_code", "dependencies"))
        share = len((a & b) | (a & c)) / len(a) if a else 0.0
        return {"outcome": "Fully Matches" if share >= self.full else "Partially Matches" if share >= self.part else "Does Not Match", "reason": f"{share:.3f}"}


async def bounded(jobs: Sequence[Callable], limit: int) -> list:
    """Results in order of at most `limit` coroutines at a time."""
    gate = asyncio.Semaphore(max(1, limit))

    async def one(job):
        async with gate:
            return await job()

    return await asyncio.gather(*(one(j) for j in jobs))


def scored(df: DataFrame, scorer: Scorer, inputs: Sequence[str], concurrency: int = DUAL_WORKERS, keep_error: bool = True, cache: DataFrame | None = None) -> DataFrame:
    """df with the scorer's columns, and with keep_error status and error.

    Rows are sent from within their partition, at most `concurrency` at a time, and stay in order. A failed row has
    empty lists (null for other types), but for what a PartAnswer holds. cache is a table (_key, _answer) of earlier answers: rows found in it are not
    sent again, so a task that runs twice does not ask twice for what is already kept; new_answers() makes its rows.
    """
    fields = [x.strip() for x in scorer.schema.split(", ")]
    names, kinds = [f.split()[0].strip("`") for f in fields], [f.split(" ", 1)[1] for f in fields]
    if cache is not None:
        keyed = df.withColumn("_key", F.sha2(F.concat_ws("\u0001", F.lit(scorer.name), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256))
        keyed = keyed.join(cache.select("_key", "_answer"), "_key", "left").drop("_key")
    else:
        keyed = df.withColumn("_answer", F.lit(None).cast("string"))
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields] + ["_status string", "_error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[list(inputs)].to_dict("records")

            async def ask(k):
                if batch["_answer"].iloc[k] is not None and batch["_answer"].iloc[k] == batch["_answer"].iloc[k]:
                    return batch["_answer"].iloc[k], "success", None
                try:
                    return json.dumps(dict(await scorer.answer(rows[k]))), "success", None
                except PartAnswer as e:
                    return json.dumps(dict(e.answer)), "failed", str(e)
                except Exception as e:  # noqa: BLE001  one row's failure is that row's result
                    return None, "failed", str(e)

            async def all_rows():
                return await bounded([lambda k=k: ask(k) for k in range(len(rows))], concurrency)

            done = asyncio.run(all_rows())
            yield batch.assign(_answer=[d[0] for d in done], _status=[d[1] for d in done], _error=[d[2] for d in done])

    asked = keyed.mapInPandas(run, out_schema)
    answer = F.from_json("_answer", ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    cols = [F.coalesce(answer[n], F.array().cast(k)).alias(n) if k.startswith("array") else answer[n].alias(n) for n, k in zip(names, kinds, strict=True)]
    tail = [F.col("_status").alias("status"), F.col("_error").alias("error")] if keep_error else []
    return asked.select(*[F.col(f"`{c}`") for c in df.columns], *cols, *tail)


def new_answers(df: DataFrame, scorer: Scorer, inputs: Sequence[str]) -> DataFrame:
    """(_key, _answer) of the scored rows of df, to be kept as the cache of later runs."""
    names = [x.strip().split()[0].strip("`") for x in scorer.schema.split(", ")]
    key = F.sha2(F.concat_ws("\u0001", F.lit(scorer.name), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256)
    good = df.filter("status = 'success'") if "status" in df.columns else df
    return good.select(key.alias("_key"), F.to_json(F.struct(*names)).alias("_answer")).dropDuplicates(["_key"])


def chunked(df: DataFrame, workers: int, order: str) -> DataFrame:
    """df in `workers` contiguous partitions of its order, as chunks for that many workers."""
    return df.repartitionByRange(max(1, math.ceil(workers)), order).sortWithinPartitions(order)


def embedded(df: DataFrame, encode: Callable[[pd.DataFrame], Any], ident: str, inputs: Sequence[str], normalise: bool = True) -> DataFrame:
    """(id, vec): vectors that encode() gives for batches of rows, as 32-bit numbers, of length 1 if asked."""
    import numpy as np

    def run(batches):
        for batch in batches:
            v = np.asarray(encode(batch[list(inputs)]), np.float32)
            if normalise and len(v):
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(np.float32).tiny)
            yield pd.DataFrame({"id": batch[ident].astype("int64"), "vec": list(v)})

    return df.select(ident, *inputs).mapInPandas(run, "id bigint, vec array<float>")
