"""Model stages and their offline stand-ins.

An embedder is a function from a text column to a vector column, a reranker from two text
columns to a score from 0 to 1, a generator from a prompt to JSON text. The stand-ins are
deterministic and need no files; their quality says nothing about that of a model.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema
from lectern.functions import text

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Encoder(Protocol):
    """Unit vectors of texts; loaded once a worker by the function that makes it."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashed_words(dim: int = schema.EMBED_DIM) -> Encoder:
    """Stand-in: signed hashed bag of words, of length 1 (or 0 without words)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)

    return encode


def embedder(make: Callable[[], Encoder] | None = None, dim: int = schema.EMBED_DIM, batch: int = 32, prefix: str = "") -> Callable[[Column], Column]:
    """A vector column expression; `make` runs once a worker, and its vectors must have length dim."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make() if make else hashed_words(dim)
        for s in parts:
            texts = [prefix + (t or "") for t in s]
            rows: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                found = encode(texts[i : i + batch])
                if found.shape[1] != dim:
                    raise ValueError(f"the encoder gives {found.shape[1]} dimensions, not {dim}")
                rows += list(found)
            yield pd.Series(rows)

    return embed


def query_embedder(make: Callable[[], Encoder] | None = None, dim: int = schema.EMBED_DIM) -> Callable[[Column], Column]:
    """The embedder of questions: the same encoder, told by a prefix that the text is one."""
    return embedder(make, dim, prefix=QUERY_PREFIX)


def symmetric_embedder(make: Callable[[], Encoder] | None = None, dim: int = schema.EMBED_DIM) -> Callable[[Column], Column]:
    """The embedder for comparing question with question, as answer relevancy does: no prefix on either side."""
    return embedder(make, dim)


def overlap_score(query: Column, content: Column) -> Column:
    """Stand-in reranker: the share of the query's distinct words that the content has."""
    q = F.array_distinct(text.words(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text.words(content))) / F.size(q))


def parsed(raw: Column, fields: str) -> Column:
    """JSON text by schema; what does not fit is null."""
    return F.from_json(raw, fields, {"mode": "PERMISSIVE"})


def conforms(fields: str) -> Callable[[str], dict]:
    """A check of JSON text against a schema (DDL): an object with all fields that are not null, each of its type."""
    want = T.StructType.fromDDL(fields)

    def check(value, kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            if not isinstance(value, dict):
                raise ValueError(f"{at or 'the answer'} is not an object")
            for f in kind.fields:
                if value.get(f.name) is not None:
                    check(value[f.name], f.dataType, f"{at}.{f.name}")
                elif not f.nullable:
                    raise ValueError(f"{at}.{f.name} is missing")
        elif isinstance(kind, T.ArrayType):
            if not isinstance(value, list):
                raise ValueError(f"{at} is not a list")
            for i, x in enumerate(value):
                check(x, kind.elementType, f"{at}[{i}]")
        elif not isinstance(value, int if isinstance(kind, T.IntegerType) else str) or isinstance(value, bool):
            raise ValueError(f"{at} is not {'a whole number' if isinstance(kind, T.IntegerType) else 'a text'}")

    def valid(raw: str) -> dict:
        found = json.loads(raw)
        check(found, want, "")
        return found

    return valid


class Generator(Protocol):
    """JSON text for a prompt; temperature as the caller's mode wants it."""

    def __call__(self, system: str, user: str, temperature: float) -> str: ...


def generate(prompts: DataFrame, make: Callable[[], Generator], system: str, valid: Callable[[str], object] = json.loads, temperature: float = 0.2) -> DataFrame:
    """prompts (query_id, prompt) with raw and error; an answer that is not valid is asked for once more, with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                ask, raw, error = prompt, None, None
                for _ in range(2):
                    raw, error = None, None
                    try:
                        raw = model(system, ask, temperature)
                        valid(raw)
                        break
                    except Exception as e:  # noqa: BLE001 - one bad answer is a result, not the end of the batch
                        raw, error = None, str(e)[:200]
                        ask = f"{prompt}\nThe last answer was not valid: {error}"
                out.append((raw, error))
            yield b.assign(raw=[r for r, _ in out], error=[e for _, e in out])

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, prompt string, raw string, error string")


def extractive_answers() -> Generator:
    """Stand-in: one claim a passage, its first sentence word for word."""

    def answer(system: str, user: str, temperature: float) -> str:
        claims = []
        for i, body in re.findall(r"(?ms)^\[(\d+)\] \[.*?\]\n(.*?)(?=^\[\d+\] \[|\Z)", user):
            sentence = re.split(r"(?<=[.!?])\s", body.strip())[0]
            claims.append({"text": sentence, "passage_index": int(i), "supporting_quote": sentence})
        return json.dumps({"claims": claims, "analogy": "", "exam_angle": "", "common_trap": "", "check_yourself": [], "not_covered": ""})

    return answer


def extractive_quiz() -> Generator:
    """Stand-in: as many questions a section as asked for, each on a line of it."""

    def answer(system: str, user: str, temperature: float) -> str:
        out = []
        for i, n, body in re.findall(r"(?ms)^\[section (\d+)\] .*?; questions wanted: (\d+)\n(.*?)(?=^---$|\Z)", user):
            lines = [x for x in body.splitlines() if re.search(r"[a-zA-Z0-9]", x)]
            out += [{"question": f"What does the material say in: {x[:60]}?", "answer": x, "supporting_quote": x, "section_index": int(i)} for x in lines[: int(n)]]
        return json.dumps({"questions": out})

    return answer
