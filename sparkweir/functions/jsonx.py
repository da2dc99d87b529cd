"""JSON texts, arrays of structs and hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import pandas_function
from .text import SECRET_NAMES


def at_paths(text: Column, *paths: str) -> Column:
    """The first of the paths that has a value that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, p)), F.lit("")) for p in paths])


def as_object(text: Column) -> Column:
    """The text if it is a JSON object, else {}."""
    variant = F.try_parse_json(text)
    return F.when(F.coalesce(F.schema_of_variant(variant), F.lit("")).startswith("OBJECT"), text).otherwise("{}")


def envelope(text: Column, key: str = "report") -> Column:
    """What an object holds under the key, or the object itself."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), text)


def array_size(text: Column, path: str) -> Column:
    """Elements of the array at a path, 0 where there is none."""
    return F.coalesce(F.json_array_length(F.get_json_object(text, path)), F.lit(0))


def int_at(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("int")


def outer_object(text: Column) -> Column:
    """From the first brace to the last, if that is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def secret_key_likely(text: Column) -> Column:
    """A quick test that is true wherever has_secret_key() is."""
    return F.coalesce(text.rlike(rf'(?i)"[^"]*({SECRET_NAMES})[^"]*"\s*:'), F.lit(False))


def _has_secret_key(value) -> bool:
    import re

    name = re.compile(rf"(^|_)({SECRET_NAMES})(_|$)")
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if any(name.search(re.sub(r"[^a-z0-9]+", "_", str(k).lower())) for k in x):
                return True
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return False


@pandas_function("boolean")
def has_secret_key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether any key of a JSON text, at any depth, names a secret; null for null, false for what isn't JSON."""

    def one(text):
        if text is None:
            return None
        try:
            return _has_secret_key(json.loads(text))
        except ValueError:
            return False

    for part in texts:
        yield part.map(one, na_action="ignore").astype("boolean")


def _leaves(value, out: list, most: int) -> None:
    todo = [value]
    while todo and len(out) < most:
        x = todo.pop()
        if isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
        elif x is not None:
            out.append(str(x))


def corpus(most: int = 30000):
    """A function of a JSON column: all its values in order, parted by spaces and cut."""

    @pandas_function("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            out: list[str] = []
            try:
                _leaves(json.loads(text), out, most)
            except (ValueError, TypeError):
                out = [text or ""]
            return " ".join(out)[:most]

        for part in texts:
            yield part.map(one)

    return run


def canonical(value) -> str:
    """Keys sorted, no spaces, decimals plain; not-a-number is an error."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return x

    number = lambda x: int(x) if x == x.to_integral_value() and "." not in str(x) else float(x)
    return json.dumps(plain(json.loads(value, parse_float=lambda s: number(Decimal(s)), parse_constant=lambda s: (_ for _ in ()).throw(ValueError(s)))), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pandas_function("string")
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(canonical, na_action="ignore")


def _depth_and_nodes(text, value=None):
    """value: what the text holds, if it has been read."""
    if text is None:
        return None, None
    todo, deepest, nodes = [(json.loads(text) if value is None else value, 1)], 0, 0
    while todo:
        x, depth = todo.pop()
        nodes, deepest = nodes + 1, max(deepest, depth)
        if isinstance(x, (dict, list)):
            todo += [(v, depth + 1) for v in (x.values() if isinstance(x, dict) else x)]
    return deepest, nodes


@pandas_function("struct<depth:int,nodes:int>")
def structure(texts: pd.Series) -> pd.DataFrame:
    """How deep a JSON text goes, and its number of values; for limits on both."""
    return pd.DataFrame(texts.map(_depth_and_nodes).tolist(), columns=["depth", "nodes"])


def searched(most: int = 30000):
    """A function of a JSON column: has_secret_key(), corpus(), canonical_json() and structure() by one worker, which reads a text twice.

    Each function of its own has a worker beside those of the others, with as much memory.
    """

    @pandas_function("struct<secret:boolean,corpus:string,canonical:string,depth:int,nodes:int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text):
            if text is None:
                return None, "", None, None, None
            value, out = json.loads(text), []
            _leaves(value, out, most)
            return _has_secret_key(value), " ".join(out)[:most], canonical(text), *_depth_and_nodes(text, value)

        for part in texts:
            yield pd.DataFrame([one(x) for x in part], columns=["secret", "corpus", "canonical", "depth", "nodes"], dtype=object)

    return run


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def fingerprint(*columns: Column) -> Column:
    """Of the columns in order, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])).cast("binary"), 256)


def content_marks(docs: Column) -> Column:
    """Of an array of structs (id, title, text): id, title, hash and length of the text."""
    return F.transform(docs, lambda d: F.struct(d["id"].alias("id"), d["title"].alias("title"), digest(d["text"]).alias("sha256"), F.length(d["text"]).alias("chars")))


def by_id(items: Column, field: str, value: Column) -> Column:
    return F.get(F.filter(items, lambda x: x[field] == value), F.lit(0))


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
