"""Nested JSON records as an adjacency table, and entity tables made from it.

``shred`` turns each body into rows (node, parent, label, ordinal, kind, scalar),
one for every object, list and scalar in it. Node numbers follow document order.
``entities`` joins the objects held by given container fields with their scalar
children and pivots these into one row per object, each with a link to the
nearest enclosing object of every other entity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import WHITESPACE, scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import materialize, ship

class _Number(str):
    """A number as it stands in the text."""


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """Strict JSON of any depth; numbers keep their text, so that ids compare as written."""
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except RecursionError:
        return _parse_deep(text)


def _skip(text: str, at: int) -> int:
    return WHITESPACE.match(text, at).end()


def _deep_key(text: str, at: int) -> tuple[str, int]:
    """A key and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _skip(text, at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _skip(text, at + 1)


def _parse_deep(text: str):
    """The same without recursion, for what is nested too deeply for ``json.loads``."""
    holders: list[tuple[dict | list, str | None]] = []
    at = _skip(text, 0)
    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            value = {} if c == "{" else []
            at = _skip(text, at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, at = _deep_key(text, at)
                holders.append((value, key))
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            for word, value in (("null", None), ("true", True), ("false", False)):
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                number = NUMBER_RE.match(text, at)
                if number is None:
                    raise ValueError(f"no value at {at}")
                value, at = _Number(number[0]), number.end()
        while holders:
            holder, key = holders[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            at = _skip(text, at)
            c = text[at : at + 1]
            if c == ",":
                at = _skip(text, at + 1)
                if key is not None:
                    key, at = _deep_key(text, at)
                    holders[-1] = holder, key
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end or comma at {at}")
            holders.pop()
            value, at = holder, at + 1
        else:
            if _skip(text, at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def _writable(text: str | None) -> str | None:
    """The text with halves of characters, which JSON can escape and UTF-8 cannot hold, replaced."""
    try:
        if text is not None:
            text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _inner(value: str):
    """JSON text of an object or list inside a field, else the text itself."""
    head = value.lstrip()[:1]
    if head in "{[" and head:
        try:
            return parse(value)
        except ValueError:
            return value
    return value


def _keyed(value: dict, record_fields: frozenset[str]) -> bool:
    """Whether an object's keys are ids of the objects it holds."""
    if not value or not record_fields.isdisjoint(value):
        return False
    for v in value.values():
        v = _inner(v) if type(v) is str else v
        if not (isinstance(v, dict) or v is None):
            return False
    return True


def walk(doc, containers: dict[str, str], record_fields: frozenset[str]) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, entity, map_key, scopes) of every node, parents first.

    containers: entity by container field. record_fields: fields that mark an object
    as one record; an object held by a container without any of them whose values
    are all objects is keyed by id. scopes: the nearest enclosing object
    of each entity, the node itself not counted. No recursion, so depth is unbounded.
    """
    stack = [(doc, -1, None, None, None, None, ())]
    count = 0
    while stack:
        value, parent, label, ordinal, entity, map_key, scopes = stack.pop()
        if type(value) is str:
            value = _inner(value)
        node, count = count, count + 1
        if isinstance(value, dict):
            yield node, parent, label, ordinal, "object", None, entity, map_key, scopes
            if entity is not None:
                scopes = (*((e, n) for e, n in scopes if e != entity), (entity, node))
            below = []
            for i, (k, v) in enumerate(value.items()):
                if k in containers:
                    # a container is a node of its own; what it holds are the entity's objects
                    below.append((_Container(v, containers[k]), node, k, i, None, None, scopes))
                else:
                    below.append((v, node, k, i, None, None, scopes))
            stack.extend(reversed(below))
        elif isinstance(value, (list, _Container)):
            held = value.value if isinstance(value, _Container) else value
            of = value.entity if isinstance(value, _Container) else entity
            if type(held) is str:
                held = _inner(held)
            if isinstance(held, list):
                yield node, parent, label, ordinal, "array", None, None, map_key, scopes
                stack.extend((_Container(v, of) if of and isinstance(v, list) else v, node, label, i, of if not isinstance(v, list) else None, None, scopes) for i, v in reversed(list(enumerate(held))))
            elif isinstance(held, dict) and of and _keyed(held, record_fields):
                yield node, parent, label, ordinal, "map", None, None, map_key, scopes
                stack.extend((v, node, k, i, of, k, scopes) for i, (k, v) in reversed(list(enumerate(held.items()))))
            else:
                count -= 1
                stack.append((held, parent, label, ordinal, of, map_key, scopes))
        else:
            kind = "null" if value is None else "number" if isinstance(value, _Number) else "boolean" if isinstance(value, bool) else "string"
            scalar = None if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)
            yield node, parent, label, ordinal, kind, scalar, None, map_key, scopes


class _Container:
    __slots__ = ("value", "entity")

    def __init__(self, value, entity):
        self.value, self.entity = value, entity


def _shredder(containers: dict[str, str], keep: frozenset[str] | None, record_fields: frozenset[str]):
    entities = sorted(set(containers.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * len(entities)]
        names = ["src", "digest", "node", "parent", "label", "ordinal", "kind", "scalar", "entity", "map_key", *(f"in_{e}" for e in entities)]
        for batch in batches:
            rows: list[tuple] = []
            for src, digest, body in zip(*(batch.column(c).to_pylist() for c in ("src", "digest", "body"))):
                try:
                    doc = parse(body)
                except ValueError:
                    continue
                for node, parent, label, ordinal, kind, scalar, entity, map_key, scopes in walk(doc, containers, record_fields):
                    if keep is not None and entity is None and (label not in keep or kind not in ("string", "number", "boolean")):
                        continue
                    at = dict(scopes)
                    rows.append((src, digest, node, parent, _writable(label), ordinal, kind, _writable(scalar), entity, _writable(map_key), *(at.get(e) for e in entities)))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def shred(
    docs: DataFrame,
    *,
    doc_id: str,
    body: str,
    containers: dict[str, str],
    scalars: list[str] | None = None,
    record_fields: frozenset[str] = frozenset(),
) -> DataFrame:
    """Adjacency rows of every body that is strict JSON, with ``in_<entity>`` links.

    A container field holds a list, a single object or an object keyed by ids, and
    any field may hold JSON text, which is read as what it stands for. With
    ``scalars``, only entity objects and the scalars of these labels are kept.
    Keyed by ids is a held object whose values are all objects or null, unless it
    has a container field, one of ``scalars`` or one of ``record_fields``.

    Null, empty and invalid bodies give no row. A null ``doc_id`` stays null;
    bodies under one ``doc_id`` are told apart by ``digest``. Numbers keep their
    text. Of a key repeated in one object the last value counts.
    """
    entities = sorted(set(containers.values()))
    schema = "src bigint, digest bigint, node int, parent int, label string, ordinal int, kind string, scalar string, entity string, map_key string"
    schema += "".join(f", in_{e} int" for e in entities)
    ship(docs.sparkSession)
    rows = docs.where(F.col(body).isNotNull()).select(F.col(doc_id).cast("long").alias("src"), F.xxhash64(F.col(body)).alias("digest"), F.col(body).cast("string").alias("body"))
    return rows.mapInArrow(_shredder(containers, frozenset(scalars) if scalars is not None else None, record_fields.union(containers, scalars or ())), schema)


def entities(nodes: DataFrame, scalars: list[str], scopes: list[str]) -> DataFrame:
    """One row per entity object: its scalar children pivoted into columns, and its enclosing objects.

    The join of objects with their scalar children is a grouping: an object is
    keyed by its own number and a scalar by its parent's, so one shuffle does both.
    """
    is_object = F.col("entity").isNotNull() & (F.col("kind") == "object")
    is_scalar = F.col("kind").isin("string", "number", "boolean") & F.col("label").isin(scalars)
    keyed = nodes.where(is_object | is_scalar).withColumn("object", F.when(is_object, F.col("node")).otherwise(F.col("parent")))
    own = lambda c: F.max(F.when(is_object, F.col(c)))
    pivot = [F.max(F.when(~is_object & (F.col("label") == s), F.col("scalar"))).alias(s) for s in scalars]
    return (
        keyed.groupBy("src", "digest", "object")
        .agg(own("entity").alias("entity"), own("map_key").alias("map_key"), own("parent").alias("parent"), own("ordinal").alias("ordinal"), *(own(f"in_{s}").alias(f"in_{s}") for s in scopes), *pivot)
        .where(F.col("entity").isNotNull())
    )


def _id(column: str) -> F.Column:
    text = F.col(column)
    return F.when(F.trim(text) != "", text)


def users_and_posts(docs: DataFrame, *, doc_id: str = "raw_no", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(users, posts) of nested bodies.

    users(src, digest, object, user_id, name); posts(src, digest, object, parent,
    post_id, title, user_id): user_id is what the post names, otherwise the id of
    the nearest user object around it. An object keyed by id has that id unless
    it has one of its own; null and blank ids are none. Ids are compared as text.
    """
    containers = {"users": "user", "posts": "post", "replies": "post"}
    nodes = shred(docs, doc_id=doc_id, body=body, containers=containers, scalars=["id", "user_id", "name", "title"])
    # kept as a table, so that bodies are read and parsed once for both sides of the link
    found = materialize(entities(nodes, ["id", "user_id", "name", "title"], ["user"]), "entities")
    found = found.withColumn("own_id", F.coalesce(_id("id"), _id("map_key")))
    users = found.where("entity = 'user'").select("src", "digest", "object", F.col("own_id").alias("user_id"), "name")
    posts = found.where("entity = 'post'").select("src", "digest", "object", "parent", "own_id", "title", _id("user_id").alias("named"), "in_user")
    around = users.select(F.col("src").alias("u_src"), F.col("digest").alias("u_digest"), F.col("object").alias("u_object"), F.col("user_id").alias("holder"))
    linked = posts.join(around, F.col("src").eqNullSafe(F.col("u_src")) & (F.col("digest") == F.col("u_digest")) & (F.col("in_user") == F.col("u_object")), "left")
    posts = linked.select("src", "digest", "object", "parent", F.col("own_id").alias("post_id"), "title", F.coalesce("named", "holder").alias("user_id"))
    return users, posts


def post_links(docs: DataFrame, *, doc_id: str = "raw_no", body: str = "body") -> DataFrame:
    """(raw_no, user_id, post_id), once per body, of the posts that have an id and an owner."""
    _, posts = users_and_posts(docs, doc_id=doc_id, body=body)
    return posts.where("post_id IS NOT NULL AND user_id IS NOT NULL").select(F.col("src").alias(doc_id), "user_id", "post_id").distinct()
