"""Deeply nested records to related flat tables.

Method: every text is read once, bottom-up, by a tree automaton. The state of a value is
made of its own kind, its field names and the states of its children, so equal shapes share
one state: ``null``, ``text``, ``number``, ``flag``, ``encoded`` (a text that is itself a JSON
object or list, with the state of what it holds), ``list`` (with the states of its items) or
``object`` (with the state of each field). States alone decide what becomes of a value: for
each place in the record grammar (:data:`GRAMMAR`) and each state met there a route is
compiled once, which says whether the state is a list of records, one record, a map of
records by key, or none; where each attribute lies and how it is parsed to the type of its
subtype table (a number in a text becomes a number; a text that is none stays in
``attributes`` and is null in the typed table); and the routes of the records below. Rows
come out of routes only. All variants of an entity keep the common supertype keys (pool_id,
branch_id, entity, parent_key, item_key); ``variant`` names the state.

Input conventions:

* a text that is null, blank or not one complete JSON value gives no rows;
* of several rows of one pool the latest ``received_at`` counts (a null is the oldest, of
  ties the greatest text), so repeats give no second object;
* absent, null and empty fields give no objects; an item without its key is left out;
* one object where a list is usual is a list of one, one text where a list of texts is
  usual is a list of one; an object of objects is a list whose keys are the item keys;
* extra columns of the input are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = (
    "pool_id bigint, branch_id string, entity string, parent_key string, item_key string, "
    "variant string, attributes string"
)


@dataclass(frozen=True)
class Record:
    """One kind of record: its entity, its key field, the paths and types of its attributes,
    the paths of the records below it, and the paths of its lists of texts.

    ``marks`` are fields that tell one record from a map of records where the key is left out;
    ``inside`` is a field that may wrap all records of the place. ``own_key`` takes the
    branch's key as the record's own."""

    entity: str
    key: str
    attributes: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    below: dict[tuple[str, ...], str] = field(default_factory=dict)
    texts: dict[tuple[str, ...], str] = field(default_factory=dict)
    entries: dict[tuple[str, ...], str] = field(default_factory=dict)
    marks: frozenset[str] = frozenset()
    inside: str | None = None
    own_key: bool = False


_STATE = ("verifier_step", "updated_state")
#: The record grammar: the places of records, from the branch down (fixed field names of the format).
GRAMMAR = {
    "branch": Record(
        "branch", "branch_id",
        {
            "decision": (("verifier_step", "continuation_decision"), "string"),
            "claim": (("verifier_step", "updated_interpretation", "mechanistic_claim"), "string"),
            "status": (("observation", "status"), "string"),
            "remaining_budget": ((*_STATE, "remaining_budget"), "bigint"),
            "reasoning_text": (("actor_step", "reasoning_text"), "string"),
        },
        below={
            ("actor_step", "tool_action"): "tool_action",
            ("local_score",): "local_score",
            (*_STATE, "predicted_groups"): "group",
            (*_STATE, "evidence_log"): "evidence",
            (*_STATE, "mechanistic_labels"): "label",
        },
        marks=frozenset({"branch_id", "actor_step", "verifier_step", "local_score", "observation"}),
        inside="branches",
    ),
    "tool_action": Record("tool_action", "call_id", {"tool_name": (("tool_name",), "string")}, entries={("arguments",): "tool_argument"}),
    "local_score": Record(
        "local_score", "branch_id",
        {
            "schema_score": (("schema_score",), "double"),
            "complex_membership_delta": (("complex_membership_delta",), "double"),
            "total_score": (("total_score",), "double"),
            "normalized_score": (("normalized_score",), "double"),
            "schema_valid": (("score_metadata", "schema_valid"), "boolean"),
        },
        entries={("score_metadata", "weights"): "score_weight"},
        own_key=True,
    ),
    "group": Record("group", "group_id", {"rationale": (("rationale",), "string")}, texts={("gene_ids",): "group_gene"}),
    "evidence": Record(
        "evidence", "evidence_id", {"source_type": (("source_type",), "string"), "summary": (("summary",), "string")},
        texts={("supporting_gene_ids",): "evidence_gene"},
    ),
    "label": Record("label", "label_name", {"label_source": (("label_source",), "string")}, texts={("evidence_ids",): "label_evidence"}),
}
#: Typed subtype tables: the attributes of each entity and their types.
SUBTYPES = {r.entity: ", ".join(f"{k} {t}" for k, (_, t) in r.attributes.items()) for r in GRAMMAR.values()} | {
    "group_gene": "position bigint",
    "evidence_gene": "position bigint",
    "label_evidence": "position bigint",
    "tool_argument": "value string, number double, n_items bigint",
    "tool_argument_item": "position bigint",
    "score_weight": "value string, number double, n_items bigint",
    "score_weight_item": "position bigint",
}
#: Lists inside free entries (arguments, weights) become rows of this entity.
ITEMS_OF = {"tool_argument": "tool_argument_item", "score_weight": "score_weight_item"}
#: Entities without the free entries.
NAMED = ("branch", "tool_action", "local_score", "group", "group_gene", "evidence", "evidence_gene", "label", "label_evidence")

#: States that one router keeps; beyond it a new one begins, and shapes are compiled anew.
MOST_STATES = 50_000
#: Names of states longer than this are shortened to a hash of what they hold.
LONGEST_STATE = 160


class State:
    """A state of the automaton: a kind and the states of the children."""

    __slots__ = ("kind", "children", "_name")

    def __init__(self, kind: str, children: tuple) -> None:
        self.kind, self.children, self._name = kind, children, None

    @property
    def name(self) -> str:
        if self._name is None:
            if self.kind == "object":
                inside = "{" + ",".join(f"{json.dumps(k)[1:-1]}:{s.name}" for k, s in self.children) + "}"
            elif self.kind == "list":
                inside = "[" + ",".join(sorted(s.name for s in self.children)) + "]"
            else:
                inside = ":" + self.children[0].name if self.kind == "encoded" else ""
            if len(inside) > LONGEST_STATE:
                inside = "#" + hashlib.sha256(inside.encode()).hexdigest()[:12]
            self._name = self.kind + inside
        return self._name

    def field(self, name: str) -> State | None:
        return dict(self.children).get(name) if self.kind == "object" else None


#: What a text that may be JSON begins with: a bracket or white space (fixed values).
OPENINGS = tuple("{[ \t\r\n\x0b\x0c\xa0")
_first = operator.itemgetter(0)


class Automaton:
    """Reads values bottom-up into (state, content) nodes. The content of an object is a dict
    of nodes, of a list a list of nodes, of an encoded text the text and the node it holds."""

    def __init__(self) -> None:
        self.states: dict[tuple, State] = {}
        self.scalars = {k: self._state(k, ()) for k in ("null", "text", "number", "flag")}
        self.text, self.null = self.scalars["text"], (self.scalars["null"], None)

    def _state(self, kind: str, children: tuple) -> State:
        found = self.states.get((kind, children))
        if found is None:
            found = self.states[kind, children] = State(kind, children)
        return found

    def read(self, value) -> tuple[State, object]:
        kind = type(value)
        if kind is str:
            return self._text(value)
        if kind is dict:
            nodes = {k: self._text(v) if type(v) is str else self.read(v) for k, v in value.items()}
            return self._state("object", tuple(sorted([(k, n[0]) for k, n in nodes.items()], key=_first))), nodes
        if kind is list:
            items = [self._text(v) if type(v) is str else self.read(v) for v in value]
            states = {n[0] for n in items}
            return self._state("list", tuple(states) if len(states) < 2 else tuple(sorted(states, key=id))), items
        if value is None:
            return self.null
        return self.scalars["flag" if kind is bool else "number"], value

    def _text(self, value: str) -> tuple[State, object]:
        if value[:1] in OPENINGS:
            bare = value.strip()
            if bare[:1] in ("{", "[") and bare[-1:] in ("}", "]"):
                try:
                    inner = self.read(json.loads(bare))
                except ValueError:
                    return self.text, value
                return self._state("encoded", (inner[0],)), (value, inner)
        return self.text, value

    def state(self, value) -> str:
        """The name of a value's state."""
        return self.read(value)[0].name


def plain(node: tuple) -> object:
    """The JSON value of a node."""
    state, content = node
    if state.kind == "object":
        return {k: plain(v) for k, v in content.items()}
    if state.kind == "list":
        return [plain(v) for v in content]
    return content[0] if state.kind == "encoded" else content


def text_of(node: tuple) -> str | None:
    """A node as text: texts as they are, other values as JSON."""
    kind, content = node[0].kind, node[1]
    if kind in ("text", "null"):
        return content
    if kind == "encoded":
        return content[0]
    if kind == "number":
        return str(content)
    return json.dumps(plain(node), ensure_ascii=False, separators=(",", ":"))


def number_of(node: tuple):
    """The number a node holds, else its text, which is no number of a typed table."""
    content = node[1]
    if node[0].kind == "number":
        return content
    if node[0].kind == "text":
        try:
            number = float(content.strip())
        except ValueError:
            return content
        return number if math.isfinite(number) else content
    return text_of(node)


def whole_of(node: tuple):
    if node[0].kind == "text":
        try:
            return int(node[1].strip())
        except ValueError:
            pass
    number = number_of(node)
    return int(number) if isinstance(number, float) and number.is_integer() else number


def flag_of(node: tuple):
    if node[0].kind == "text" and node[1].strip().lower() in ("true", "false"):
        return node[1].strip().lower() == "true"
    return node[1] if node[0].kind == "flag" else text_of(node)


PARSERS = {"string": text_of, "double": number_of, "bigint": whole_of, "boolean": flag_of}
Rows = dict[tuple, tuple]


class Router:
    """Compiles states to routes. A route takes (node, pool, branch key, parent key, rows) and
    adds the rows of all records in the node; None stands for a state that holds no record."""

    def __init__(self, automaton: Automaton, entities: Iterable[str] | None = None, attributes: bool = True) -> None:
        self.automaton = automaton
        self.wanted = set(SUBTYPES if entities is None else entities)
        self.attributes = attributes
        self.known: dict[tuple[str, State], Callable | None] = {}

    def rows(self, pool_id: int, document) -> Rows:
        node = self.automaton.read(document)
        out: Rows = {}
        route = self.route("branch", node[0])
        if route:
            route(node, pool_id, None, str(pool_id), out)
        return out

    def _put(self, rows: Rows, pool: int, branch: str, entity: str, parent: str, key: str, state: State, attributes: dict) -> None:
        where = (branch, entity, parent, key)
        if where not in rows:
            if self.attributes:
                held = json.dumps(attributes, ensure_ascii=False, separators=(",", ":"))
                rows[where] = (pool, branch, entity, parent, key, state.name, held)
            else:
                rows[where] = (pool, branch, entity, parent, key, None, None)

    def route(self, place: str, state: State) -> Callable | None:
        """Of all records that a node in ``state`` holds at ``place``."""
        if (place, state) not in self.known:
            self.known[place, state] = self._route(place, state)
        return self.known[place, state]

    def _route(self, place: str, state: State) -> Callable | None:
        record = GRAMMAR[place]
        if state.kind == "encoded":
            inner = self.route(place, state.children[0])
            return inner and (lambda node, *rest: inner(node[1][1], *rest))
        if state.kind == "list":
            routes = {s: self._item(place, s) for s in state.children}

            def each(node, pool, branch, parent, rows) -> None:
                for item in node[1]:
                    route = routes[item[0]]
                    if route:
                        route(item, pool, branch, parent, rows)

            return each if any(routes.values()) else None
        if state.kind != "object":
            return self._own(place, state) if record.own_key and state.kind != "null" else None
        fields = dict(state.children)
        if record.own_key:
            return self._own(place, state)
        if record.inside in fields and not record.marks & fields.keys():
            inner = self.route(place, fields[record.inside])
            return inner and (lambda node, *rest: inner(node[1][record.inside], *rest))
        if record.key in fields or record.marks & fields.keys():
            return self._item(place, state)
        keyed = {k: self._item(place, s, k) for k, s in fields.items()}
        if not keyed or None in keyed.values():
            return None

        def by_key(node, pool, branch, parent, rows) -> None:
            for k, route in keyed.items():
                route(node[1][k], pool, branch, parent, rows)

        return by_key

    def _item(self, place: str, state: State, key: str | None = None) -> Callable | None:
        """Of a node that is one record; ``key`` is its key in a map of records."""
        if state.kind == "encoded":
            inner = self._item(place, state.children[0], key)
            return inner and (lambda node, *rest: inner(node[1][1], *rest))
        if state.kind != "object":
            return None
        own = state.field(GRAMMAR[place].key)
        if own is not None and own.kind != "null":
            name = GRAMMAR[place].key
            return self._record(place, state, lambda node, branch: text_of(node[1][name]))
        return self._record(place, state, lambda node, branch: key)

    def _own(self, place: str, state: State) -> Callable:
        return self._record(place, state, lambda node, branch: branch)

    def _at(self, state: State, path: tuple[str, ...]) -> tuple[State, Callable] | None:
        """State of what lies at ``path`` below an object in ``state``, and how to get there."""
        steps: list[str | None] = []
        for name in path:
            if state.kind == "encoded":
                steps.append(None)
                state = state.children[0]
            inner = state.field(name)
            if inner is None or inner.kind == "null":
                return None
            steps.append(name)
            state = inner

        def get(node):
            for step in steps:
                node = node[1][1] if step is None else node[1][step]
            return node

        return state, get

    def _record(self, place: str, state: State, key_of: Callable) -> Callable:
        record = GRAMMAR[place]
        found = [(name, self._at(state, path), PARSERS[kind]) for name, (path, kind) in record.attributes.items()]
        attributes = [(name, at[1], parse) for name, at, parse in found if at] if self.attributes else []
        below = []
        for path, lower in record.below.items():
            at = self._at(state, path)
            route = at and self.route(lower, at[0])
            if route:
                below.append((at[1], route))
        lists = [(entity, self._at(state, path)) for path, entity in record.texts.items() if entity in self.wanted]
        lists = [(entity, at[1], self._texts(entity, at[0])) for entity, at in lists if at]
        entries = [(entity, self._at(state, path)) for path, entity in record.entries.items() if {entity, ITEMS_OF[entity]} & self.wanted]
        entries = [(at[1], self._entries(entity, at[0])) for entity, at in entries if at]
        lists = [x for x in lists if x[2]]
        entries = [x for x in entries if x[1]]
        shown = record.entity in self.wanted

        def add(node, pool, branch, parent, rows) -> None:
            key = key_of(node, branch)
            if key is None:
                return
            own = key if branch is None else branch
            if shown:
                held = {name: parse(get(node)) for name, get, parse in attributes}
                self._put(rows, pool, own, record.entity, parent, key, state, held)
            for get, route in below:
                route(get(node), pool, own, own, rows)
            for _, get, route in lists:
                route(get(node), pool, own, key, rows)
            for get, route in entries:
                route(get(node), pool, own, key, rows)

        return add

    def _texts(self, entity: str, state: State) -> Callable | None:
        """Of a list of texts, or one text; nulls, blanks and objects are left out."""
        if state.kind == "encoded":
            inner = self._texts(entity, state.children[0])
            return inner and (lambda node, *rest: inner(node[1][1], *rest))
        if state.kind in ("null", "object"):
            return None
        many = state.kind == "list"

        def add(node, pool, branch, parent, rows) -> None:
            position = 0
            for item in node[1] if many else (node,):
                if item[0].kind not in ("null", "object"):
                    text = text_of(item)
                    if text.strip():
                        self._put(rows, pool, branch, entity, parent, text, state, {"position": position})
                        position += 1

        return add

    def _entries(self, entity: str, state: State) -> Callable | None:
        """Of an object of free names: one row a name, and one for each item of a list in it."""
        if state.kind == "encoded":
            inner = self._entries(entity, state.children[0])
            return inner and (lambda node, *rest: inner(node[1][1], *rest))
        if state.kind != "object":
            return None
        lists = {k: self._texts(ITEMS_OF[entity], s) for k, s in state.children if s.kind == "list" and ITEMS_OF[entity] in self.wanted}

        def add(node, pool, branch, parent, rows) -> None:
            for name, value in node[1].items():
                kind = value[0].kind
                if entity in self.wanted and kind != "null":
                    held = {"n_items": len(value[1])} if kind == "list" else {"value": text_of(value)}
                    if kind == "number":
                        held["number"] = value[1]
                    self._put(rows, pool, branch, entity, parent, name, value[0], held)
                route = lists.get(name)
                if route:
                    route(value, pool, branch, name, rows)

        return add


def flatten_text(pool_id: int, text: str | None, router: Router) -> list[tuple]:
    """All objects of one text as rows of :data:`SCHEMA`, each once."""
    if text is None:
        return []
    try:
        document = json.loads(text)
    except ValueError:
        return []
    return list(router.rows(pool_id, document).values())


def _flatten(entities: tuple[str, ...] | None, attributes: bool):
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = Router(Automaton(), entities, attributes)
        for pdf in batches:
            out: list[tuple] = []
            for pool_id, text in zip(pdf["pool_id"].tolist(), pdf["branches"].tolist()):
                out += flatten_text(pool_id, text, router)
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                if len(router.automaton.states) > MOST_STATES:
                    router = Router(Automaton(), entities, attributes)
            yield pd.DataFrame(out, columns=columns)

    return run


def flatten(pools: DataFrame, entities: Iterable[str] | None = None, attributes: bool = True) -> DataFrame:
    """All objects in ``branches`` of ``pools`` (pool_id, branches, received_at), one row each;
    of some ``entities`` only, or without their ``variant`` and ``attributes`` (then null), if so asked."""
    latest = (
        pools.where(F.col("pool_id").isNotNull())
        .groupBy("pool_id")
        .agg(F.max(F.struct("received_at", "branches")).alias("_last"))
        .select(F.col("pool_id").cast("bigint"), F.col("_last.branches").alias("branches"))
    )
    return latest.mapInPandas(_flatten(None if entities is None else tuple(entities), attributes), SCHEMA)


def subtype_table(flat: DataFrame, entity: str) -> DataFrame:
    """The typed table of one entity: the supertype keys, the variant, and its own attributes."""
    fields = T._parse_datatype_string(SUBTYPES[entity])
    return (
        flat.where(F.col("entity") == entity)
        .withColumn("_a", F.from_json("attributes", fields))
        .select("pool_id", "branch_id", "parent_key", "item_key", "variant", "_a.*")
    )


def variant_counts(flat: DataFrame) -> DataFrame:
    """(entity, variant, n_objects): how often each shape was met."""
    return flat.groupBy("entity", "variant").agg(F.count("*").alias("n_objects"))
