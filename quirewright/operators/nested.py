"""Deeply nested records to related flat tables, by structural variants.

A tree automaton reads each payload. Bottom-up, in one pass, every JSON value gets a state: a scalar its kind, a
list the set of its elements' states, an object the types of ``TYPES`` that its keys allow; the (key, state) pairs
of an object are its variant. Top-down, the grammar ``CHILDREN`` then chooses among the states an object may have:
at a key of the grammar it takes that key's type, at any other key (a wrapper, a renamed list) the type its own
state gives, if the type above may hold it; objects of no type are looked through. Each variant so gets its
type, and each type its table with the supertype's keys (record_id, child, idx1..idx4) and the link to its parent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Object types in the order they are tried: state, keys that must be there, keys of which one must be there.
TYPES = (
    ("cell", {"row_index", "column_index"}, set()),
    ("table", set(), {"cells", "table_id", "table_index"}),
    ("span", {"span_index"}, set()),
    ("citation", {"citation_index"}, set()),
    ("hit", {"rank"}, set()),
    ("page", {"page_number"}, set()),
    ("retrieval", set(), {"hits", "query_tokens"}),
    ("structured_document", {"pages"}, set()),
    ("qa_result", set(), {"retrieval", "citations", "answer_id"}),
    ("envelope", {"artifact"}, set()),
    ("box", {"x0", "x1"}, set()),
)

#: Types that a payload, or the artifact of a delivery, can have.
ROOTS = ("structured_document", "qa_result", "envelope")

#: Where children hang: parent type -> (key, child type).
CHILDREN = {
    "": (("", "structured_document"), ("", "qa_result"), ("", "envelope")),
    "envelope": (("artifact", ""),),
    "structured_document": (("pages", "page"),),
    "page": (("spans", "span"), ("tables", "table")),
    "table": (("cells", "cell"),),
    "qa_result": (("retrieval", "retrieval"), ("citations", "citation")),
    "retrieval": (("hits", "hit"),),
}
PLACES = {parent: dict(rows) for parent, rows in CHILDREN.items()}
#: What the children of a type may be where the key doesn't tell; an envelope's are those of a payload.
WITHIN = {p: {c for _, c in rows} for p, rows in CHILDREN.items()} | {"envelope": set(ROOTS)}
NESTED = {key for p, rows in CHILDREN.items() for key, _ in rows if key}

#: The index columns of each child: its own keys after those of its parent.
INDEXES = {
    "page": ("page_number",),
    "span": ("page_number", "span_index"),
    "table": ("page_number", "table_index"),
    "cell": ("page_number", "table_index", "row_index", "column_index"),
    "hit": ("rank",),
    "citation": ("citation_index", "retrieval_rank"),
}
#: Keys of an object that fill its indexes.
OWN = {k: v if k == "citation" else v[-2:] if k == "cell" else v[-1:] for k, v in INDEXES.items()}

BOX = "STRUCT<x0: DOUBLE, top: DOUBLE, x1: DOUBLE, bottom: DOUBLE>"

#: Typed columns of each subtype table beyond the common keys.
SUBTYPES = {
    "page": "page_id STRING, width DOUBLE, height DOUBLE, dimension_unit STRING, coordinate_origin STRING, source_rotation_degrees INT",
    "span": f"span_id STRING, source STRING, text STRING, confidence DOUBLE, bounding_box {BOX}",
    "table": f"table_id STRING, row_count INT, column_count INT, bounding_box {BOX}",
    "cell": f"text STRING, bounding_box {BOX}",
    "hit": f"chunk_id STRING, chunk_index INT, page_id STRING, page_number INT, score DOUBLE, text STRING, matched_terms ARRAY<STRING>, bounding_box {BOX}",
    "citation": "chunk_id STRING, excerpt STRING, excerpt_start INT, excerpt_end INT, matched_terms ARRAY<STRING>, query_term_coverage DOUBLE",
}

KEYS_DDL = "child STRING, idx1 INT, idx2 INT, idx3 INT, idx4 INT, parent STRING, parent_idx1 INT, parent_idx2 INT, variant STRING"
KEYS = [c.split()[0] for c in KEYS_DDL.split(", ")]
#: Rows of ``rejects``.
REJECT_DDL = "reason STRING, child STRING, detail STRING"

LEAVES = ("null", "bool", "number", "text")


class Automaton:
    """Bottom-up states with a memo of the transitions seen, so a known shape costs one lookup."""

    def __init__(self) -> None:
        self.names = list(LEAVES)
        self.ids = {n: i for i, n in enumerate(LEAVES)}
        self.objects: dict[tuple, tuple[int, frozenset, str, bool]] = {}
        self.lists: dict[frozenset, int] = {}
        self.holding: set[int] = set()  # states of values with a typed object in them

    def _id(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        return self.ids[name]

    def object(self, keyed: tuple) -> tuple[int, frozenset, str]:
        """State, possible types and variant of an object with these (key, child state) pairs."""
        known = self.objects.get(keyed)
        if known is None:
            keys = {k for k, _ in keyed}
            possible = [s for s, need, one in TYPES if need <= keys and (not one or one & keys)]
            name = possible[0] if possible else "object"
            holds = bool(possible) or any(s in self.holding for _, s in keyed)
            state = self._id(name if possible or not holds else "wrapper")
            if holds:
                self.holding.add(state)
            variant = _clean(name + "{" + ",".join(f"{k}:{self.names[s]}" for k, s in sorted(keyed)) + "}")
            known = self.objects[keyed] = (state, frozenset(possible), variant)
        return known

    def list(self, states: frozenset) -> int:
        known = self.lists.get(states)
        if known is None:
            known = self.lists[states] = self._id("[" + "|".join(sorted(self.names[s] for s in states)) + "]")
            if states & self.holding:
                self.holding.add(known)
        return known

    def read(self, root: object) -> dict[int, tuple]:
        """The states of all objects and lists below ``root``, by their identity: (state, possible, variant, coded).

        A string of JSON at a key of the grammar is replaced by what it holds. No recursion, so any depth is read.
        """
        seen: dict[int, tuple] = {}
        if not isinstance(root, (dict, list)):
            return seen
        stack = [_frame(root, False, False, None)]
        while stack:
            value, rest, states, nested, coded, name = stack[-1]
            for key, x in rest:
                kind = type(x)
                if kind is str:
                    inner = _decoded(x) if nested or key in NESTED else x
                    if inner is x:
                        states.append((key, 3))
                        continue
                    value[key] = inner
                    stack.append(_frame(inner, key in NESTED or nested, True, key))
                    break
                if kind is dict or kind is list:
                    stack.append(_frame(x, key in NESTED or nested, False, key))
                    break
                states.append((key, 0 if x is None else 1 if kind is bool else 2))
            else:
                stack.pop()
                if type(value) is dict:
                    state, possible, variant = self.object(tuple(states))
                    seen[id(value)] = (state, possible, variant, coded)
                else:
                    state = self.list(frozenset(s for _, s in states))
                    seen[id(value)] = (state, frozenset(), "", coded)
                if stack:
                    stack[-1][2].append((name, state))
        return seen


def _frame(value: object, nested: bool, coded: bool, name: object) -> tuple:
    """What is open of an object or list: itself, its rest, the states of its values, whether strings in it are read."""
    whole = type(value) is list
    return value, iter(list(enumerate(value) if whole else value.items())), [], nested and whole, coded, name


def _decoded(text: str) -> object:
    """What a string holds where it is a JSON object or list, however often it was encoded; else the string itself."""
    inner: object = text
    while isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = parsed(inner)
        except ValueError:
            return text
    return inner if isinstance(inner, (dict, list)) else text


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def parsed(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parsed_deep(text)


def _parsed_deep(text: str) -> object:
    """``parsed`` with a stack of its own, for what is nested too deeply for the interpreter's."""
    at, out, stack, key = 0, [], [], None
    top: list = out
    want = "value"
    while True:
        at = _SPACE.match(text, at).end()
        if at == len(text):
            if stack or want == "value":
                raise ValueError("the text ends early")
            return out[0]
        ch = text[at]
        if want == "value" and ch in "{[":
            new: object = {} if ch == "{" else []
            _put(top, key, new)
            stack.append((top, key))
            top, key = new, None
            at += 1
            want = "first key" if ch == "{" else "first value"
        elif want in ("first key", "key") and ch == '"':
            key, at = json.decoder.scanstring(text, at + 1)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, want = at + 1, "value"
        elif ch in "}]" and want in ("comma", "first key", "first value") and stack and (ch == "}") == isinstance(top, dict):
            top, key = stack.pop()
            at, want = at + 1, "comma"
        elif want == "first value":
            want = "value"
        elif want == "comma" and ch == "," and stack:
            at, want = at + 1, "key" if isinstance(top, dict) else "value"
        elif want == "value":
            if ch == '"':
                value, at = json.decoder.scanstring(text, at + 1)
            else:
                m = _SCALAR.match(text, at)
                if m is None:
                    raise ValueError("no value")
                value, at = json.loads(m.group()), m.end()
            _put(top, key, value)
            want = "comma"
        else:
            raise ValueError(f"unexpected {ch!r}")


def _put(top: object, key: str | None, value: object) -> None:
    if isinstance(top, dict):
        top[key] = value
    else:
        top.append(value)


def _whole(value: object) -> int | None:
    """An integer as far as a value can be read as one."""
    try:
        return int(value) if value is not None and not isinstance(value, (bool, dict, list)) else None
    except (TypeError, ValueError, OverflowError):
        return None


def _int32(value: object) -> int | None:
    n = _whole(value)
    return n if n is not None and -(1 << 31) <= n < 1 << 31 else None


def _double(value: object) -> float | None:
    try:
        return float(value) if value is not None and not isinstance(value, (bool, dict, list)) else None
    except (ValueError, OverflowError):
        return None


def _clean(text: str) -> str:
    """``text`` with ``?`` for halves of surrogate pairs, which JSON can escape and no table can hold."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")
    return text


def _string(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return _clean(value)
    try:
        return _clean(json.dumps(value, ensure_ascii=False))
    except RecursionError:
        return None


def _strings(value: object) -> list | None:
    return [_string(x) for x in value] if isinstance(value, list) else None


def _box(value: object) -> dict | None:
    """A box, also one written as [x0, top, x1, bottom] or as a string."""
    if isinstance(value, str):
        value = _decoded(value)
    names = ("x0", "top", "x1", "bottom")
    if isinstance(value, list) and len(value) == 4:
        value = dict(zip(names, value))
    return {n: _double(value.get(n)) for n in names} if isinstance(value, dict) else None


def _columns(ddl: str) -> list[tuple[str, str]]:
    """Top-level (name, type) of a DDL string."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[start:i])
            start = i + 1
    return [tuple(p.strip().split(" ", 1)) for p in (*parts, ddl[start:])]


_READ = {"STRING": _string, "DOUBLE": _double, "INT": _int32, "ARRAY<STRING>": _strings, BOX: _box}
_ARROW = {
    "STRING": pa.string(), "DOUBLE": pa.float64(), "INT": pa.int32(), "ARRAY<STRING>": pa.list_(pa.string()),
    BOX: pa.struct([(n, pa.float64()) for n in ("x0", "top", "x1", "bottom")]),
}
_FIELDS = {child: [(n, _READ[t]) for n, t in _columns(ddl)] for child, ddl in SUBTYPES.items()}


def flatten(payload: str | None, automaton: Automaton) -> tuple[list[tuple], list[tuple]]:
    """(children, rejects) of one payload: (key columns, object) of every child, rows of ``REJECT_DDL``.

    A child, or a list of children, that comes as a string of JSON is read like one that doesn't; the variant of the
    first rows below begins with ``text:``. A payload without children is rejected only if it is missing, unreadable
    or of no known type; an index that no INT holds is null and listed as a reject, and the child is kept.
    """
    found: list[tuple] = []
    rejects: list[tuple] = []
    if payload is None or payload == "":
        return found, [("missing", None, None)]
    try:
        root = parsed(payload)
    except ValueError as e:
        return found, [("unreadable", None, str(e)[:200])]
    coded = isinstance(root, str)
    root = _decoded(root) if coded else root
    states = automaton.read(root)
    known = False
    # value, type its place gives, type above, emitted parent, its indexes, place in its list, read from a string
    stack = [(root, None, "", "", (), 1, coded)]
    while stack:
        value, wanted, above, parent, path, place, coded = stack.pop()
        if type(value) is list:
            # of a list without a typed object only one at a key of the grammar is read
            if wanted is not None or states[id(value)][0] in automaton.holding:
                coded = coded or states[id(value)][3]
                stack += [(x, wanted, above, parent, path, n, coded) for n, x in enumerate(value, 1)]
            continue
        if type(value) is not dict:
            continue
        state, possible, variant, own = states[id(value)]
        coded = coded or own
        if wanted is not None:
            kind = wanted
        else:
            may = WITHIN.get(above, set())
            kind = next((t for t in (ROOTS if above in ("", "envelope") else (s for s, _, _ in TYPES)) if t in possible and t in may), None)
            if kind is None and not possible and state in automaton.holding and may:
                # an object of no type is looked through
                stack += [(x, None, above, parent, path, 1, coded) for x in value.values() if type(x) in (dict, list)]
                continue
        if kind is None:
            continue
        known = True
        if kind in INDEXES:
            mine = []
            for name in OWN[kind]:
                n = _whole(value.get(name))
                if n is None and kind == "table":
                    n = place
                if n is not None and not -(1 << 31) <= n < 1 << 31:
                    rejects.append(("index out of range", kind, f"{name}={n}"[:200]))
                    n = None
                mine.append(n)
            key = (*path, *mine) if kind != "citation" else tuple(mine)
            full = (*key, 0, 0, 0, 0)[:4]
            found.append(((kind, *full, parent, *(*path, 0, 0)[:2], "text:" + variant if coded else variant), value))
            path, parent, coded = key, kind, False
        elif kind in ("structured_document", "qa_result"):
            parent = kind
        places = PLACES.get(kind, {})
        for k, x in value.items():
            if type(x) is dict or type(x) is list:
                child = places.get(k)
                if child is not None or k not in NESTED and kind in WITHIN:
                    stack.append((x, child or None, kind, parent, path, 1, coded))
    if not known:
        rejects.append(("no known type", None, None))
    return found, rejects


def _rows(records: DataFrame, id_col: str, payload_col: str, columns: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """One Arrow pass over the payloads: ``make(found, rejects)`` gives the column values of each payload's rows."""
    id_type = records.schema[id_col].dataType.simpleString()
    narrow = records.select(F.col(id_col).alias("_id"), F.col(payload_col).cast("string").alias("_payload"))
    names, kinds = [c[0] for c in columns], [c[2] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            ids, at, out = batch.column(0), [], [[] for _ in kinds]

            def emit() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["_id", *names]
                )

            for i, payload in enumerate(batch.column(1).to_pylist()):
                for row in make(*flatten(payload, automaton)):
                    at.append(i)
                    for col, v in zip(out, row):
                        col.append(v)
                if len(at) >= 20_000:
                    yield emit()
                    at, out = [], [[] for _ in kinds]
            yield emit()

    ddl = ", ".join(f"{name} {kind}" for name, kind, _ in columns)
    return narrow.mapInArrow(run, f"_id {id_type}, {ddl}").withColumnRenamed("_id", id_col)


def _of(ddl: str, prefix: str = "") -> list[tuple[str, str, pa.DataType]]:
    return [(prefix + n, t, _ARROW[t]) for n, t in _columns(ddl)]


def children(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """One row for each child object of every readable payload: ``id_col`` and the columns of ``KEYS_DDL``.

    Unused indexes are 0; an index that is missing or that no INT holds is null; a null id is kept; repeated rows and
    redeliveries give their rows again; a child given as one object counts as a list of one, one given as a string of
    JSON as what it holds; null list entries are skipped. What gives no rows is in ``rejects``. Other columns of the
    input are not read. One pass without a shuffle.
    """
    return _rows(records, id_col, payload_col, _of(KEYS_DDL), lambda found, rejects: (keys for keys, _ in found))


def rejects(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(``id_col``, reason, child, detail): payloads that are missing, unreadable or of no known type, and the
    indexes of kept children that no INT holds."""
    return _rows(records, id_col, payload_col, _of(REJECT_DDL), lambda found, rejects: rejects)


def _typed(child: str, value: dict) -> dict:
    return {n: read(value.get(n)) for n, read in _FIELDS[child]}


def typed_children(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """``children`` with one struct column for each type, filled where the row is of it: all subtype tables in one pass."""
    kinds = list(SUBTYPES)
    columns = _of(KEYS_DDL)
    for c in kinds:
        own = _of(SUBTYPES[c])
        columns.append((f"{c}_columns", "STRUCT<" + ", ".join(f"{n}: {t}" for n, t, _ in own) + ">", pa.struct([(n, t) for n, _, t in own])))
    return _rows(
        records, id_col, payload_col, columns,
        lambda found, rejects: ((*keys, *(_typed(c, value) if c == keys[0] else None for c in kinds)) for keys, value in found),
    )


def subtype_table(records: DataFrame, child: str, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """The typed table of one child type: common keys, parent link, variant and the type's own columns."""
    names = [n for n, _ in _FIELDS[child]]
    rows = _rows(
        records, id_col, payload_col, _of(KEYS_DDL) + _of(SUBTYPES[child], "own_"),
        lambda found, rejects: ((*keys, *_typed(child, value).values()) for keys, value in found if keys[0] == child),
    )
    return rows.select(id_col, *KEYS, *(F.col(f"own_{n}").alias(n) for n in names))


def write_tables(records: DataFrame, path: str, id_col: str = "record_id", payload_col: str = "payload") -> None:
    """Writes the rows of all types in one pass, each type in its folder ``child=<type>``."""
    typed_children(records, id_col, payload_col).write.mode("errorifexists").partitionBy("child").parquet(path)


def read_table(spark, path: str, child: str) -> DataFrame:
    """A subtype table of ``write_tables``; reads the files and columns of that type only."""
    rows = spark.read.parquet(path).filter(F.col("child") == child)
    return rows.select(*(c for c in rows.columns if not c.endswith("_columns")), f"{child}_columns.*")


def variants(rows: DataFrame) -> DataFrame:
    """How often each structural variant of each child type occurs."""
    return rows.groupBy("child", "variant").agg(F.count("*").alias("objects"))
