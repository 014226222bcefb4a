"""The contract compiled to one column of violations.

The contract becomes a constant table: object kinds with their required names, and for every field its shape, what it may
hold and the object kind below it. One expression walks a document by that table, once more for every level of nesting
(four in a brief), so the plan's size follows the depth of the contract and not its number of fields. Every object is
turned into a map once. The expression is written as SQL text, which costs one call to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.contract import BRIEF, List, Map

VIOLATION = "struct<path: string, keyword: string, detail: string>"
_NONE = f"cast(array() as array<{VIOLATION}>)"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values) -> str:
    return "cast(array(" + ", ".join(_text(v) for v in values) + ") as array<string>)"


def _rule(kind: object, kinds: dict[str, dict], key: str) -> str:
    """A field as a struct. Kinds of scalars: s string, v null, i whole number, n other number, o object."""
    shape, most, unique, below = "scalar", None, False, None
    if isinstance(kind, List):
        shape, most, unique, kind = "list", kind.most, kind.unique, kind.of
    elif isinstance(kind, Map):
        shape, kind = "map", kind.of
    if isinstance(kind, dict):
        shape = "object" if shape == "scalar" else shape
        below = next((k for k, known in kinds.items() if known is kind), key)
        kinds.setdefault(below, kind)
    if isinstance(kind, tuple):
        allowed, enum, least = "sv" if None in kind else "s", _strings(k for k in kind if k is not None), None
    else:
        name = kind if isinstance(kind, str) else "obj"
        allowed = {"str": "s", "num": "in", "int": "i", "obj": "o"}[name[:3]] + ("v" if "?" in name else "")
        enum, least = "cast(null as array<string>)", name.split(">=")[1] if ">=" in name else None
    values = {
        "shape": _text(shape), "kinds": _text(allowed), "enum": enum, "least": f"cast({least or 'null'} as double)", "most": f"cast({'null' if most is None else most} as int)",
        "uniq": str(unique).lower(), "below": f"cast({'null' if below is None else _text(below)} as string)",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def table(contract: dict) -> tuple[str, int]:
    """The table as a constant map expression, and the depth of nesting."""
    kinds: dict[str, dict] = {"": contract}
    rows, at = [], 0
    while at < len(kinds):
        key = list(kinds)[at]
        named = {k.rstrip("!"): sub for k, sub in kinds[key].items()}
        fields = ", ".join(f"{_text(n)}, {_rule(sub, kinds, f'{key}/{n}')}" for n, sub in named.items())
        need = _strings(k.rstrip("!") for k in kinds[key] if k.endswith("!"))
        rows.append(f"{_text(key)}, named_struct('names', {_strings(named)}, 'need', {need}, 'fields', map({fields}))")
        at += 1

    def deep(kind: object) -> int:
        kind = kind.of if isinstance(kind, (List, Map)) else kind
        return 1 + max(map(deep, kind.values())) if isinstance(kind, dict) else 0

    return "map(" + ", ".join(rows) + ")", deep(contract)


def _one(path: str, keyword: str, detail: str = "''") -> str:
    return f"named_struct('path', {path}, 'keyword', '{keyword}', 'detail', {detail})"


def _bind(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _join(path: str, name: str) -> str:
    return f"concat_ws('/', nullif({path}, ''), {name})"


def _scalar(x: str, r: str, path: str, d: int) -> str:
    """Violations of a scalar; a wrong type of an enumeration breaks both keywords."""
    t, c = f"t{d}", f"c{d}"
    number = f"try_variant_get({x}, '$', 'double')"
    code = (
        f"case when {t} = 'STRING' then 's' when {t} = 'VOID' then 'v' when {t} like 'OBJECT%' then 'o' "
        f"when {t} in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') or {t} like 'DECIMAL%' "
        f"then if({number} = floor({number}), 'i', 'n') else 'x' end"
    )
    listed = f"({c} = 's' and array_contains({r}.enum, try_variant_get({x}, '$', 'string')) or {c} = 'v' and instr({r}.kinds, 'v') > 0)"
    judge = (
        f"array_compact(array(if(instr({r}.kinds, {c}) = 0, {_one(path, 'type')}, null), "
        f"if({r}.enum is not null and not {listed}, {_one(path, 'enum')}, null), "
        f"if({r}.least is not null and {c} in ('i', 'n') and {number} < {r}.least, {_one(path, 'minimum')}, null)))"
    )
    return _bind(t, f"schema_of_variant({x})", _bind(c, code, judge))


def _object(x: str, kind: str, path: str, d: int) -> str:
    """Violations of an object of a kind (a struct of the table), with ``d`` levels below."""
    m, e, r = f"m{d}", f"e{d}", f"r{d}"
    extra = f"array_except(map_keys({m}), {kind}.names)"
    absent = f"transform(array_except({kind}.need, map_keys({m})), n{d} -> {_one(path, 'required', f'n{d}')})"
    each = _bind(r, f"try_element_at({kind}.fields, {e}.key)", f"if({r} is null, {_NONE}, {_value(f'{e}.value', r, f'p{d}', d - 1)})")
    below = f"flatten(transform(map_entries({m}), {e} -> {_bind(f'p{d}', _join(path, f'{e}.key'), each)}))"
    closed = f"if(size({extra}) > 0, array({_one(path, 'additionalProperties', f'array_join(array_sort({extra}), {_text(",")})')}), {_NONE})"
    body = f"if({m} is null, array({_one(path, 'type')}), concat({closed}, {absent}, {below}))"
    return _bind(m, f"try_variant_get({x}, '$', 'map<string,variant>')", body)


def _value(x: str, r: str, path: str, d: int) -> str:
    """Violations of a field's value. An object is treated as the only item of a list of its kind."""
    a, y, i, k, q = f"a{d}", f"y{d}", f"i{d}", f"k{d}", f"q{d}"
    scalar = _scalar(x, r, path, d)
    entries = _bind(f"w{d}", f"try_variant_get({x}, '$', 'map<string,variant>')", f"if(w{d} is null, array({_one(path, 'type')}), "
                    f"flatten(transform(map_entries(w{d}), z{d} -> {_scalar(f'z{d}.value', r, _join(path, f'z{d}.key'), d)})))")  # fmt: skip
    item = _scalar(y, r, q, d)
    if d > 0:
        item = f"if({r}.below is null, {item}, {_bind(k, f'element_at(spec, {r}.below)', _object(y, k, q, d))})"
    at = f"if({r}.shape = 'list', {_join(path, f'cast({i} as string)')}, {path})"
    own = (
        f"array_compact(array(if(size({a}) > {r}.most, {_one(path, 'maxItems')}, null), "
        f"if({r}.uniq and size(array_distinct(transform({a}, u{d} -> to_json(u{d})))) < size({a}), {_one(path, 'uniqueItems')}, null)))"
    )
    listed = f"if({a} is null, array({_one(path, 'type')}), concat({own}, flatten(transform({a}, ({y}, {i}) -> {_bind(q, at, item)}))))"
    many = _bind(a, f"if({r}.shape = 'list', try_variant_get({x}, '$', 'array<variant>'), array({x}))", listed)
    return f"case {r}.shape when 'scalar' then {scalar} when 'map' then {entries} else {many} end"


def violations(column: str, contract: dict = BRIEF) -> Column:
    """All violations of a parsed document in a VARIANT column, ordered by path, keyword and detail; the root's path is ''.

    NULL (not parsed) gives NULL. A value that is not an object violates the root's type. ``format`` is an annotation and
    isn't asserted; 1.0 is an integer; true is not a number.
    """
    spec, depth = table(contract)
    walk = _bind("spec", spec, _bind("root", "element_at(spec, '')", _object(f"`{column}`", "root", "''", depth)))
    return F.expr(f"if(`{column}` is null, null, array_sort({walk}))")


def shown(violation: Column) -> Column:
    """``a/b/0: keyword detail``, with <root> for the empty path."""
    where = F.coalesce(F.nullif(violation.path, F.lit("")), F.lit("<root>"))
    return F.concat(where, F.lit(": "), violation.keyword, F.when(violation.detail == "", "").otherwise(F.concat(F.lit(" "), violation.detail)))


def first_messages(found: Column, most: int = 5) -> Column:
    return F.transform(F.slice(found, 1, most), shown)
