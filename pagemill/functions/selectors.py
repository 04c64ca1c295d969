"""Selectors as data.

A selector is a short path language over page elements:

    //tag  /tag  *  [@a]  [@a="v"]  [contains(@a,"v")]  [contains(.,"v")]
    [starts-with(@a,"v")]  [n]  [a and b]
    [string-length(normalize-space()) > n]  (path)[n]  path | path  path/@a

``compiled`` turns the text into nested arrays with regular expressions, ``matches``
walks those arrays over the element list of a page. The selector is a column like any
other, so one plan serves any number of profiles, each with its own selectors.
``[n]`` counts from 1 among the kept children of one parent; ``(path)[n]`` counts over
the whole page, as in XPath.
"""

from __future__ import annotations

from pagemill.functions.markup import text_between
from pagemill.functions.sqltext import let, quote

_NAME = r"[A-Za-z_][\w.-]*(?::(?!:)[\w.-]+)*"
_STRING = r"""(?:"[^"]*"|'[^']*')"""
_SUBJECT = rf"(?:@{_NAME}|\.|text\(\))"
_CONDITION = (
    rf"(?:\d+|(?:contains|starts-with)\(\s*{_SUBJECT}\s*,\s*{_STRING}\s*\)"
    rf"|string-length\(\s*normalize-space\(\s*\.?\s*\)\s*\)\s*>\s*\d+"
    rf"|{_SUBJECT}\s*=\s*{_STRING}|@{_NAME})"
)
_PREDICATE = rf"\[\s*{_CONDITION}(?:\s+and\s+{_CONDITION})*\s*\]"
_STEP = rf"//?(?:{_NAME}|\*)(?:\s*{_PREDICATE})*"
_PATH = rf"(?:{_STEP})+"
_UNION = rf"{_PATH}(?:\s*\|\s*{_PATH})*"
_GROUP = rf"(?:\(\s*{_UNION}\s*\)\s*\[\s*\d+\s*\]|{_PATH})(?:/@{_NAME})?"
SELECTOR_PATTERN = rf"^\s*{_GROUP}(?:\s*\|\s*{_GROUP})*\s*$"

COMPILED_TYPE = (
    "array<struct<paths:array<array<struct<deep:boolean,tag:string,"
    "conds:array<struct<kind:string,name:string,value:string,num:int>>>>>,nth:int,attr:string>>"
)


def is_valid(selector: str) -> str:
    return f"coalesce({selector} rlike {quote(SELECTOR_PATTERN)}, false)"


def _found(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {quote(pattern)}, {group})"


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, 0)"


def compiled(selector: str) -> str:
    """Nested arrays for a selector text, null when the text is not a selector."""
    subject = _found("_d", rf"^(?:[a-z-]+\(\s*)?@({_NAME})")
    quoted = _found("_d", rf"({_STRING})\s*\)?$")
    condition = f"""named_struct(
        'kind', case when _d rlike {quote(r'^[0-9]+$')} then 'nth'
                     when startswith(_d, 'string-length') then 'longer'
                     when startswith(_d, 'contains') then 'contains'
                     when startswith(_d, 'starts-with') then 'starts'
                     when endswith(_d, {quote('"')}) or endswith(_d, {quote("'")}) then 'equals'
                     else 'has' end,
        'name', if({subject} = '', '.', {subject}),
        'value', substr({quoted}, 2, length({quoted}) - 2),
        'num', coalesce(try_cast({_found("_d", r"(\d+)$")} as int), 0))"""
    step = f"""named_struct(
        'deep', startswith(_q, '//'),
        'tag', {_found("_q", rf"^//?({_NAME}|\*)")},
        'conds', transform(flatten(transform({_all("_q", _PREDICATE)},
            _b -> {_all("substr(_b, 2, length(_b) - 2)", _CONDITION)})), _d -> {condition}))"""
    group = f"""named_struct(
        'paths', transform(
            {_all(f"regexp_replace(_g, {quote(rf'/@{_NAME}$')}, '')", _PATH)},
            _r -> transform({_all("_r", _STEP)}, _q -> {step})),
        'nth', if(startswith(_g, '('), cast({_found("_g", r"\)\s*\[\s*(\d+)\s*\](?:/@[^\]]*)?$")} as int), null),
        'attr', nullif({_found("_g", rf"/@({_NAME})$")}, ''))"""
    return f"case when {is_valid(selector)} then transform({_all(selector, _GROUP)}, _g -> {group}) end"


def _nth_of_parent(found: str) -> str:
    """Keep the elements that are the ``_d.num``-th among those with their parent."""
    key = "shiftleft(cast({0}.parent + 2 as bigint), 32) + {0}.start"
    ordered = f"sort_array(transform({found}, _y -> {key.format('_y')}))"
    rank = (
        f"array_position(_o, {key.format('_x')})"
        " - array_position(_pa, cast(_x.parent + 2 as bigint)) + 1"
    )
    return let(
        "_o", ordered,
        let("_pa", "transform(_o, _y -> shiftright(_y, 32))", f"filter({found}, _x -> {rank} = _d.num)"),
    )


def _condition(stream: str) -> str:
    text = text_between(stream, "_x.start", "_x.end")
    spaced = rf"regexp_replace({text}, {quote('[ \t\r\n]+')}, ' ')"
    value = f"case when _d.name = '.' then {text} else try_element_at(_x.attrs, _d.name) end"
    return f"""coalesce(case _d.kind
        when 'has' then try_element_at(_x.attrs, _d.name) is not null
        when 'equals' then {value} = _d.value
        when 'contains' then contains(coalesce({value}, ''), _d.value)
        when 'starts' then startswith(coalesce({value}, ''), _d.value)
        when 'longer' then length(trim({spaced})) > _d.num end, false)"""


def matches(selector: str, stream: str, elements: str, root_parent: str = "-1") -> str:
    """D3: elements of ``elements`` that a compiled selector picks, in document order.

    ``root_parent`` is the position above which the search starts: -1 for a page, the
    parent of an element when only its subtree is searched (``elements`` then holds
    that subtree).
    """
    narrowed = f"""aggregate(_q.conds, {{}}, (_f, _d) -> case when _d.kind = 'nth' then {_nth_of_parent("_f")}
        else filter(_f, _x -> {_condition(stream)}) end)"""
    on_axis = """(_q.tag = '*' or _n.tag = _q.tag) and exists(_c, _u ->
        if(_q.deep, _n.start > _u.start and _n.end < _u.end, _n.parent = _u.start))"""
    root = (
        f"array(named_struct('start', {root_parent}, 'end', 2147483647, 'parent', -2, 'tag', '',"
        " 'attrs', cast(null as map<string,string>)))"
    )
    stepped = narrowed.format(f"filter({elements}, _n -> {on_axis})")
    path = f"aggregate(_r, {root}, (_c, _q) -> {stepped})"
    several = "array_sort(flatten({0}), (_l, _h) -> _l.start - _h.start)"
    distinct = let("_w", "{0}", "filter(_w, (_x, _i) -> _i = 0 or _w[_i - 1].start <> _x.start)")
    union = let(
        "_v", f"transform(_g.paths, _r -> {path})",
        f"case when size(_v) = 1 then _v[0] else {distinct.format(several.format('_v'))} end",
    )
    nth = let("_v", union, "case when _g.nth is null then _v when _g.nth > 0 then slice(_v, _g.nth, 1) else slice(_v, 1, 0) end")
    result = let(
        "_v", nth,
        """transform(filter(_v, _x -> _g.attr is null or try_element_at(_x.attrs, _g.attr) is not null),
            _x -> named_struct('start', _x.start, 'end', _x.end, 'parent', _x.parent, 'tag', _x.tag,
                               'attrs', _x.attrs, 'attr', _g.attr))""",
    )
    groups = f"transform(coalesce({selector}, cast(array() as {COMPILED_TYPE})), _g -> {result})"
    return let(
        "_z", groups,
        f"case when size(_z) = 1 then _z[0] else {distinct.format(several.format('_z'))} end",
    )


def node_text(stream: str, node: str) -> str:
    """D4 for a selector result: attribute value or text of the element."""
    return (
        f"case when {node}.attr is not null then try_element_at({node}.attrs, {node}.attr)"
        f" else {text_between(stream, f'{node}.start', f'{node}.end')} end"
    )


def first(nodes: str) -> str:
    """First element in document order, null when there is none."""
    return f"try_element_at({nodes}, 1)"
