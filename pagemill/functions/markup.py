"""Page markup as arrays, built with Spark higher-order functions only.

A page is one row, so everything here is row-local: no shuffle, no Python worker.

``events(html)``  balanced stream of markup events. Closing tags the author left
                  out are added (``implied``), closing tags without an opening
                  one are kept as ``stray`` and ignored afterwards.
``nodes(events)`` one entry per element in document order, with the positions of
                  its first and last event. Element B lies inside element A when
                  B's range lies inside A's range.

The nesting needs a stack, which is a fold over the tokens. A fold that appends to
one array per token copies that array every time, so the fold runs over chunks of
about sqrt(n) tokens: n * sqrt(n) element copies instead of n * n.

Every function takes SQL expressions and returns one: these expressions are large,
and handing Spark one text is far quicker than building them call by call.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pagemill.functions.sqltext import let, lookup, quote, string_array

# ---- fixed values: HTML vocabulary (public HTML specification) --------------
VOID_TAGS = (
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input",
    "isindex", "link", "meta", "param", "source", "track", "wbr",
)
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
)
# opening tag -> (open elements it ends, elements that shield them)
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ()),
}
# a block ends an open paragraph unless one of these lies between
PARAGRAPH_SHIELDS = ("td", "th", "table", "caption", "button", "object", "html")
# a closing tag ends open elements up to its own rank, never a higher one
CLOSE_RANKS = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
OTHER_RANK = 100
OTHER_TAG = "*"
# -----------------------------------------------------------------------------

_TAG_REST = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
TOKEN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style)\b{_TAG_REST}.*?(?:</\1\s*+>|\z)"
    rf"|</?[a-z]{_TAG_REST}"
    r"|</?[a-z][^>]*+>"
    r"|<[!?][^>]*+>"
    r"|[^<]++|<"
)
_RAW_PATTERN = rf"(?is)^(<(?:script|style)\b{_TAG_REST})(.*?)(</(?:script|style)\s*+>)?\z"
_ATTR_PATTERN = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
_ENTITY_PATTERN = r"&(?:#(?=[0-9])0*+[0-9]{0,7}|#[xX](?=[0-9a-fA-F])0*+[0-9a-fA-F]{0,6}|[A-Za-z][A-Za-z0-9]*+);|[^&]++|&"

_ATTRS = "cast(null as map<string,string>)"
_EVENT_TYPE = "struct<kind:string,tag:string,raw:string,attrs:map<string,string>,ref:int,implied:boolean>"
_STACK_TYPE = "array<struct<tag:string,at:int,own:int>>"

EVENTS_TYPE = f"array<{_EVENT_TYPE}>"
NODES_TYPE = "array<struct<start:int,end:int,parent:int,tag:string,attrs:map<string,string>>>"


# ---- entities (D9) ----------------------------------------------------------


def _named_entity(name: str) -> str:
    table = {n: chr(code) for n, code in name2codepoint.items()} | {"apos": "'"}
    pairs = "\x01".join(f"{n}\x02{ch}" for n, ch in table.items())
    return f"try_element_at(str_to_map({quote(pairs)}, {quote(chr(1))}, {quote(chr(2))}), {name})"


def _character(code: str) -> str:
    valid = f"{code} between 1 and 55295 or {code} between 57344 and 1114111"
    return f"case when {valid} then decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') end"


def decode_entities(text: str) -> str:
    """Named and numeric character references become characters; those without a
    closing semicolon stay as they are."""
    decimal = _character("cast(concat('0', ltrim('0', substr(_e, 3, length(_e) - 3))) as int)")
    hexa = _character("cast(conv(concat('0', ltrim('0', substr(_e, 4, length(_e) - 4))), 16, 10) as int)")
    piece = f"""coalesce(
        case when not (startswith(_e, '&') and endswith(_e, ';')) then _e
             when startswith(lower(_e), {quote("&#x")}) then {hexa}
             when startswith(_e, {quote("&#")}) then {decimal}
             else {_named_entity("substr(_e, 2, length(_e) - 2)")} end, _e)"""
    pieces = f"regexp_extract_all(_t, {quote(_ENTITY_PATTERN)}, 0)"
    return let(
        "_t", text,
        f"case when contains(_t, '&') then array_join(transform({pieces}, _e -> {piece}), '') else _t end",
    )


def escape_text(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# ---- tokens (D1) ------------------------------------------------------------


def raw_tokens(html: str) -> str:
    """The page cut into tags, comments and text; joined again they give the page."""
    return f"regexp_extract_all(coalesce({html}, ''), {quote(TOKEN_PATTERN)}, 0)"


def parse_attrs(tag_text: str) -> str:
    """Attributes of an opening tag, names in lower case, first of a name wins."""
    value = f"regexp_extract(_a, {quote(r'(?s)^[^\s=]++\s*+=\s*+(.*)$')}, 1)"
    unquoted = (
        "case when startswith(_v, '\"') or startswith(_v, {q}) then substr(_v, 2, length(_v) - 2) else _v end"
    ).format(q=quote("'"))
    pair = f"""named_struct('name', lower(regexp_extract(_a, {quote(r'^[^\s=]++')}, 0)),
                            'value', {let('_v', value, decode_entities(unquoted))})"""
    pairs = f"transform(regexp_extract_all(_i, {quote(_ATTR_PATTERN)}, 0), _a -> {pair})"
    first_of_name = "filter(_ps, (_p, _n) -> array_position(transform(_ps, _q -> _q.name), _p.name) = _n + 1)"
    inner = f"regexp_replace({tag_text}, {quote(r'(?i)^<[a-z][^\s/>]*+|[\s/]*+>$')}, '')"
    return let(
        "_i", inner,
        f"case when trim(_i) <> '' then map_from_entries({let('_ps', pairs, first_of_name)}) end",
    )


def _tag_bits() -> dict[str, int]:
    """One bit per tag that any nesting rule names."""
    named = {t for rule in IMPLIED_ENDS.values() for part in rule for t in part}
    return {t: 1 << i for i, t in enumerate(sorted(named | {"p"} | set(PARAGRAPH_SHIELDS) | set(CLOSE_RANKS)))}


def _tag_table() -> dict[str, str]:
    """Per tag: its bit, the bits it ends and those that shield them when it opens,
    and the bits its closing tag cannot pass."""
    bits = _tag_bits()
    rules = {t: (("p",), PARAGRAPH_SHIELDS) for t in BLOCK_TAGS} | IMPLIED_ENDS
    table = {}
    for tag in sorted(set(bits) | set(rules) | {OTHER_TAG}):
        ends, shields = rules.get(tag, ((), ()))
        rank = CLOSE_RANKS.get(tag, OTHER_RANK)
        above = [t for t, r in CLOSE_RANKS.items() if r > rank]
        masks = [bits.get(tag, 0)] + [sum(bits[t] for t in ts) for ts in (ends, shields, above)]
        table[tag] = "named_struct('own', {}, 'ends', {}, 'shields', {}, 'above', {})".format(*masks)
    return table


def _token(kind: str, raw: str, tag="cast(null as string)", attrs=_ATTRS, own="0", ends="0", shields="0") -> str:
    return (
        f"named_struct('kind', {kind}, 'tag', {tag}, 'raw', {raw}, 'attrs', {attrs},"
        f" 'own', {own}, 'ends', {ends}, 'shields', {shields})"
    )


def tokens(html: str) -> str:
    """Classified tokens; the bit masks say which open elements a tag ends. ``raw`` of
    a text token has its references decoded, all others are as written."""
    table = _tag_table()
    other = table.pop(OTHER_TAG)
    name = quote(r"^</?([A-Za-z][^\s/>]*+)")
    is_void = f"array_contains({string_array(VOID_TAGS)}, _n) or endswith(_k, '/>')"
    opening = _token(
        f"if({is_void}, 'void', 'open')", "_k", "_n",
        f"case when length(_k) > length(_n) + 2 then {parse_attrs('_k')} end", "_m.own", "_m.ends", "_m.shields"
    )
    closing = _token("'close'", "_k", "_n", shields="_m.above")
    part = [f"regexp_extract(_k, {quote(_RAW_PATTERN)}, {i})" for i in (1, 2, 3)]
    raw_element = (
        f"array({_token(quote('open'), part[0], '_n', parse_attrs(part[0]))}, {_token(quote('rawtext'), part[1])},"
        f" {_token(quote('close'), part[2], '_n')})"
    )
    tag_case = f"""case when startswith(_k, '</') then array({closing})
        when _n in ('script', 'style') then {raw_element}
        else array({opening}) end"""
    named = f"""case when _n = '' then array({_token("if(_k = '<', 'text', 'other')", "_k")})
        else {let("_m", lookup(table, "_n", other), tag_case)} end"""
    classify = f"""case
        when not startswith(_k, '<') then array({_token("'text'", decode_entities("_k"))})
        else {let("_n", f"lower(regexp_extract(_k, {name}, 1))", named)} end"""
    return f"flatten(transform({raw_tokens(html)}, _k -> {classify}))"


# ---- nesting (D2) -----------------------------------------------------------


def _event(kind: str, tag: str, raw: str, attrs: str, ref: str, implied: str = "false") -> str:
    return (
        f"named_struct('kind', {kind}, 'tag', {tag}, 'raw', {raw}, 'attrs', {attrs},"
        f" 'ref', {ref}, 'implied', {implied})"
    )


def _state(stack: str, count: str, out: str) -> str:
    return f"named_struct('stack', {stack}, 'n', {count}, 'out', {out})"


def _step() -> str:
    """Fold step: state ``_s`` (innermost open element first) and token ``_t``."""
    kinds = (
        "transform(_s.stack, _o -> case"
        " when if(_t.kind = 'close', _o.tag = _t.tag, _o.own & _t.ends <> 0) then 1"
        " when _o.own & _t.shields <> 0 then 2 else 0 end)"
    )
    reach = let(
        "_r", kinds,
        "case when array_position(_r, 1) > 0 and (array_position(_r, 2) = 0"
        " or array_position(_r, 1) < array_position(_r, 2)) then cast(array_position(_r, 1) as int) else 0 end",
    )
    ended = f"""case when _t.kind <> 'close' and _t.ends = 0 then 0
        when _t.kind = 'close' and try_element_at(_s.stack, 1).tag = _t.tag then 1 else {reach} end"""
    own_close = "_t.kind = 'close' and _i + 1 = _m"
    closes = f"""transform(slice(_s.stack, 1, _m), (_o, _i) -> {_event(
        "'close'", "_o.tag", f"if({own_close}, _t.raw, '')", _ATTRS, "_o.at", f"not ({own_close})")})"""
    parent = "coalesce(try_element_at(_s.stack, _m + 1).at, -1)"
    opened = _event("'open'", "_t.tag", "_t.raw", "_t.attrs", parent)
    empty_close = _event("'close'", "_t.tag", "''", _ATTRS, "_s.n + _m", "true")
    stray = _event("'stray'", "_t.tag", "_t.raw", _ATTRS, parent)
    own = f"""case when _t.kind = 'open' then array({opened})
        when _t.kind = 'void' then array({opened}, {empty_close})
        when _m = 0 then array({stray})
        else cast(array() as array<{_EVENT_TYPE}>) end"""
    top = "_s.stack[0]"
    closed = _event("'close'", f"{top}.tag", "_t.raw", _ATTRS, f"{top}.at")
    made = f"""case when _m = 0 then {own}
        when _m = 1 and _t.kind = 'close' then array({closed})
        else concat({closes}, {own}) end"""
    rest = "case when _m = 0 then _s.stack else slice(_s.stack, _m + 1, size(_s.stack)) end"
    stack = f"""case when _t.kind = 'open'
        then array_prepend({rest}, named_struct('tag', _t.tag, 'at', _s.n + _m, 'own', _t.own)) else {rest} end"""
    tag_step = let(
        "_m", ended,
        let("_ev", made, _state(stack, "_s.n + size(_ev)", "array_append(_s.out, _ev)")),
    )
    inner = "coalesce(try_element_at(_s.stack, 1).at, -1)"
    plain = _state(
        "_s.stack", "_s.n + 1",
        f"array_append(_s.out, array({_event('_t.kind', '_t.tag', '_t.raw', '_t.attrs', inner)}))",
    )
    return f"case when _t.kind in ('open', 'close', 'void') then {tag_step} else {plain} end"


def events(html: str) -> str:
    """Balanced event stream of a page (see module text)."""
    none = f"cast(array() as array<array<{_EVENT_TYPE}>>)"
    no_parts = f"cast(array() as array<array<array<{_EVENT_TYPE}>>>)"
    width = "greatest(12, cast(ceil(sqrt(size(_ts))) as int))"
    starts = "case when size(_ts) > 0 then sequence(1, size(_ts), _w) else cast(array() as array<int>) end"
    start = _state(f"cast(array() as {_STACK_TYPE})", "0", no_parts)
    inner = f"""aggregate(slice(_ts, _b, _w), {_state("_a.stack", "_a.n", none)}, (_s, _t) -> {_step()},
        _p -> {_state("_p.stack", "_p.n", "array_append(_a.out, _p.out)")})"""
    left_open = _event("'close'", "_x.tag", "''", _ATTRS, "_x.at", "true")
    fold = f"""aggregate({starts}, {start}, (_a, _b) -> {inner},
        _z -> concat(flatten(flatten(_z.out)), transform(_z.stack, _x -> {left_open})))"""
    return let("_ts", tokens(html), let("_w", width, fold))


def nodes(stream: str) -> str:
    """Elements in document order: ``start, end, parent, tag, attrs``."""
    closes = f"""filter(transform({stream}, (_e, _i) -> case when _e.kind = 'close'
        then named_struct('start', _e.ref, 'end', _i) end), _x -> _x is not null)"""
    opened = f"element_at({stream}, _x.start + 1)"
    node = let(
        "_o", opened,
        "named_struct('start', _x.start, 'end', _x.end, 'parent', _o.ref, 'tag', _o.tag, 'attrs', _o.attrs)",
    )
    return f"transform(sort_array({closes}), _x -> {node})"


def parsed(html: str) -> str:
    """``struct<events, nodes>`` of a page; bind it once, then select from it."""
    return let("_ev", events(html), f"named_struct('events', _ev, 'nodes', {nodes('_ev')})")


# ---- reading a range --------------------------------------------------------


def text_between(stream: str, start: str, end: str) -> str:
    """Text of the events in a range, references decoded."""
    inside = f"filter(slice({stream}, {start} + 1, {end} - {start} + 1), _e -> _e.kind in ('text', 'rawtext'))"
    return f"array_join(transform({inside}, _e -> _e.raw), '')"


def attr_markup(attrs: str) -> str:
    value = "replace(replace(_a.value, '&', '&amp;'), '\"', '&quot;')"
    return f"array_join(transform(map_entries({attrs}), _a -> concat(' ', _a.key, '=\"', {value}, '\"')), '')"


def event_markup(e: str) -> str:
    """Markup of one event: lower-case tags, quoted attributes, escaped text."""
    return f"""case
        when {e}.kind = 'text' then {escape_text(f'{e}.raw')}
        when {e}.kind = 'open' then concat('<', {e}.tag, coalesce({attr_markup(f'{e}.attrs')}, ''), '>')
        when {e}.kind = 'close' and not array_contains({string_array(VOID_TAGS)}, {e}.tag) then concat('</', {e}.tag, '>')
        when {e}.kind = 'rawtext' or startswith({e}.raw, '<!--') then {e}.raw
        else '' end"""


def markup_between(stream: str, start: str, end: str) -> str:
    """Serialised subtree."""
    inside = f"slice({stream}, {start} + 1, {end} - {start} + 1)"
    return f"array_join(transform({inside}, _k -> {event_markup('_k')}), '')"
