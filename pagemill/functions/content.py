"""Article content (E6-E9, E14, E15, B12), as SQL expressions over a bound page."""

from __future__ import annotations

from pagemill.functions.markup import (
    EVENTS_TYPE, NODES_TYPE, TOKEN_PATTERN, attr_markup, markup_between, parse_attrs, raw_tokens,
)
from pagemill.functions.selectors import compiled, first, matches
from pagemill.functions.sqltext import let, quote, string_array

# fixed values: markup allowed in wrappers and raw lines of include rules
ALLOWED_TAGS = (
    "div", "figure", "figcaption", "section", "article", "span", "p", "h1", "h2", "h3", "h4",
    "h5", "h6", "ul", "ol", "li", "blockquote", "em", "strong", "b", "i", "a", "br", "hr", "img",
)
COMMON_ATTRS = ("class", "id", "style")
EXTRA_ATTRS = {"a": ("href", "target"), "img": ("src", "alt", "width", "height")}
ONLY_ATTRS = {"br": ("class",)}

# a closed pre element is one token, everything else is as the page's tokens are
_PRE = r"<pre\b[^>]*+>(?:[^<]++|<(?!/pre\s*+>))*+</pre\s*+>"
# white space between two tokens, neither first nor last
_GAP = r"(?:(?<=.)[ \t\n\r\x0B\f]++(?=<))?+"
_TRIM = quote(" \t\n\r\x00\x0b")



def trim(text: str) -> str:
    return f"trim(both {_TRIM} from {text})"


def clean_content(html: str) -> str:
    """Tidy white space, line breaks and gaps between tags; ``pre`` stays as it is.

    Works on the page's tokens. White space in a token shrinks to single spaces, and a text of nothing
    else goes unless it begins or ends the content. Then only tags and texts with something to read are neighbours: of
    the line breaks between two of these half stay (rounded up), less one after an opening and one before a closing ``p``."""
    token = f"{_PRE}|{TOKEN_PATTERN.removeprefix('(?is)')}".replace(r"\1", r"\2")
    tokens = f"regexp_extract_all(_h, {quote(f'(?is){_GAP}({token})')}, 1)"
    # line ends first, so that the search for runs has no choice to make at every character
    plain = f"replace(replace(_t, {quote(chr(13))}, ' '), {quote(chr(10))}, ' ')"
    space = f"regexp_replace({plain}, {quote(r'[ \t\x0B\f][ \t\x0B\f]++')}, ' ')"
    is_pre = f"substr(_t, 1, 4) rlike {quote('(?i)^<pre')} and (endswith(_t, {quote('e>')}) or endswith(_t, {quote('E>')}))"
    tidied = f"transform({tokens}, _t -> if({is_pre}, _t, {space}))"
    # places of all tokens but line breaks, and one before the first token
    is_break = f"startswith(_vs[_i], {quote('<')}) and _vs[_i] rlike {quote(r'(?i)^<br *+/?>$')}"
    places = f"concat(array(-1), filter(sequence(0, size(_vs) - 1), _i -> not ({is_break})))"
    opened = f"if(_at >= 0 and substr(_vs[greatest(_at, 0)], 1, 3) rlike {quote(r'(?i)^<p[ />]')}, 1, 0)"
    closed = f"if(_to < size(_vs) and _vs[least(_to, size(_vs) - 1)] in ({quote('</p>')}, {quote('</P>')}), 1, 0)"
    breaks = f"""concat(array_repeat({quote('<br>')}, cast((_to - _at - 1) div 2 as int)),
        if((_to - _at - 1) % 2 = 1, array(_vs[_to - 1]), cast(array() as array<string>)))"""
    stay = let("_bs", breaks, f"array_join(slice(_bs, 1 + {opened}, greatest(0, size(_bs) - {opened} - {closed})), '')")
    piece = let(
        "_to", "coalesce(get(_ms, _j + 1), size(_vs))", f"concat(if(_at >= 0, _vs[greatest(_at, 0)], ''), if(_to - _at > 1, {stay}, ''))",
    )
    joined = f"array_join(transform(_ms, (_at, _j) -> {piece}), '')"
    cleaned = let("_vs", tidied, let("_ms", places, joined))
    return let("_h", html, f"case when _h is null or _h = '' then _h else {cleaned} end")


def fragment(stream: str, elements: str, node: str) -> str:
    """``struct<events, nodes>`` seen from one element: its subtree."""
    inside = f"filter({elements}, _n -> _n.start >= {node}.start and _n.end <= {node}.end)"
    return f"named_struct('events', {stream}, 'nodes', {inside})"


def drop_nodes(stream: str, elements: str, rules: str, root_parent: str) -> str:
    """``struct<events, nodes>`` after removing what each compiled selector of
    ``rules`` picks, one rule after the other. Removed events keep their place as
    ``gone`` so that positions stay valid."""
    picked = matches("_rule", "_w.events", "_w.nodes", root_parent)
    gone = (
        "named_struct('kind', 'gone', 'tag', cast(null as string), 'raw', '',"
        " 'attrs', cast(null as map<string,string>), 'ref', -1, 'implied', true)"
    )
    # Picked spans nest or lie apart and come in document order: those that begin after the end of all before are
    # the outermost. Kept in chunks, as appending to one long array copies it each time.
    outer = """aggregate(_ch, named_struct('last', _s.last, 'out', slice(_ch, 1, 0)), (_o, _x) -> if(_x.start <= _o.last, _o,
        named_struct('last', _x.end, 'out', array_append(_o.out, _x))))"""
    chunk = let("_r", outer, "named_struct('last', _r.last, 'out', array_append(_s.out, _r.out))")
    chunks = "transform(sequence(0, cast((size(_out) - 1) div _k as int)), _c -> slice(_out, _c * _k + 1, _k))"
    outermost = f"""aggregate({chunks}, named_struct('last', -1, 'out', array(slice(_out, 1, 0))),
        (_s, _ch) -> {chunk}, _s -> flatten(_s.out))"""
    # the events before a span, a gone one for each event in it, and what comes after the last span
    before = "if(_i = 0, 0, _os[greatest(_i - 1, 0)].end + 1)"
    cut = f"concat(slice(_w.events, {before} + 1, _x.start - {before}), array_repeat({gone}, _x.end - _x.start + 1))"
    tail = "slice(_w.events, element_at(_os, -1).end + 2, size(_w.events))"
    events = f"concat(flatten(transform(_os, (_x, _i) -> {cut})), {tail})"
    nodes = "filter(_w.nodes, _n -> _ev[_n.start].kind <> 'gone')"
    swept = let("_os", let("_k", "cast(ceil(sqrt(size(_out))) as int)", outermost), let("_ev", events, f"named_struct('events', _ev, 'nodes', {nodes})"))
    step = let("_out", picked, f"case when size(_out) = 0 then _w else {swept} end")
    start = f"named_struct('events', cast({stream} as {EVENTS_TYPE}), 'nodes', cast({elements} as {NODES_TYPE}))"
    return f"aggregate({rules}, {start}, (_w, _rule) -> {step})"


def parse_include_rules(lines: str) -> str:
    """A line starting with ``html:`` is markup to insert, any other line is
    ``selector | opening markup | closing markup``."""
    part = "coalesce(" + trim("try_element_at(split(_line, {}), {{}})".format(quote("[|]"))) + ", '')"
    return f"""transform({lines}, _line -> case when startswith(_line, {quote('html:')})
        then named_struct('kind', 'raw', 'selector', '', 'open', {trim('substr(_line, 6)')}, 'close', '')
        else named_struct('kind', 'select', 'selector', {part.format(1)},
                          'open', {part.format(2)}, 'close', {part.format(3)}) end)"""


def compiled_rules(lines: str) -> str:
    return f"""transform({parse_include_rules(lines)}, _ru -> named_struct('kind', _ru.kind,
        'selector', {compiled("_ru.selector")}, 'open', _ru.open, 'close', _ru.close))"""


def include_content(stream: str, elements: str, rules: str, root_parent: str) -> str:
    """Per rule in order, every match in document order, each wrapped."""
    picked = matches("_ru.selector", stream, elements, root_parent)
    wrapped = f"concat(_ru.open, {markup_between(stream, '_x.start', '_x.end')}, _ru.close)"
    return f"""array_join(transform({rules}, _ru -> case when _ru.kind = 'raw' then _ru.open
        else array_join(transform({picked}, _x -> {wrapped}), '') end), '')"""


def exclude_content(stream: str, elements: str, rules: str, node: str) -> str:
    """Markup of an element without what the rules pick."""
    dropped = drop_nodes(stream, elements, rules, f"{node}.parent")
    return let("_left", dropped, markup_between("_left.events", f"{node}.start", f"{node}.end"))


def content_html(stream: str, elements: str, selector: str, mode: str, include: str, remove: str) -> str:
    """Markup of the first content match after include or remove rules; null
    when nothing matches. ``include`` and ``remove`` are compiled rule arrays."""
    inside = "filter({0}, _n -> _n.start >= _node.start and _n.end <= _node.end)".format(elements)
    chosen = f"""case when {mode} = 'include' and size({include}) > 0
        then {include_content(stream, '_sub', include, '_node.parent')}
        else {exclude_content(stream, '_sub', remove, '_node')} end"""
    return let(
        "_node", first(matches(selector, stream, elements)),
        f"case when _node is not null then {let('_sub', inside, chosen)} end",
    )


def prefix_css(css: str, content: str) -> str:
    """A style element in front of the content when there is custom CSS."""
    one_line = f"regexp_replace({trim(css)}, {quote(r'\s*[\r\n]+\s*')}, ' ')"
    present = f"coalesce({css} not in ('', '0'), false)"
    return f"case when {present} then concat('<style>', {one_line}, '</style>\\n', {content}) else {content} end"


def allow_tags(html: str) -> str:
    """Keep listed tags with listed attributes; of other tags only the text stays."""
    names = {t: ONLY_ATTRS.get(t, COMMON_ATTRS + EXTRA_ATTRS.get(t, ())) for t in ALLOWED_TAGS}
    table = "map(" + ", ".join(f"{quote(t)}, {string_array(a)}" for t, a in names.items()) + ")"
    kept = "map_filter(_at, (_an, _av) -> array_contains(_al, _an))"
    opening = let(
        "_at", parse_attrs("_k"),
        f"concat('<', _tn, coalesce({attr_markup(kept)}, ''), if(endswith(_k, '/>'), ' />', '>'))",
    )
    tag = let(
        "_tn", f"lower(regexp_extract(_k, {quote(r'^</?([A-Za-z][^\s/>]*+)')}, 1))",
        let(
            "_al", f"try_element_at({table}, _tn)",
            f"""case when _al is null then ''
                when startswith(_k, '</') then concat('</', _tn, '>') else {opening} end""",
        ),
    )
    return f"""array_join(transform({raw_tokens(html)}, _k ->
        case when startswith(_k, '<') and _k <> '<' then {tag} else _k end), '')"""
