"""Reading model replies: envelope, fence, JSON and the four reply shapes."""

from __future__ import annotations

from paperloom.functions.basics import (
    empty,
    float_of_text,
    float_text,
    last_wins_map,
    let,
    lit,
    struct,
)
from paperloom.functions.fixed_values import (
    DEFAULT_CLASS_CONFIDENCE,
    DEFAULT_DATA_TYPE,
    DEFAULT_FIELD_CONFIDENCE,
    DEFAULT_FIELD_NAME,
    DEFAULT_REASONING,
    DOCUMENT_TYPES,
    MODEL_CONFIDENCE,
)
from paperloom.functions.rules import FIX
from paperloom.functions.spans import SPAN, make_span, mask_for, type_for

FIELD = "struct<name:string,value:string,confidence:double,data_type:string>"
_NO_FIX = f"CAST({struct(data='map()', untruthy='array()')} AS {FIX})"


# ---- typed access to VARIANT ------------------------------------------------
# A member that is absent is NULL; a member that is JSON null is not.


def _get(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _text_only(v: str) -> str:
    """The text of a JSON string, NULL for every other kind."""
    return f"CASE WHEN {_kind(v)} = 'STRING' THEN CAST({v} AS STRING) END"


def _number(v: str) -> str:
    return f"try_variant_get({v}, '$', 'double')"


def _as_float(v: str) -> str:
    """Python's ``float(x)`` of a JSON value; NULL where that raises."""
    return (
        f"CASE WHEN {_kind(v)} RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)' THEN {_number(v)} "
        f"WHEN {_kind(v)} = 'STRING' THEN {float_of_text(f'CAST({v} AS STRING)')} END"
    )


def _as_index(v: str) -> str:
    """A whole number, NULL for anything else."""
    return (
        f"CASE WHEN {_kind(v)} RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)' "
        f"AND {_number(v)} = floor({_number(v)}) THEN try_cast({_number(v)} AS INT) END"
    )


def value_text(v: str) -> str:
    """The text Python's ``str`` gives a JSON scalar; JSON text for collections."""
    text = "CAST(val AS STRING)"
    long_int = "kind LIKE '%,0)' AND abs(try_variant_get(val, '$', 'double')) >= 9.2e18"
    body = (
        f"CASE WHEN kind = 'VOID' THEN NULL "
        f"WHEN kind IN ('STRING', 'BIGINT') THEN {text} "
        f"WHEN kind = 'BOOLEAN' THEN initcap({text}) "
        f"WHEN kind LIKE 'DECIMAL%' AND {long_int} THEN {text} "
        f"WHEN kind RLIKE '^(DOUBLE|DECIMAL)' THEN {float_text(_number('val'))} "
        f"ELSE {text} END"
    )
    return let("val", v, let("kind", _kind("val"), body))


def _is_untruthy(v: str) -> str:
    """0, false and empty collections; NULL and texts are judged by their text."""
    body = (
        "CASE WHEN kind = 'BOOLEAN' THEN NOT CAST(val AS BOOLEAN) "
        f"WHEN kind RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN {_number('val')} = 0 "
        "WHEN kind RLIKE '^(ARRAY|OBJECT)' THEN CAST(val AS STRING) IN ('[]', '{}') "
        "ELSE false END"
    )
    return let("val", v, let("kind", _kind("val"), body))


def _fix_of(v: str, payload: str, path: str) -> str:
    """A JSON object as FIX, keys in the order they were written."""
    members = f"try_variant_get({v}, '$', 'map<string,variant>')"
    # A VARIANT object lists its keys sorted; the text has them as written.
    keys = (
        "CASE WHEN size(m) < 2 THEN map_keys(m) "
        f"ELSE array_distinct(json_object_keys(get_json_object({payload}, '{path}'))) END"
    )
    fix = struct(
        data=f"map_from_arrays(ks, transform(ks, k -> {value_text('m[k]')}))",
        untruthy=f"filter(ks, k -> {_is_untruthy('m[k]')})",
    )
    return f"CAST({let('m', members, let('ks', keys, fix))} AS {FIX})"


# ---- envelope, fence, JSON --------------------------------------------------


def envelope_text(reply: str) -> str:
    """The model's text inside a service reply, or the reply itself."""
    found = (
        "coalesce(try_variant_get(env, '$.outputs[0].text', 'string'), "
        "try_variant_get(env, '$.choices[0].message.content', 'string'), "
        "try_variant_get(env, '$.content[0].text', 'string'), "
        f"{_text_only(_get('env', 'content'))}, {reply})"
    )
    # Most replies are plain; only those that may have such a key are parsed.
    # (A key can also be spelled with escapes.)
    marks = ("outputs", "choices", "content", "\\u")
    maybe = " OR ".join(f"contains({reply}, {lit(m)})" for m in marks)
    return (
        f"CASE WHEN {maybe} THEN {let('env', f'try_parse_json({reply})', found)} "
        f"ELSE {reply} END"
    )


def unfenced(text: str) -> str:
    """What stands in the first ``json`` fence, else the first fence, else all.

    A fence that never closes loses the last character, as slicing to -1 does.
    """
    opened = (
        "CASE WHEN instr(txt, '```json') > 0 THEN instr(txt, '```json') + 7 "
        "ELSE instr(txt, '```') + 3 END"
    )
    blank = lit(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")
    inside = (
        "substring(txt, o, greatest(0, CASE WHEN locate('```', txt, o) > 0 "
        "THEN locate('```', txt, o) - o ELSE length(txt) - o END))"
    )
    cut = let("o", opened, f"regexp_replace({inside}, {blank}, '')")
    return let("txt", text, f"CASE WHEN instr(txt, '```') = 0 THEN txt ELSE {cut} END")


def payload(reply: str) -> str:
    return unfenced(envelope_text(reply))


def parsed(payload_text: str) -> str:
    """The payload as VARIANT when it is one JSON object, else NULL.

    Wrapping it in an array with an end mark makes trailing text an error, which
    the parser alone would skip.
    """
    wrapped = (
        f"try_variant_get(try_parse_json(concat('[', {payload_text}, ',\"end\"]')), "
        "'$', 'array<variant>')"
    )
    whole = f"size(a) = 2 AND CAST(get(a, 1) AS STRING) = 'end' AND {_kind('get(a, 0)')} LIKE 'OBJECT%'"
    return let("a", wrapped, f"CASE WHEN {whole} THEN get(a, 0) END")


# Stand for an escaped backslash and quote, and begin the name of a replaced key, while a text is cut
# into tokens; no characters by definition of Unicode.
_BACKSLASH, _QUOTE, _RENAMED = "\ufdd0", "\ufdd1", "\ufdd2"


def single_keys(payload_text: str) -> str:
    """JSON in which an object keeps the last member of each repeated key, at any depth.

    NULL where no object repeats a key, where the text is not JSON even so, or where it holds one of the three
    non-characters used here. Cuts the text into tokens, finds the members of every object in one
    pass over them, and leaves out those that a later one replaces.
    """
    hidden = f"replace(replace(txt, '{chr(92) * 4}', '{_BACKSLASH}'), '{chr(92) * 2}\"', '{_QUOTE}')"
    token = lit(r'"[^"]*+"|[{}\[\],:]|[^\s"{}\[\],:]++|"')

    def shown(text: str) -> str:
        return f"replace(replace({text}, '{_QUOTE}', '{chr(92) * 2}\"'), '{_BACKSLASH}', '{chr(92) * 4}')"

    member = "struct<c:int,k:string,s:int,e:int>"
    start = f"CAST({struct(open=empty(member), done=empty(member))} AS struct<open:array<{member}>,done:array<{member}>>)"
    top = "element_at(acc.open, -1)"
    below = "slice(acc.open, 1, size(acc.open) - 1)"

    def one(c: str, k: str, first: str, last: str) -> str:
        return f"CAST({struct(c=c, k=k, s=first, e=last)} AS {member})"

    def closed(last: str) -> str:
        ended = one(f"{top}.c", f"{top}.k", f"{top}.s", last)
        return f"CASE WHEN {top}.s >= 0 THEN concat(acc.done, array({ended})) ELSE acc.done END"

    tok = "element_at(toks, i + 1)"
    name = f"coalesce(CAST(try_parse_json({shown('element_at(toks, i)')}) AS STRING), element_at(toks, i))"
    fresh = one("i", "CAST(NULL AS STRING)", "-1", "-1")
    again = one(f"{top}.c", "CAST(NULL AS STRING)", "-1", "-1")
    named = one(f"{top}.c", name, "i - 1", "-1")
    step = (
        f"CASE WHEN {tok} IN ('{{', '[') THEN {struct(open=f'concat(acc.open, array({fresh}))', done='acc.done')} "
        "WHEN size(acc.open) = 0 THEN acc "
        f"WHEN {tok} = ':' AND i > 0 THEN {struct(open=f'concat({below}, array({named}))', done='acc.done')} "
        f"WHEN {tok} = ',' THEN {struct(open=f'concat({below}, array({again}))', done=closed('i'))} "
        f"WHEN {tok} IN ('}}', ']') THEN {struct(open=below, done=closed('i - 1'))} "
        "ELSE acc END"
    )
    members = (
        f"array_sort(aggregate(sequence(0, size(toks) - 1), {start}, (acc, i) -> {step}, acc -> acc.done))"
    )
    replaced = (
        "filter(ms, (m, j) -> j + 1 < size(ms) AND element_at(ms, j + 2).c = m.c "
        "AND element_at(ms, j + 2).k = m.k)"
    )
    renamed = (
        f"transform(toks, (t, i) -> CASE WHEN exists(gone, m -> m.s = i) "
        f"THEN concat('\"{_RENAMED}', CAST(i AS STRING), '\"') ELSE t END)"
    )
    kept = "filter(toks, (t, i) -> NOT exists(gone, m -> i BETWEEN m.s AND m.e))"
    valid = parsed(shown(f"array_join({renamed}, ' ')"))
    made = (
        f"CASE WHEN size(gone) > 0 AND {valid} IS NOT NULL THEN {shown(f'array_join({kept}, chr(32))')} END"
    )
    found = let("toks", f"regexp_extract_all({hidden}, {token}, 0)", let("ms", members, let("gone", replaced, made)))
    keys = lit(r'"[^"]*+"(?=\s*+:)')
    repeats = let("ks", f"regexp_extract_all({hidden}, {keys}, 0)",
                  "size(array_distinct(ks)) < size(ks) OR contains(txt, '\\\\u')")
    apart = " AND ".join(f"NOT contains(txt, '{c}')" for c in (_BACKSLASH, _QUOTE, _RENAMED))
    return let("txt", payload_text, f"CASE WHEN {apart} AND ({repeats}) THEN {found} END")


# ---- the four shapes --------------------------------------------------------


def classification(v: str) -> str:
    """STRUCT<document_type, confidence, reasoning>; NULL when unusable."""
    name = (
        f"CASE WHEN {_get(v, 'document_type')} IS NULL THEN 'unknown' "
        f"ELSE lower({_text_only(_get(v, 'document_type'))}) END"
    )
    confidence = (
        f"CASE WHEN {_get(v, 'confidence')} IS NULL THEN {DEFAULT_CLASS_CONFIDENCE}D "
        f"ELSE {_as_float(_get(v, 'confidence'))} END"
    )
    why = _get(v, "reasoning")
    reasoning = (
        f"CASE WHEN {why} IS NULL THEN {lit(DEFAULT_REASONING)} ELSE {_text_only(why)} END"
    )
    known = ", ".join(lit(t) for t in DOCUMENT_TYPES)
    result = struct(
        document_type=f"CASE WHEN n IN ({known}) THEN n ELSE 'unknown' END",
        confidence="c",
        reasoning=reasoning,
    )
    usable = (
        f"{v} IS NOT NULL AND n IS NOT NULL AND c IS NOT NULL "
        f"AND ({why} IS NULL OR {_kind(why)} IN ('STRING', 'VOID'))"
    )
    return let("n", name, let("c", confidence, f"CASE WHEN {usable} THEN {result} END"))


def _items(v: str, key: str) -> str:
    """The objects of a listed member; everything else in the list is skipped."""
    listed = f"try_variant_get({v}, '$.{key}', 'array<variant>')"
    return f"filter({listed}, x -> {_kind('x')} LIKE 'OBJECT%')"


def extracted_fields(v: str) -> str:
    """ARRAY<FIELD>; NULL when one bad item spoils the whole reply."""

    def text_or(key: str, default: str) -> str:
        return (
            f"CASE WHEN {_get('x', key)} IS NULL THEN {lit(default)} "
            f"ELSE {_text_only(_get('x', key))} END"
        )

    field = struct(
        name=text_or("name", DEFAULT_FIELD_NAME),
        value=f"CASE WHEN {_get('x', 'value')} IS NULL THEN '' "
              f"ELSE {value_text(_get('x', 'value'))} END",
        confidence=f"CASE WHEN {_get('x', 'confidence')} IS NULL "
                   f"THEN {DEFAULT_FIELD_CONFIDENCE}D ELSE {_as_float(_get('x', 'confidence'))} END",
        data_type=text_or("data_type", DEFAULT_DATA_TYPE),
    )
    sound = (
        "forall(fs, f -> f.name IS NOT NULL AND f.data_type IS NOT NULL "
        "AND coalesce(f.confidence BETWEEN 0 AND 1, false))"
    )
    read = let(
        "fs",
        f"transform({_items(v, 'fields')}, x -> {field})",
        f"CASE WHEN {sound} THEN fs END",
    )
    return (
        f"CAST(CASE WHEN {v} IS NULL THEN NULL "
        f"WHEN {_get(v, 'fields')} IS NULL THEN array() "
        f"WHEN {_kind(_get(v, 'fields'))} RLIKE '^(OBJECT|STRING)' THEN array() "
        f"WHEN {_kind(_get(v, 'fields'))} LIKE 'ARRAY%' THEN {read} END AS array<{FIELD}>)"
    )


def structured_data(v: str, payload_text: str, fields: str) -> str:
    """I8: FIX of ``structured_data``, or of the fields when that is empty.

    NULL when it is neither an object nor replaceable by fields.
    """
    member = _get(v, "structured_data")
    flags = f"transform({_items(v, 'fields')}, y -> coalesce({_is_untruthy(_get('y', 'value'))}, false))"
    names = f"transform({fields}, f -> f.name)"
    from_fields = struct(
        data=last_wins_map("ns", f"transform({fields}, f -> f.value)"),
        untruthy=f"map_keys(map_filter({last_wins_map('ns', flags)}, (fk, falsy) -> falsy))",
    )
    is_empty = (
        f"({member} IS NULL OR {_kind(member)} = 'VOID' "
        f"OR ({_kind(member)} = 'STRING' AND CAST({member} AS STRING) = '') "
        f"OR {_is_untruthy(member)})"
    )
    return (
        f"CASE WHEN {v} IS NULL THEN NULL "
        f"WHEN {is_empty} AND size({fields}) > 0 "
        f"THEN CAST({let('ns', names, from_fields)} AS {FIX}) "
        f"WHEN {_kind(member)} LIKE 'OBJECT%' "
        f"THEN {_fix_of(member, payload_text, '$.structured_data')} "
        f"WHEN {member} IS NULL THEN {_NO_FIX} END"
    )


def average_confidence(fields: str) -> str:
    """0 without fields."""
    total = f"aggregate({fields}, 0D, (acc, f) -> acc + f.confidence)"
    return f"CASE WHEN size({fields}) > 0 THEN {total} / size({fields}) ELSE 0D END"


def model_spans(v: str) -> str:
    """ARRAY<SPAN> of a detection reply; one bad span empties the list.

    Types that cannot be mapped are dropped before they can be bad.
    """

    def text_or_empty(key: str) -> str:
        return (
            f"CASE WHEN {_get('x', key)} IS NULL THEN '' ELSE {_text_only(_get('x', key))} END"
        )

    start = f"CASE WHEN {_get('x', 'start')} IS NULL THEN 0 ELSE {_as_index(_get('x', 'start'))} END"
    stop = _get("x", "end")
    end = (
        f"CASE WHEN {stop} IS NULL THEN st + length(va) "
        f"WHEN {_kind(stop)} = 'STRING' THEN try_cast(trim(CAST({stop} AS STRING)) AS INT) "
        f"ELSE {_as_index(stop)} END"
    )
    sure = (
        f"CASE WHEN {_get('x', 'confidence')} IS NULL THEN {MODEL_CONFIDENCE}D "
        f"ELSE {_as_float(_get('x', 'confidence'))} END"
    )
    item = struct(
        nameless="na IS NULL",
        span=make_span("ty", "va", mask_for("ty"), "st", end, sure),
    )
    read = let(
        "na",
        text_or_empty("type"),
        let("ty", type_for("na"), let("va", text_or_empty("value"), let("st", start, item))),
    )
    known = (
        f"filter(transform({_items(v, 'pii_entities')}, x -> {read}), "
        "i -> i.nameless OR i.span.pii_type IS NOT NULL)"
    )
    sound = (
        "forall(known, i -> NOT i.nameless AND i.span.original_value IS NOT NULL "
        "AND i.span.start_index IS NOT NULL AND i.span.end_index IS NOT NULL "
        "AND coalesce(i.span.confidence BETWEEN 0 AND 1, false))"
    )
    spans = let("known", known, f"CASE WHEN {sound} THEN transform(known, i -> i.span) END")
    return f"coalesce(CAST({spans} AS array<{SPAN}>), {empty(SPAN)})"


def corrections(v: str, payload_text: str) -> str:
    """FIX of ``corrected_fields``; NULL when the reply has none to use."""
    member = _get(v, "corrected_fields")
    return (
        f"CASE WHEN {_kind(member)} LIKE 'OBJECT%' "
        f"THEN {_fix_of(member, payload_text, '$.corrected_fields')} "
        f"WHEN {v} IS NOT NULL AND {member} IS NULL THEN {_NO_FIX} END"
    )
