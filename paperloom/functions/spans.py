"""Finding, merging and resolving personal-data spans."""

from __future__ import annotations

from paperloom.functions.basics import empty, let, lit, lookup, struct
from paperloom.functions.fixed_values import (
    CONTEXT_CHARS,
    DEFAULT_MASK,
    PATTERN_CONFIDENCE,
    PII_ALIASES,
    PII_MASKS,
    PII_PATTERNS,
)

SPAN = (
    "struct<pii_type:string,original_value:string,masked_value:string,"
    "start_index:int,end_index:int,confidence:double>"
)

# Same case, word and line rules as the patterns were written for: ignore case,
# Unicode classes, and only \n ends a line.
_FLAGS = "(?iUd)"

# No pattern can match a text without an @ or one of these, so one cheap scan
# decides whether the fourteen patterns are tried at all. Exact, not a sample.
_NEEDS_DIGITS = r"(?U)\d{3}|\d[./-]\d"

# All that a pattern for numbers can match holds seven digits, with at most two
# other characters between one and the next. Ignoring case, the long s is an s and
# the i of other alphabets is an i.
_SEVEN_DIGITS = r"(?U)(?:\d[-.\s)]{0,2}){6}\d"
_SSN_WORDS = ("ssn", "social", "security", "\u017f")
_BIRTH_WORDS = ("dob", "birth", "born", "\u0131", "\u0130")

# Spark copies a fold's state at every step. A fold over the spans of a text
# that is full of them therefore runs in runs of this many.
_RUN = 64
_STATE = f"struct<upto:int,spans:array<{SPAN}>>"


def may_hold_pii(text: str) -> str:
    return f"(contains({text}, '@') OR {text} RLIKE {lit(_NEEDS_DIGITS)})"


def mask_for(pii_type: str) -> str:
    """The mask of a type."""
    return f"coalesce({lookup(PII_MASKS, pii_type)}, {lit(DEFAULT_MASK)})"


def type_for(name: str) -> str:
    """The type a model's name stands for, NULL when unknown."""
    return lookup(PII_ALIASES, f"replace(lower({name}), ' ', '_')")


def make_span(pii_type: str, value: str, mask: str, start: str, end: str, confidence: str) -> str:
    return struct(
        pii_type=pii_type,
        original_value=value,
        masked_value=mask,
        start_index=start,
        end_index=end,
        confidence=f"CAST({confidence} AS DOUBLE)",
    )


def _spans_of(text: str, pii_type: str, pattern: str, group: int) -> str:
    """All matches of one pattern.

    Spark has no function that returns match offsets, but the text between the
    matches is what ``split`` returns, so the lengths of the gaps and matches
    before a match add up to its start. That is done in runs: first the length
    of each run, then where each run starts, then the spans inside it.
    """
    regex = lit(_FLAGS + pattern)
    whole = f"regexp_extract_all({text}, {regex}, 0)"
    if group:
        value = f"regexp_extract_all({text}, {regex}, {group})"
        matches = f"zip_with({whole}, {value}, (m, v) -> {struct(whole='m', value='v')})"
    else:
        matches = f"transform({whole}, m -> {struct(whole='m', value='m')})"
    steps = (
        f"zip_with(split({text}, {regex}, -1), {matches}, "
        f"(g, h) -> {struct(gap='length(g)', hit='h')})"
    )
    start = "(acc.upto + step.gap)"
    end = f"({start} + length(step.hit.whole))"
    found = make_span(
        lit(pii_type), "step.hit.value", lit(PII_MASKS[pii_type]), start, end,
        str(PATTERN_CONFIDENCE),
    )
    grown = struct(upto=end, spans=f"concat(acc.spans, array({found}))")
    begin = f"CAST({struct(upto='b', spans=empty(SPAN))} AS {_STATE})"
    run = (
        f"aggregate(r, {begin}, (acc, step) -> "
        f"CASE WHEN step.hit IS NULL THEN acc ELSE {grown} END, acc -> acc.spans)"
    )
    runs = (
        f"transform(sequence(0, (size(steps) - 1) DIV {_RUN}), "
        f"n -> slice(steps, n * {_RUN} + 1, {_RUN}))"
    )
    sizes = (
        "transform(runs, r -> aggregate(r, 0, (acc, step) -> "
        "acc + step.gap + coalesce(length(step.hit.whole), 0)))"
    )
    starts = "transform(sizes, (z, i) -> aggregate(slice(sizes, 1, i), 0, (acc, x) -> acc + x))"
    found_all = let(
        "steps",
        steps,
        let(
            "runs",
            runs,
            let("sizes", sizes, f"flatten(zip_with(runs, {starts}, (r, b) -> {run}))"),
        ),
    )
    return f"CASE WHEN {text} RLIKE {regex} THEN {found_all} ELSE {empty(SPAN)} END"


def _gate(pii_type: str, pattern: str) -> str:
    """What must hold, of ``seven`` (digits) and the text ``low``, for the pattern to match."""
    if pii_type == "email":
        return "contains(low, '@')"
    if pii_type == "ip_address":
        return "contains(low, '.')"
    if pii_type == "date_of_birth":
        return " OR ".join(f"contains(low, {lit(w)})" for w in _BIRTH_WORDS)
    if "security" in pattern:
        return f"seven AND ({' OR '.join(f'contains(low, {lit(w)})' for w in _SSN_WORDS)})"
    if pii_type in ("ssn", "phone", "credit_card"):
        return "seven"
    return "true"


def pattern_spans(text: str) -> str:
    """Spans of every pattern, in catalogue order, overlaps kept.

    A pattern is tried only where a cheaper test leaves it a chance. The second
    pattern for cards, and the one for licences, match nothing that the pattern
    before them does not match as well.
    """
    found = []
    tried = iter(PII_PATTERNS)
    for entry in tried:
        spans = _spans_of(text, *entry)
        if entry[0] in ("credit_card", "passport"):
            wider = let("wider", spans, f"CASE WHEN size(wider) = 0 THEN wider "
                        f"ELSE concat(wider, {_spans_of(text, *next(tried))}) END")
            spans = wider
        gate = _gate(*entry[:2])
        found.append(f"CASE WHEN {gate} THEN {spans} ELSE {empty(SPAN)} END")
    seven = f"{text} RLIKE {lit(_SEVEN_DIGITS)}"
    # Lower case with the original: some letters change their length.
    low = f"concat(lower({text}), CASE WHEN contains({text}, '\u0130') THEN '\u0130' ELSE '' END)"
    every = let("low", low, let("seven", seven, f"concat({', '.join(found)})"))
    return f"CASE WHEN {may_hold_pii(text)} THEN {every} ELSE {empty(SPAN)} END"


def context(text: str, span: str) -> str:
    """R2: the span with up to 20 characters on either side."""
    left = f"greatest(0, {span}.start_index - {CONTEXT_CHARS})"
    return f"substring({text}, {left} + 1, {span}.end_index + {CONTEXT_CHARS} - {left})"


def overlaps(a: str, b: str) -> str:
    """Half-open intervals share a position."""
    return f"NOT ({a}.end_index <= {b}.start_index OR {b}.end_index <= {a}.start_index)"


def in_start_order(spans: str) -> str:
    keyed = f"transform({spans}, (s, i) -> {struct(at='s.start_index', i='i', span='s')})"
    return f"transform(array_sort({keyed}), k -> k.span)"


def merge_spans(found: str, modelled: str) -> str:
    """Add model spans to pattern spans.

    A model span replaces the first span it overlaps only when strictly more
    confident, and then goes last; without an overlap it is appended. The result
    is in start order, earlier entries first on ties.
    """
    hit = f"CAST(array_position(transform(acc, s -> {overlaps('s', 'new')}), true) AS INT)"
    choice = (
        "CASE WHEN hit = 0 THEN concat(acc, array(new)) "
        "WHEN try_element_at(acc, greatest(hit, 1)).confidence < new.confidence "
        "THEN concat(filter(acc, (s, i) -> i + 1 <> hit), array(new)) ELSE acc END"
    )
    merged = f"aggregate({modelled}, {found}, (acc, new) -> {let('hit', hit, choice)})"
    return f"CASE WHEN size({modelled}) > 0 THEN {in_start_order(merged)} " \
           f"ELSE {in_start_order(found)} END"


def resolve(text: str, spans: str) -> str:
    """Non-overlapping spans: leftmost, then longest, then first listed.

    Spans that do not lie inside the text, or hold no text, are dropped.
    """
    sound = (
        f"filter({spans}, s -> s.start_index >= 0 AND s.start_index < s.end_index "
        f"AND s.end_index <= size_ AND s.original_value <> '')"
    )
    keyed = (
        f"array_sort(transform({sound}, (s, i) -> "
        f"{struct(at='s.start_index', longest='-s.end_index', i='i', span='s')}))"
    )
    # A fold's state is copied at every step, so lists grow only inside a run: first
    # where the kept spans before each run end, then the spans kept in each run.
    runs = (
        f"transform(sequence(0, size(sorted) DIV {_RUN}), "
        f"n -> slice(sorted, n * {_RUN} + 1, {_RUN}))"
    )
    starts = (
        "aggregate(runs, array(0), (acc, r) -> concat(acc, array(aggregate(r, "
        "element_at(acc, -1), (upto, k) -> CASE WHEN k.at < upto THEN upto "
        "ELSE k.span.end_index END))))"
    )
    begin = f"CAST({struct(upto='b', spans=empty(SPAN))} AS {_STATE})"
    keep = struct(upto="k.span.end_index", spans="concat(acc.spans, array(k.span))")
    run = (
        f"aggregate(r, {begin}, (acc, k) -> "
        f"CASE WHEN k.at < acc.upto THEN acc ELSE {keep} END, acc -> acc.spans)"
    )
    kept = let("runs", runs, f"flatten(zip_with(runs, slice({starts}, 1, size(runs)), (r, b) -> {run}))")
    return let("size_", f"length({text})", let("sorted", keyed, kept))
