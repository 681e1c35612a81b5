"""Replacing spans by masks, and counting them."""

from __future__ import annotations

from paperloom.functions.basics import empty, let, struct
from paperloom.functions.spans import SPAN

# Characters per block when pieces of a text are looked up by position.
_BLOCK = 4096
MASKED = f"struct<text:string,kept:array<{SPAN}>>"


def mask_by_value(text: str, spans: str) -> str:
    """R6, ``compat``: last span first, each replacing the first place its value
    occurs in the text as it then stands; its own position when the value is
    gone; nothing when that position is past the end. Gives text and the spans
    that were masked, in start order with ties reversed.
    """
    last_first = (
        f"array_sort(transform({spans}, (s, i) -> "
        f"{struct(at='-s.start_index', i='i', span='s')}))"
    )
    # The state holds places in the list, not spans: it is copied at every step.
    state = "struct<text:string,n:int,kept:array<int>>"
    kept = "concat(acc.kept, array(acc.n + 1))"
    by_value = (
        "concat(substring(acc.text, 1, at - 1), k.span.masked_value, "
        "substring(acc.text, at + length(k.span.original_value)))"
    )
    by_place = (
        "concat(substring(acc.text, 1, greatest(k.span.start_index, 0)), k.span.masked_value, "
        "substring(acc.text, greatest(k.span.end_index, 0) + 1))"
    )
    put = (
        f"CASE WHEN at > 0 THEN {struct(text=by_value, n='acc.n + 1', kept=kept)} "
        f"WHEN k.span.start_index < length(acc.text) "
        f"THEN {struct(text=by_place, n='acc.n + 1', kept=kept)} "
        f"ELSE {struct(text='acc.text', n='acc.n + 1', kept='acc.kept')} END"
    )
    begin = f"CAST({struct(text=text, n='0', kept='array()')} AS {state})"
    step = let("at", "instr(acc.text, k.span.original_value)", put)
    done = struct(
        text="acc.text",
        kept="transform(reverse(acc.kept), p -> element_at(sorted, p).span)",
    )
    fold = let(
        "sorted", last_first, f"aggregate(sorted, {begin}, (acc, k) -> {step}, acc -> {done})"
    )
    untouched = f"CAST({struct(text=text, kept=empty(SPAN))} AS {MASKED})"
    # When every span holds the first occurrence of its value and none overlaps
    # the next, each step finds its own place: splicing by position is the same.
    in_place = (
        f"forall({spans}, s -> s.end_index - s.start_index = length(s.original_value) "
        f"AND instr({text}, s.original_value) = s.start_index + 1 AND s.original_value <> '') "
        f"AND forall(sequence(1, size({spans})), i -> i = size({spans}) OR "
        f"element_at({spans}, i).end_index <= try_element_at({spans}, i + 1).start_index)"
    )
    return (
        f"CASE WHEN size({spans}) = 0 THEN {untouched} "
        f"WHEN {in_place} THEN {mask_by_place(text, spans)} ELSE {fold} END"
    )


def _between(start: str, end: str) -> str:
    """Characters [start, end) of the text cut into ``blocks``."""
    first = f"CAST({start} DIV {_BLOCK} AS INT)"
    last = f"CAST(greatest({start}, {end} - 1) DIV {_BLOCK} AS INT)"
    return (
        f"substring(array_join(slice(blocks, {first} + 1, {last} - {first} + 1), ''), "
        f"{start} - {first} * {_BLOCK} + 1, {end} - {start})"
    )


def mask_by_place(text: str, spans: str) -> str:
    """``clean``: splice masks in by position; ``spans`` must not overlap.

    Spark finds a character by counting from the start of a string, so the text
    is cut into blocks first and each piece is looked up in its own.
    """
    blocks = (
        f"transform(sequence(0, size_ DIV {_BLOCK}), "
        f"n -> substring({text}, CAST(n * {_BLOCK} AS INT) + 1, {_BLOCK}))"
    )
    before = f"CASE WHEN i = 0 THEN 0 ELSE try_element_at({spans}, greatest(i, 1)).end_index END"
    piece = let("b", before, f"concat({_between('b', 's.start_index')}, s.masked_value)")
    tail = let("b", f"try_element_at({spans}, -1).end_index", _between("b", "size_"))
    joined = f"concat(array_join(transform({spans}, (s, i) -> {piece}), ''), {tail})"
    cut = let("size_", f"length({text})", let("blocks", blocks, joined))
    return (
        f"CASE WHEN size({spans}) = 0 THEN {struct(text=text, kept=empty(SPAN))} "
        f"ELSE {struct(text=cut, kept=spans)} END"
    )


def count_by_type(spans: str) -> str:
    """Map type -> count, in order of first appearance."""
    kinds = f"array_distinct(transform({spans}, s -> s.pii_type))"
    return let(
        "kinds",
        kinds,
        f"map_from_arrays(kinds, transform(kinds, k -> "
        f"size(filter({spans}, s -> s.pii_type = k))))",
    )
