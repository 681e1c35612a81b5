"""A slow, plain Python model of the row-local stages, for differential tests."""

from __future__ import annotations

import re

from paperloom.functions.fixed_values import PII_MASKS, PII_PATTERNS

# A span is (type, value, start, end, confidence).


def find(text: str) -> list[tuple]:
    out = []
    for kind, pattern, group in PII_PATTERNS:
        compiled = re.compile(pattern, re.IGNORECASE)
        out += [
            (kind, m.group(group), m.start(), m.end(), 0.9) for m in compiled.finditer(text)
        ]
    return out


def merge(found: list[tuple], modelled: list[tuple]) -> list[tuple]:
    out = list(found)
    for new in modelled:
        clash = [i for i, old in enumerate(out) if old[3] > new[2] and new[3] > old[2]]
        if not clash:
            out.append(new)
        elif out[clash[0]][4] < new[4]:
            del out[clash[0]]
            out.append(new)
    return sorted(out, key=lambda s: s[2])


def mask(text: str, spans: list[tuple]) -> tuple[str, list[tuple]]:
    numbered = sorted(enumerate(spans), key=lambda pair: (-pair[1][2], pair[0]))
    kept = []
    for _, span in numbered:
        kind, value, start, end, _ = span
        if value in text:
            text = text.replace(value, PII_MASKS[kind], 1)
        elif start < len(text):
            text = text[:start] + PII_MASKS[kind] + text[end:]
        else:
            continue
        kept.insert(0, span)
    return text, kept


def clean(text: str, spans: list[tuple]) -> tuple[str, list[tuple]]:
    good = [
        (s[2], -s[3], i, s)
        for i, s in enumerate(spans)
        if 0 <= s[2] < s[3] <= len(text) and s[1]
    ]
    pieces, at, kept = [], 0, []
    for _, _, _, s in sorted(good):
        if s[2] >= at:
            pieces += [text[at : s[2]], PII_MASKS[s[0]]]
            at = s[3]
            kept.append(s)
    return "".join(pieces) + text[at:], kept


def overlapping(left: list[tuple], right: list[tuple]) -> set[tuple]:
    """Spans (start, end) of ``left`` that overlap one of ``right``."""
    return {a for a in left if any(a[1] > b[0] and b[1] > a[0] for b in right)}
