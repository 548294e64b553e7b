"""Acceptance rules for generated responses, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings that count as addressing the user.
USER_MARKERS = ("you", "your", "since you", "you mentioned", "you asked", "you said",
                "you love", "you wanted")
USER_MARKERS_WIDE = (*USER_MARKERS, "you kept", "you've")
CONNECTORS = (" — ", " - ")


@dataclass(frozen=True)
class GateRules:
    """What a response must satisfy; unset rules do not apply."""

    min_length: int = 50
    markers: tuple[str, ...] = ()
    marker_window: int = 40
    connectors: tuple[str, ...] = ()


PLAIN = GateRules()
USER_FIRST = GateRules(markers=USER_MARKERS)
EXPLAINED = GateRules(min_length=60, markers=USER_MARKERS_WIDE, marker_window=50,
                      connectors=CONNECTORS)


def user_first(text: Column, markers: tuple[str, ...], window: int) -> Column:
    """The first sentence starts with a marker or has one near its start."""
    sentence = F.lower(F.substring_index(text, ".", 1))
    opening = F.substring(sentence, 1, window)
    hit = F.lit(False)
    for marker in markers:
        hit = hit | sentence.startswith(marker) | F.contains(opening, F.lit(f" {marker}"))
    return hit


def gate_reason(text: Column, rules: GateRules = PLAIN) -> Column:
    """Why a response is refused, or null if it passes."""
    reason = F.when(text.isNull(), "missing")
    if rules.markers:
        reason = reason.when(~user_first(text, rules.markers, rules.marker_window), "not_user_first")
    if rules.connectors:
        linked = F.lit(False)
        for c in rules.connectors:
            linked = linked | F.contains(text, F.lit(c))
        reason = reason.when(~linked, "no_connector")
    reason = reason.when(text.startswith("{") | text.startswith("["), "json")
    return reason.when(F.length(text) < rules.min_length, "too_short")
