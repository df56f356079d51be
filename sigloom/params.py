"""Choices where the described pipeline leaves room; every stage takes one of these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    inet_text: bool = False  # addresses with /32 appended, as a network type prints them
    align_bins: bool = True  # a lookback starts at the start of its first bin
    top_n: int | None = None  # signatures kept in an entity's profile
    none_as_null: bool = True  # a missing id is null, not the text "None"
    envelope_rule_id: bool = False  # the envelope's rule id stands in for a missing one
    nested_app_json: bool = False  # application logs with a JSON body give method, path and status


DEFAULT = Compat()
