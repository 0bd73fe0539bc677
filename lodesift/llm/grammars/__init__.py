"""Syntax checks of the supported languages."""

from __future__ import annotations

from lodesift.llm.grammars.registry import LANGUAGES, parses

__all__ = ["LANGUAGES", "parses"]
