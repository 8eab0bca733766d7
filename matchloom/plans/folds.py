"""Greedy sequential rules (cooldowns, debounces) on pre-filtered candidate rows."""

from __future__ import annotations

from matchloom.plans.chains import debounce

__all__ = ["debounce"]
