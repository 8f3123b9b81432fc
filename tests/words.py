"""Brute-force word similarity."""

from __future__ import annotations

import re


def ordered(text):
    grams = []
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        padded = f"  {word} "
        grams += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return grams


def best_extent(query, text):
    wanted, grams, best = set(ordered(query)), ordered(text), 0.0
    for i in range(len(grams)):
        for j in range(i + 1, len(grams) + 1):
            run = set(grams[i:j])
            shared = len(run & wanted)
            if shared:
                best = max(best, shared / (len(wanted) + len(run) - shared))
    return best
