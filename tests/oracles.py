"""Plain-Python versions of the sequential definitions, for small random data."""

import math
from collections import defaultdict, deque


def windows(rows):
    """rows: dicts with key, service, us (or None), line, numbers; returns per line the three window features."""
    ordered = sorted(rows, key=lambda r: (r["us"] is None, r["us"] or 0, r["line"]))
    recent, numbers, last, out = defaultdict(deque), defaultdict(list), {}, {}
    for r in ordered:
        if r["us"] is None:
            burst = 1
        else:
            queue = recent[r["key"]]
            while queue and queue[0] < r["us"] - 10_000_000:
                queue.popleft()
            queue.append(r["us"])
            burst = len(queue)
        numbers[r["key"]].extend(r["numbers"])
        xs = numbers[r["key"]]
        if len(xs) < 2:
            spread = 0.0
        else:
            mean = math.fsum(xs) / len(xs)
            spread = math.sqrt(math.fsum((x - mean) ** 2 for x in xs) / len(xs))
        delta = 0.0
        if r["us"] is not None:
            if r["service"] in last:
                delta = min(max((r["us"] - last[r["service"]]) / 1e6, 0.0), 86400.0)
            last[r["service"]] = r["us"]
        out[r["line"]] = (burst, spread, round(delta, 4))
    return out


def entropy(text):
    if len(text) < 2:
        return 0.0
    counts = defaultdict(int)
    for ch in text:
        counts[ch] += 1
    h = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    return round(min(h / math.log2(len(text)), 1.0), 6)
